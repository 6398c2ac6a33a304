"""The activity operators over streams; on the same rows they give what the batch operators give."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import activity as A
from ..session import ship

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_visits(activity: DataFrame, late: str | None = None) -> DataFrame:
    """Each user's visits to a node once, for ever; with late, as far apart as the watermark remembers, for a state that does not grow."""
    rows = activity.where("kind = 'node_explored'")
    if late is None:
        return rows.dropDuplicates(["room", "user_id", "node"])
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["room", "user_id", "node"])


def windowed(activity: DataFrame, width: str, late: str) -> DataFrame:
    """Events by room and time window, closed once the watermark has passed."""
    rows = activity.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("room", F.window("ts", width)).agg(F.count("*").alias("events")).select("room", F.col("window.start").alias("start"), "events")


_STATE = T.StructType([T.StructField("points", T.LongType()), T.StructField("explored", T.StringType()), T.StructField("version", T.LongType())])
_OUT = T.StructType([T.StructField("room", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("points", T.LongType()), T.StructField("explored", T.LongType()), T.StructField("version", T.LongType())])


def running_counters(activity: DataFrame) -> DataFrame:
    """Points, explored nodes and version (batches that counted) of each user, kept in state and given out at each change."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..functions.lexicon import POINTS

    ship(activity.sparkSession)

    def update(key, batches, state) -> Iterator:
        import json

        import pandas as pd

        points, explored, version = state.get if state.exists else (0, "[]", 0)
        seen = set(json.loads(explored))
        changed = False
        for rows in batches:
            for r in rows.sort_values("seq").itertuples(index=False):
                if r.kind == "node_explored":
                    if r.node is None or r.node != r.node or int(r.node) in seen:
                        continue
                    seen.add(int(r.node))
                elif r.kind not in POINTS:
                    continue
                points += POINTS[r.kind]
                changed = True
        version += changed
        state.update((points, json.dumps(sorted(seen)), version))
        if changed:
            yield pd.DataFrame({"room": [key[0]], "user_id": [key[1]], "points": [points], "explored": [len(seen)], "version": [version]})

    rows = activity.select("room", "user_id", "seq", "kind", "node")
    return rows.groupBy("room", "user_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, table_path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keeps the newest row of each key. A batch writes its own newest rows beside the others, so its work follows its size; a batch that runs
    again replaces what it wrote. ``current`` reads the table, ``compact`` puts it together."""

    def add(batch: DataFrame, number: int) -> None:
        newest(batch, keys, F.col(order)).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("r")).select(*keys, "r.*")


def current(spark: SparkSession, table_path: str, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key over all batches; of equals the later batch's."""
    return newest(spark.read.parquet(table_path), keys, F.struct(order, "batch")).drop("batch")


def compact(spark: SparkSession, table_path: str, into: str, keys: list[str], order: str) -> None:
    """The table as one batch in another place, which later batches can be added to: its number is below theirs."""
    current(spark, table_path, keys, order).write.mode("errorifexists").parquet(f"{into}/batch=-1")


def activity_of(events: DataFrame) -> DataFrame:
    return A.from_events(events)
