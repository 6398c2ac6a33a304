"""Where a model plugs in. A provider is a function from a list of texts and a language to a list of texts; none is built in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import language as G
from ..session import ship

Provider = Callable[[list[str], str], list[str | None]]
#: Texts of one call.
BATCH = 24


def provided(rows: DataFrame, provider: Provider, *, text: str = "text", lang: str = "lang", out: str = "translated") -> DataFrame:
    """rows with the provider's text; English and blank texts stay as they are. Rows of a language stay together for its calls."""
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(frames):
        for frame in frames:
            made = frame[text].copy()
            for language, part in frame.groupby(lang, dropna=False):
                todo = part[part[text].fillna("").str.strip() != ""]
                if language == "en" or not len(todo):
                    continue
                for a in range(0, len(todo), BATCH):
                    own = todo.iloc[a : a + BATCH]
                    answers = provider(own[text].tolist(), language)
                    made.loc[own.index] = [x if x is not None else t for x, t in zip(answers, own[text], strict=True)]
            yield frame.assign(**{out: made})

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(F.col(lang), F.spark_partition_id() % tasks).mapInPandas(run, schema)


def looked_up(rows: DataFrame, dictionary: DataFrame, *, text: str = "text", out: str = "translated") -> DataFrame:
    """rows with the dictionary's (text, translation); what it lacks stays as it is."""
    d = dictionary.select(F.col("text").alias(text), F.col("translation").alias("__t"))
    return rows.join(d, text, "left").withColumn(out, F.coalesce("__t", text)).drop("__t")


def remaining(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a task that starts again has still to do."""
    return units.join(done.select(*keys), keys, "left_anti")


def guarded(nodes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Labels that are still in another script, looked up; the others as they are."""
    foreign = nodes.where(G.needs_translation(F.col("text")))
    fixed = looked_up(foreign, dictionary, out="t").withColumn("text", F.col("t")).drop("t")
    return nodes.join(foreign.select("node_id"), "node_id", "left_anti").unionByName(fixed.select(nodes.columns))
