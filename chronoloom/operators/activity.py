"""Scores, badges and presence from an activity log: activity(room, user_id, seq, ts, kind, node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .folds import ordered_scan

#: Badge, counter and what it takes, in their order.
BADGES = [
    ("first-steps", "points", 1), ("explorer", "explored", 25), ("scribe", "note_added", 10), ("architect", "built", 20), ("curator", "link_added", 5),
    ("quiz-whiz", "quiz_correct", 10), ("memory-master", "flashcard_correct", 25), ("team-player", "team", 1),
]
#: What the event types of the log stand for.
KINDS = {"view": "node_explored", "click": "node_edited", "purchase": "quiz_correct", "signup": "team", "error": "unknown"}


def from_events(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    node = F.variant_get(F.parse_json("props"), "$.k", "int")
    return events.select((F.col("user_id") % 10).alias("room"), "user_id", F.col("event_id").alias("seq"), "ts", kind.alias("kind"), node.alias("node"))


def edit_kind(op: Column, patch_keys: Column) -> Column:
    """The activity that an edit counts as."""
    return (
        F.when(op == "add", F.lit("node_added"))
        .when((op == "update") & F.array_contains(patch_keys, "notes"), F.lit("note_added"))
        .when((op == "update") & F.array_contains(patch_keys, "links"), F.lit("link_added"))
        .otherwise(F.lit("node_edited"))
    )


def points_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(L.POINTS.items()), "kind string, points long")  # a row for each kind of event


def counted(activity: DataFrame) -> DataFrame:
    """The rows that count: known kinds, and of each user's visits to a node the first."""
    visits = activity.where("kind = 'node_explored'").where("node IS NOT NULL")
    first = visits.groupBy("room", "user_id", "node").agg(F.min(F.struct("seq", "ts")).alias("at"))
    seen = first.select("room", "user_id", F.col("at.seq").alias("seq"), F.col("at.ts").alias("ts"), F.lit("node_explored").alias("kind"), "node")
    others = activity.where(F.col("kind").isin([k for k in L.POINTS if k != "node_explored"] + ["team"]))
    return others.select("room", "user_id", "seq", "ts", "kind", "node").unionByName(seen)


def user_counters(activity: DataFrame) -> DataFrame:
    """A row for each user of a room: a counter for each kind, points and explored nodes."""
    rows = counted(activity).join(F.broadcast(points_table(activity.sparkSession)), "kind", "left")
    each = [F.count_if(F.col("kind") == k).alias(k) for k in L.POINTS if k != "node_explored"]
    return rows.groupBy("room", "user_id").agg(
        F.sum(F.coalesce("points", F.lit(0))).alias("points"), *each, F.count_if(F.col("kind") == "node_explored").alias("explored"), F.max(F.when(F.col("kind") == "team", 1).otherwise(0)).alias("team")
    ).withColumn("built", F.col("node_added") + F.col("node_edited"))


def badges(counters: DataFrame) -> DataFrame:
    earned = F.array_compact(F.array(*[F.when(F.col(c) >= n, F.lit(b)) for b, c, n in BADGES]))
    return counters.withColumn("badges", earned)


def leaderboard(counters: DataFrame) -> DataFrame:
    w = Window.partitionBy("room").orderBy(F.desc("points"), "user_id")
    return counters.select("room", F.row_number().over(w).alias("rank"), "user_id", "points", "explored")


def level(points: Column) -> Column:
    return (F.floor(F.sqrt(points / F.lit(10.0))) + 1).cast("bigint")


def version_gaps(log: DataFrame) -> DataFrame:
    """log(room, seq, version) with the versions missed before each: a client in that place needs the whole map."""
    w = Window.partitionBy("room").orderBy("seq")
    return log.withColumn("missed", F.greatest(F.lit(0), F.col("version") - F.lag("version", 1).over(w) - 1))


def presence(activity: DataFrame) -> DataFrame:
    """Where each user of a room was last."""
    return activity.groupBy("room", "user_id").agg(F.max_by("node", "seq").alias("node"), F.max("ts").alias("ts"))


def windows(activity: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events and users by time window; an addition for logs, not a rule of rooms."""
    held = activity.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("room", F.window("ts", width, slide) if slide else F.window("ts", width))
    return held.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users")).select("room", F.col("window.start").cast("timestamp_ntz").alias("start"), "events", "users")


def sessions(activity: DataFrame, gap: str) -> DataFrame:
    held = activity.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return held.agg(F.count("*").alias("events")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), F.col("s.end").cast("timestamp_ntz").alias("end"), "events")


def replacements(proposals: DataFrame) -> DataFrame:
    """proposals (room, seq, base) with accepted and version: in the order of seq one is taken if its base is the room's version by then, or
    null, which forces it; each that is taken makes a version. A room's proposals are read in order with its version."""

    def step(version, row):
        now, (base,) = version or 0, row
        now = now + 1 if base is None or base == now else -now - 1  # below 0: not taken
        return (now if now > 0 else -now - 1), now

    held = ordered_scan(proposals, "room", ["seq"], ["base"], step, "__made")
    return held.withColumn("accepted", F.col("__made") > 0).withColumn("version", F.when(F.col("__made") > 0, F.col("__made")).otherwise(-F.col("__made") - 1)).drop("__made")
