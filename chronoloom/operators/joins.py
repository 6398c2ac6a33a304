"""Joins in time. Every one has the video as an equal key; the band is checked on what that leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within(rows: DataFrame, spans: DataFrame, before: float, after: float, key: str = "video_id") -> DataFrame:
    """Rows (start) joined with the spans (s_start, s_end) that hold their start, with a margin on both sides; the end is open."""
    return rows.join(spans, key).where((F.col("start") >= F.col("s_start") - before) & (F.col("start") < F.col("s_end") + after))


def as_of(ticks: DataFrame, nodes: DataFrame, slack: float, key: str = "video_id") -> DataFrame:
    """Each tick (t) with the latest node (node, start, depth) that has started by t + slack; the deepest of equals.

    One sort of both sides together instead of a band join: a node is carried forward until the next.
    """
    a = nodes.select(key, F.col("start").alias("at"), F.lit(0).alias("kind"), "depth", F.struct("node", "start", "depth").alias("held"), F.lit(None).cast("double").alias("t"))
    b = ticks.select(key, (F.col("t") + slack).alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("depth"), F.lit(None).cast(a.schema["held"].dataType).alias("held"), "t")
    w = Window.partitionBy(key).orderBy("at", "kind", "depth").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("held", F.last("held", ignorenulls=True).over(w)).where("kind = 1")
    return found.where("held IS NOT NULL").select(key, "t", "held.node", "held.start", "held.depth")
