"""Ranks over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its row number (from 1) in this order: ranges of rows are sorted where they lie, and a row adds what the ranges before
    its own hold. The order should leave no ties."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(ranges.withColumn("__range", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    sizes = sorted((r["__range"], r.n) for r in held.groupBy("__range").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, at = [], 0
    for k, n in sizes:
        before.append((k, at))
        at += n
    offsets = df.sparkSession.createDataFrame(before, "__range int, __before long")
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))  # the number of a row within its partition
    return held.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + within + 1).drop("__range", "__id", "__before")
