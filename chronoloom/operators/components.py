"""Connected components of an edge table, by alternating stars. Every step is a group minimum and a join; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, tidy

#: Rounds after which what earlier rounds left on disk is let go.
TIDY = 2


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour is tied to the least of the neighbourhood; at most as many rows as edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "k")
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour, and the vertex itself, is tied to the least of the smaller neighbours."""
    down = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    inner = down.join(least, F.col("a") == F.col("k")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """No vertex is tied twice, and none that is tied has others tied to it."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every end of an edge (a, b); component is the least vertex that links reach."""
    spark = edges.sparkSession
    # the steps read the edges twice, so they are made once: another run might find other edges of the same components
    now = cut(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    now = cut(_small_star(now))
    rounds = 0
    while not _are_stars(now):
        now = cut(_small_star(_large_star(now)))
        rounds += 1
        if rounds % TIDY == 0:
            tidy(spark)
    stars = now.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("v"), "component").distinct())
