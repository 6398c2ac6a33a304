"""Ranked retrieval over lines and nodes. Scores are columns; only the best few rows are ever gathered."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut

LEAST_SCORE, OF_BEST = 0.15, 0.45
FEWEST, MOST, BUDGET = 5, 8, 1250


def query_words(question: str, least: int) -> list[str]:
    import re

    return list(dict.fromkeys(w for w in re.findall(r"\w+", question.lower()) if len(w) >= least))


def word_share(low: Column, words: list[str]) -> Column:
    """Share of the words that a lowered text holds."""
    hits = [F.when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0) for w in words]
    return sum(hits[1:], hits[0]) / F.lit(float(len(words))) if hits else F.lit(0.0)


def hybrid_score(cosine: Column, low: Column, words: list[str], preferred: Column) -> Column:
    return cosine * 0.75 + word_share(low, words) * 0.35 + F.when(preferred, F.lit(0.05)).otherwise(F.lit(0.0))


def best(scored: DataFrame, limit: int, *ties: str) -> DataFrame:
    """The limit best rows, without those far below the first."""
    top = scored.orderBy(F.desc("score"), *ties).limit(limit)
    w = Window.partitionBy()  # of at most ``limit`` rows
    return top.withColumn("cutoff", F.greatest(F.lit(LEAST_SCORE), F.max("score").over(w) * OF_BEST)).where(F.col("score") >= F.col("cutoff")).drop("cutoff")


def within_budget(scored: DataFrame, key: list[str], order: list[Column], text: str = "text") -> DataFrame:
    """Of each group's MOST * 2 best rows, five to eight whose estimated tokens fit, in time order.

    Short rows are passed over once there are five; what no longer fits ends the choice once there are five.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    top = scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * MOST)
    rows = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", F.col("start"), F.col(text).alias("text")))).alias("rows"))
    none = F.struct(F.array().cast("array<struct<place:int,start:double,text:string>>").alias("held"), F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("over"))

    def take(s: Column, x: Column) -> Column:
        cost = X.estimated_tokens(x["text"]) + 4
        enough = F.size(s["held"]) >= FEWEST
        skip = s["over"] | (enough & (F.length(x["text"]) < 20)) | (F.size(s["held"]) >= MOST)
        ends = ~skip & enough & (s["used"] + cost > BUDGET)
        kept = F.when(skip | ends, s["held"]).otherwise(F.array_append(s["held"], x))
        return F.struct(kept.alias("held"), F.when(skip | ends, s["used"]).otherwise(s["used"] + cost).alias("used"), (s["over"] | ends).alias("over"))

    chosen = rows.select(*key, F.aggregate("rows", none, take)["held"].alias("held")).select(*key, F.explode("held").alias("r"))
    return chosen.select(*key, "r.place", "r.start", "r.text")


def round_robin(rows: DataFrame, key: str, part: str, order: str, most: int) -> DataFrame:
    """The first of every part, then the second of every part, and so on, up to ``most`` of a key."""
    r = F.row_number().over(Window.partitionBy(key, part).orderBy(order))
    n = F.row_number().over(Window.partitionBy(key).orderBy("turn", part))
    return rows.withColumn("turn", r).withColumn("n", n).where(F.col("n") <= most)


def mmr(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """k rows of each key (id, vector) that are near its mean vector and unlike each other: .7 relevance less .3 likeness.

    Means and picks are partial aggregates, one round for each pick, so a key may hold any share of the rows; a pick is one vector
    of each key. Ties go to the least id.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    held = rows.select(F.col(key).alias("g"), "id", F.col(vector).cast("array<double>").alias("v"))
    dims = held.select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.avg("x").alias("x"))
    mean = dims.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    relevance = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("v"), F.col("mean"))))
    held = held.join(mean, "g").select("g", "id", "v", relevance.alias("relevance"), F.lit(None).cast("double").alias("like"))
    picks = []
    for n in range(1, k + 1):
        score = 0.7 * F.col("relevance") - 0.3 * F.coalesce("like", F.lit(0.0))
        best = F.struct(F.round(score, 12).alias("score"), (-F.col("id")).alias("first"))
        chosen = cut(held.groupBy("g").agg(F.max_by(F.struct("id", "v"), best).alias("c")).select("g", F.col("c.id").alias("c_id"), F.col("c.v").alias("c_v")))
        picks.append(chosen.select(F.col("g").alias(key), F.col("c_id").alias("id"), F.lit(n).cast("bigint").alias("pick")))
        held = held.join(chosen, "g").where("id <> c_id").withColumn("like", F.greatest("like", dot(F.col("v"), F.col("c_v")))).drop("c_id", "c_v")
    return functools.reduce(DataFrame.unionByName, picks)
