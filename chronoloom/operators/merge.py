"""Merging maps into others, level by level, for all maps at once.

A child of the incoming map meets a child of the base when their parents have met: by the same id first, then by the best
likeness to a child of the same type that nobody has taken, in the incoming order. What meets nobody is appended below its parent, with
all that hangs below it. Levels are taken until no pair meets, however deep the maps are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut
from .folds import ordered_scan
from .tree import DEEPEST

LEAST = 0.78
#: Tones that a merged node keeps.
TONES = 3
COLUMNS = ["map_id", "node_id", "parent_id", "ord", "type", "text"]


def alike_texts(base: DataFrame, other: DataFrame) -> DataFrame:
    """(map_id, o_node, b_node, near) of nodes whose normal texts are equal: the plainest provider of likeness."""
    t = X.normal(F.col("text"))
    left = other.select("map_id", F.col("node_id").alias("o_node"), t.alias("t"))
    return left.join(base.select("map_id", F.col("node_id").alias("b_node"), t.alias("t")), ["map_id", "t"]).select("map_id", "o_node", "b_node", F.lit(1.0).alias("near"))


def alike_vectors(base: DataFrame, other: DataFrame, vector: str = "v") -> DataFrame:
    """(map_id, o_node, b_node, near) by the cosine of vectors, of nodes whose parents have met: likeness for ``merge_maps``'s near,
    given as a function of the pairs that come into question."""

    def near(pairs: DataFrame) -> DataFrame:
        a = other.select("map_id", F.col("node_id").alias("o_node"), F.col(vector).alias("o_v"))
        b = base.select("map_id", F.col("node_id").alias("b_node"), F.col(vector).alias("b_v"))
        dot = F.aggregate(F.zip_with("o_v", "b_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        size = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
        cosine = dot / F.greatest(size("o_v") * size("b_v"), F.lit(1e-12))
        return pairs.join(a, ["map_id", "o_node"]).join(b, ["map_id", "b_node"]).withColumn("near", cosine).drop("o_v", "b_v")

    return near


def _one_to_one(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each parent: the same ids, then in the incoming order each the best that is left. A parent's pairs are read in
    order, however many there are; the state is what is taken."""
    pairs = pairs.withColumn("same", (F.col("o_node") != F.col("b_node")).cast("int")).withColumn("far", -F.col("near")).withColumn("parent", F.struct("map_id", "b_parent").cast("string"))

    def step(state, row):
        o, b = row
        taken_o, taken_b = state if state is not None else (set(), set())
        free = o not in taken_o and b not in taken_b
        if free:
            taken_o.add(o)
            taken_b.add(b)
        return (taken_o, taken_b), int(free)

    scanned = ordered_scan(pairs, "parent", ["same", "o_ord", "far", "b_ord", "o_node", "b_node"], ["o_node", "b_node"], step, "meets")
    return scanned.where("meets = 1").select("map_id", "o_node", "b_node")


def _met(base: DataFrame, other: DataFrame, near, least: float) -> DataFrame:
    """(map_id, o_node, b_node) of all nodes that meet."""
    root = lambda df, name: df.where("parent_id IS NULL").groupBy("map_id").agg(F.min("node_id").alias(name))
    met = cut(root(other, "o_node").join(root(base, "b_node"), "map_id").select("map_id", "o_node", "b_node"))
    found = met
    side = lambda df, s: df.select("map_id", F.col("node_id").alias(f"{s}_node"), F.col("parent_id").alias(f"{s}_parent"), F.col("type").alias(f"{s}_type"), F.col("ord").alias(f"{s}_ord"))
    b, o = side(base, "b"), side(other, "o")
    for _ in range(DEEPEST):
        ends = met.select("map_id", F.col("o_node").alias("o_parent"), F.col("b_node").alias("b_parent"))
        left = o.join(ends, ["map_id", "o_parent"])
        same = left.join(b, ["map_id", "b_parent"]).where("o_node = b_node").withColumn("near", F.lit(2.0))
        if isinstance(near, DataFrame):
            alike = left.join(near.where(F.col("near") >= least), ["map_id", "o_node"]).join(b, ["map_id", "b_node", "b_parent"]).where("o_type = b_type")
        else:
            alike = near(left.join(b, ["map_id", "b_parent"]).where("o_type = b_type")).where(F.col("near") >= least)
        met = cut(_one_to_one(same.unionByName(alike.select(same.columns))))
        if met.isEmpty():
            return found
        found = found.unionByName(met)
    raise ValueError(f"maps of {DEEPEST} levels: ids repeat")


def merge_maps(base: DataFrame, other: DataFrame, near=None, least: float = LEAST) -> DataFrame:
    """base with other's nodes that it lacks: map_id, node_id, parent_id, ord, type, text, sources.

    near: a table (map_id, o_node, b_node, near), or a function that adds near to pairs, as ``alike_vectors`` gives.
    """
    met = _met(base, other, near if near is not None else alike_texts(base, other), least)
    new = other.join(met.select("map_id", F.col("o_node").alias("node_id")), ["map_id", "node_id"], "left_anti")
    placed = new.join(met.select("map_id", F.col("o_node").alias("parent_id"), "b_node"), ["map_id", "parent_id"], "left")
    placed = placed.withColumn("parent_id", F.coalesce("b_node", "parent_id")).withColumn("ord", F.col("ord") + 1_000_000)
    both = base.join(met.select("map_id", F.col("b_node").alias("node_id"), F.lit(True).alias("twice")), ["map_id", "node_id"], "left")
    return both.select(*COLUMNS, F.when(F.col("twice"), F.array(F.lit("base"), F.lit("other"))).otherwise(F.array(F.lit("base"))).alias("sources")).unionByName(
        placed.select(*COLUMNS, F.array(F.lit("other")).alias("sources"))
    )


def merged_notes(base: Column, incoming: Column) -> Column:
    """Notes one below the other; what is said already is not said again."""
    new = (F.length(F.coalesce(incoming, F.lit(""))) > 0) & ~F.contains(F.coalesce(base, F.lit("")), incoming)
    return F.when(~F.coalesce(new, F.lit(False)), base).otherwise(F.concat_ws("\n\n", F.when(F.length(base) > 0, base), incoming))


def merged_links(base: Column, incoming: Column) -> Column:
    """Arrays of structs with a url: base's, and those of the incoming ones whose url it lacks."""
    base = F.coalesce(base, F.filter(incoming, lambda x: F.lit(False)))
    more = F.filter(incoming, lambda x: ~F.exists(base, lambda y: y["url"].eqNullSafe(x["url"])))
    return F.coalesce(F.concat(base, more), base)


def merged_tones(base: Column, incoming: Column) -> Column:
    """Both in order, each once, the first TONES."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(base, none), F.coalesce(incoming, none))), 1, TONES)


def merged_edges(base: DataFrame, other: DataFrame) -> DataFrame:
    """Edges (map_id, edge_id, ...) of base, and other's whose id base lacks."""
    return base.unionByName(other.join(base.select("map_id", "edge_id"), ["map_id", "edge_id"], "left_anti"))
