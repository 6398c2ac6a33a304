"""Rank and communities of weighted undirected graphs, as iterated joins."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

DAMPING = 0.85


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with each edge in both directions."""
    return edges.select("a", "b", "weight").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def pagerank(edges: DataFrame, rounds: int, every: int = 5) -> DataFrame:
    """(v, rank) after so many rounds; lineage is cut every few rounds."""
    both = both_ways(edges)
    out = both.groupBy("a").agg(F.sum("weight").alias("total"))
    shares = cut(both.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share")))
    vertices = shares.select(F.col("a").alias("v")).distinct()
    n = vertices.count()
    ranks = vertices.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        given = shares.join(ranks, F.col("a") == F.col("v")).groupBy(F.col("b").alias("v")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        ranks = vertices.join(given, "v", "left").select("v", (F.lit((1 - DAMPING) / n) + F.lit(DAMPING) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % every == every - 1:
            ranks = cut(ranks)
    return ranks


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(v, community) by label propagation: each vertex takes the label that weighs most around it, the least of equals."""
    both = both_ways(edges).where("a <> b")
    labels = both.select(F.col("a").alias("v")).distinct().withColumn("community", F.col("v"))
    for _ in range(rounds):
        around = both.join(labels, F.col("b") == F.col("v")).groupBy("a", "community").agg(F.sum("weight").alias("weight"))
        new = around.groupBy("a").agg(F.min_by("community", F.struct(-F.col("weight"), "community")).alias("community"))
        new = cut(new.withColumnRenamed("a", "v"))
        if new.join(labels, ["v", "community"], "left_anti").isEmpty():
            return new
        labels = new
    return labels


#: Edges of a graph that one task finishes by itself.
ONE_TASK = 20_000
#: Sweeps of a level at most; turns of a sweep; the least gain in modularity that is worth another sweep or level.
SWEEPS, TURNS, GAIN = 6, 3, 1e-4


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of labels (v, community): weight within communities, less what chance would put there."""
    both = both_ways(edges)
    own, other = labels.select(F.col("v").alias("a"), F.col("community").alias("ca")), labels.select(F.col("v").alias("b"), F.col("community").alias("cb"))
    joined = both.join(own, "a").join(other, "b")
    by = joined.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("within"), F.sum("weight").alias("total"))
    inside, square, total = by.agg(F.sum("within"), F.sum(F.col("total") * F.col("total")), F.sum("total")).first()
    return 0.0 if not total else inside / total - square / (total * total)


def _moved(ends: DataFrame, degree: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """(v, community) after the vertices whose turn it is have gone to the neighbouring community that gains most, if one gains. Few are
    asked at a time, so that neighbours don't just change places."""
    held = degree.join(labels, "v")
    sizes = held.groupBy("community").agg(F.sum("degree").alias("size"))
    mine = lambda c: F.pmod(F.xxhash64(F.lit(turn // TURNS), c), F.lit(TURNS)) == turn % TURNS
    around = ends.where(mine("a")).join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"), "community").agg(F.sum("weight").alias("weight"))
    asked = held.where(mine("v")).select("v", "degree", F.col("community").alias("own"))
    # a vertex may stay where nobody is its neighbour
    choices = around.unionByName(asked.select("v", F.col("own").alias("community"), F.lit(0.0).alias("weight"))).groupBy("v", "community").agg(F.sum("weight").alias("weight"))
    judged = choices.join(asked, "v").join(sizes, "community")
    here = F.col("community") == F.col("own")
    gain = F.col("weight") - F.col("degree") * (F.col("size") - F.when(here, F.col("degree")).otherwise(0.0)) / F.lit(total)
    best = judged.groupBy("v").agg(
        F.max_by(F.struct("community", gain.alias("gain")), F.struct(F.round(gain, 12), (-F.col("community")).alias("low"))).alias("best"), F.max(F.when(here, gain)).alias("stay")
    )
    goes = best.where(F.col("best.gain") > F.col("stay") + 1e-12).select("v", F.col("best.community").alias("to"))
    return labels.join(goes, "v", "left").select("v", F.coalesce("to", "community").alias("community"))


def joined_greedily(a: list[int], b: list[int], weight: list[float]) -> dict[int, int]:
    """Community of each vertex of a small graph: the two communities whose union gains most are joined until none gains."""
    around: dict[int, dict[int, float]] = {}
    for x, y, w in zip(a, b, weight, strict=True):
        around.setdefault(x, {}).setdefault(y, 0.0)
        around.setdefault(y, {}).setdefault(x, 0.0)
        around[x][y] += w
        if x != y:
            around[y][x] += w
    size = {v: sum(near.values()) for v, near in around.items()}
    total = sum(size.values())
    gain = lambda x, y: around[x][y] - size[x] * size[y] / total
    heap = [(-gain(x, y), x, y) for x, near in around.items() for y in near if x < y]
    heapq.heapify(heap)
    of = {v: v for v in around}
    members = {v: [v] for v in around}
    while heap:
        low, x, y = heapq.heappop(heap)
        if x not in members or y not in members or y not in around[x] or -gain(x, y) != low:
            continue  # of communities that are no more, or a gain that has changed
        if low >= -1e-12:
            break
        for z, w in around.pop(y).items():
            if z not in (x, y):  # what lies within a community says nothing about its gains
                around[z].pop(y)
                around[x][z] = around[z][x] = around[x].get(z, 0.0) + w
        around[x].pop(y)
        size[x] += size.pop(y)
        members[x] += members.pop(y)
        for z in around[x]:
            if z != x:
                heapq.heappush(heap, (-gain(*sorted((x, z))), *sorted((x, z))))
    for name, own in members.items():
        of.update(dict.fromkeys(own, min(own)))
    return of


def _in_one_task(graph: DataFrame) -> DataFrame:
    def run(own):
        import pyarrow as pa

        of = joined_greedily(*(own.column(c).to_pylist() for c in ("a", "b", "weight")))
        return pa.table({"v": pa.array(list(of), pa.int64()), "community": pa.array(list(of.values()), pa.int64())})

    ship(graph.sparkSession)
    rows = graph.select(F.col("a").cast("long"), F.col("b").cast("long"), "weight")
    return rows.groupBy(F.lit(0).alias("all")).applyInArrow(run, "v long, community long")


def modular_communities(edges: DataFrame, levels: int = 20, one_task: int = ONE_TASK) -> DataFrame:
    """(v, community) with high modularity; a community's name is its least vertex. Level by level: vertices move to the neighbouring
    community that gains most while modularity grows, then every community becomes a vertex of the next level's graph, whose edges are the sums
    of those between. Moves are joins and group sums over edges and vertices. What has one_task edges or fewer is finished by one task, which joins
    the two communities that gain most until none gains.

    edges: a, b (whole numbers), weight above 0; parallel edges are summed, loops count within their community.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    graph = cut(edges.select(*ends, F.col("weight").cast("double").alias("weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    found = cut(graph.select(F.col("a").alias("v")).union(graph.select(F.col("b"))).distinct().withColumn("community", F.col("v")))
    for _ in range(levels):
        if graph.count() <= one_task:
            own = _in_one_task(graph).withColumnsRenamed({"v": "c", "community": "joined"})
            last = cut(found.join(own, F.col("community") == F.col("c")).select("v", "joined"))
            return last.join(last.groupBy("joined").agg(F.min("v").alias("community")), "joined").select("v", "community")
        both = both_ways(graph)
        # a loop has both of its ends at its vertex, as the sum of what two edges' ends would be
        degree = cut(both.groupBy(F.col("a").alias("v")).agg(F.sum("weight").alias("degree")))
        total = degree.agg(F.sum("degree")).first()[0] or 0.0
        labels = degree.select("v", F.col("v").alias("community"))
        start = best = modularity(graph, labels)
        now, apart = labels, cut(both.where("a <> b"))
        for sweep in range(SWEEPS):
            for turn in range(TURNS):
                now = cut(_moved(apart, degree, now, total, sweep * TURNS + turn))
            value = modularity(graph, now)
            if value <= best + GAIN:
                break
            best, labels = value, now
        if best <= start + GAIN:
            return found
        names = labels.groupBy("community").agg(F.min("v").alias("name"))
        labels = cut(labels.join(names, "community").select("v", F.col("name").alias("community")))
        found = cut(found.withColumnRenamed("community", "c").join(labels.withColumnRenamed("v", "c"), "c").select("v", "community"))
        a, b = labels.select(F.col("v").alias("a"), F.col("community").alias("ca")), labels.select(F.col("v").alias("b"), F.col("community").alias("cb"))
        placed = graph.join(a, "a").join(b, "b")
        # between two vertices of one community an edge is counted from both of its ends
        weight = F.when((F.col("ca") == F.col("cb")) & (F.col("a") != F.col("b")), 2 * F.col("weight")).otherwise(F.col("weight"))
        graph = cut(placed.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum(weight).alias("weight")))
    return found
