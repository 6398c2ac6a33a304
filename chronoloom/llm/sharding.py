"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. Every shard owns ``vnodes`` of them; a row's key hashes to a cell and belongs to the next
virtual node clockwise. A shard takes at most its bound of rows; what arrives at a full shard continues clockwise to the next
virtual node, round by round, until it finds room. Keys of one cell behave alike, so the walk runs on counts per cell: its
size depends on the ring, never on the data. Rows then only need their rank within a cell, which is one thin shuffle of what
tells them apart: key, size and checksum, with a count of the rows that agree in these, so where rows lie plays no part.

Defined cases: a null key is a key like any other; a null text has 0 bytes; repeated rows are separate rows and each gets a
slot of its own; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Cells of the ring, and with it the bound of everything that reaches the driver or is broadcast.
CELLS = 1 << 16
#: A cell with more than a 256th of all rows (and at least so many) is numbered in up to HOT_SUBS parts.
HOT_SHARE, HOT_LEAST, HOT_SUBS = 256, 1024, 256
#: Alike rows that are made anew at a time.
RUN = 4096


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells of the virtual nodes and their shards. Shard s has the same cells for any number of shards above it."""
    owner: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % CELLS
            while cell in owner:
                cell = (cell + 1) % CELLS
            owner[cell] = s
    cells = np.array(sorted(owner), dtype=np.int64)
    return cells, np.array([owner[c] for c in cells.tolist()], dtype=np.int64)


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: without slack they sum to the rows exactly, so counts are at most one apart."""
    if slack > 0:
        return [int(np.ceil(rows * (1 + slack) / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(arcs: list[int], owner: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc the (shard, rows) that its rows go to, in order. All arrivals of a round come before those of the next."""
    room, taken = list(room), [[] for _ in arcs]
    waiting = [[(v, n)] if n else [] for v, n in enumerate(arcs)]
    while any(waiting):
        onward: list[list[tuple[int, int]]] = [[] for _ in arcs]
        for v, arrivals in enumerate(waiting):
            s = owner[v]
            for origin, n in arrivals:
                if (k := min(n, room[s])) > 0:
                    taken[origin].append((s, k))
                    room[s] -= k
                if n > k:
                    onward[(v + 1) % len(arcs)].append((origin, n - k))
        waiting = onward
    return taken


def placements(units: list[tuple[int, int, int]], shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, sub, first rank, end rank, shard, first slot) from the (cell, sub, rows) of the table."""
    cells, owner = ring(shards, vnodes)
    arcs: list[list[tuple[int, int, int]]] = [[] for _ in cells]
    for cell, sub, n in sorted(units):
        arcs[int(np.searchsorted(cells, cell)) % len(cells)].append((cell, sub, n))
    for own in arcs[:1]:  # the first arc goes over the end of the ring: clockwise its high cells come first
        own.sort(key=lambda u: (u[0] <= cells[0], u))
    sizes = [sum(n for _, _, n in own) for own in arcs]
    used, out = [0] * shards, []
    for own, parts in zip(arcs, walk(sizes, owner.tolist(), bounds(sum(sizes), shards, slack)), strict=True):
        left = list(parts)
        for cell, sub, n in own:
            at = 0
            while at < n:
                s, k = left[0]
                step = min(k, n - at)
                out.append((cell, sub, at, at + step, s, used[s]))
                used[s] += step
                at += step
                left[0] = (s, k - step)
                if step == k:
                    left.pop(0)
    return out


def assign(docs: DataFrame, *, shards: int, vnodes: int = 128, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row. slack: how far a shard may go over the mean, as a share of it."""
    spark = docs.sparkSession
    h = F.xxhash64(F.col(key))
    thin = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        h.alias("h"),
    )
    # rows that agree in all of this are alike: they are counted, and a count is what the walk needs
    alike = cut(thin.groupBy("key", "size", "text_crc32", "h").agg(F.count("*").alias("n")))
    cell, part = F.shiftrightunsigned("h", 48).cast("int"), F.pmod(F.xxhash64("key", "size", "text_crc32", F.lit(3)), F.lit(HOT_SUBS)).cast("int")
    alike = alike.withColumn("cell", cell).withColumn("part", part)
    counts = {r.cell: r.n for r in alike.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # CELLS rows at most
    rows = sum(counts.values())
    hot = sorted(c for c, n in counts.items() if n > max(HOT_LEAST, rows // HOT_SHARE))  # fewer than HOT_SHARE
    sub = F.when(F.col("cell").isin(hot), F.col("part")).otherwise(F.lit(0)) if hot else F.lit(0)
    units = [(c, 0, n) for c, n in counts.items() if c not in set(hot)]
    if hot:
        split = alike.where(F.col("cell").isin(hot)).groupBy("cell", "part").agg(F.sum("n").alias("n"))
        units += [(r.cell, r.part, r.n) for r in split.collect()]  # HOT_SHARE * HOT_SUBS rows at most
    places = spark.createDataFrame(
        placements(units, shards, vnodes, slack) or [(-1, 0, 0, 0, 0, 0)], "cell int, sub int, low long, high long, shard int, first long"
    )
    order = Window.partitionBy("cell", "sub").orderBy("h", "key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("sub", sub.cast("int")).withColumn("begin", F.coalesce(F.sum("n").over(order), F.lit(0)))
    # places: a row for each unit and for each place where an arc is split, both bounded by the ring
    held = ranked.join(F.broadcast(places), ["cell", "sub"]).where((F.col("begin") < F.col("high")) & (F.col("begin") + F.col("n") > F.col("low")))
    begin, end = F.greatest("begin", "low"), F.least(F.col("begin") + F.col("n"), F.col("high"))
    held = held.select("key", "size", "text_crc32", "shard", (F.col("first") + begin - F.col("low")).alias("slot"), (end - begin).alias("rows"))
    # as many rows again as were counted, RUN at a time, so that a row that repeats without end is not one task's
    runs = held.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / RUN)))).repartition("shard", "slot", "run")
    last = F.least(F.col("rows"), (F.col("run") + 1) * RUN) - 1
    return runs.withColumn("k", F.explode(F.sequence(F.col("run") * RUN, last))).select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("slot") + F.col("k")).alias("slot"))


def op1_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23. The bound has no slack, so the law that holds is ``rows``."""
    return assign(table(spark, sf_dir, "documents"), shards=24, vnodes=128, slack=0.0).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
