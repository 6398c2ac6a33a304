"""Exact similarity join of shingle sets under the Jaccard distance, which is a metric.

1. Equal sets are one point (128-bit digests). All further work is on points.
2. Most points are isolated, and a count proves it: of a linked set at most (100 - percent) % of the elements are missing in
   the other. Shingles of a hash range are counted over the table; a point that owns more of them alone than may be missing
   links with nothing. Every range gives a proof; a wider one proves more.
3. The rest are gathered in clusters that no link can leave, which is what keeps points without a common shingle (at distance 1
   from each other and from every pivot) apart: sets of nearly the same size are cut by the shingles' hashes into more parts
   than the elements in which two linked sets can differ, so linked sets have equal parts, and at least a known number of them.
4. Every cluster, of two points or of millions, is joined by pivots. A point within the link distance t of a pivot is linked with it
   and belongs to the Voronoi region of its nearest pivot. A region reaches as far as its farthest point; the triangle inequality
   asks for the points within t of that, which are copied to it as its boundary, and of the region's own points for those
   whose distance from the pivot differs by at most t. Points within t of no pivot are joined among themselves, recursively,
   with other pivots. A region's own points need no comparison with each other: they are linked through the pivot.
5. Large clusters take a round at a time over the cluster (blocks of points meet the pivots; blocks of a region meet blocks of
   its boundary), and small ones all rounds in one task. Rounds go on as long as they shed a quarter of the points; what they can't shed
   after ROUNDS is joined in pairs of blocks.
6. Links are tied together by connected components.

Every task holds a bounded number of points, whatever the size of a group. The result is exact for any data.

Defined cases: a text without words, or a null one, has an empty set and is linked with nothing; a null key is a key, and a group
whose keys are all null has a null component; repeated rows are copies; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mix64, ship, slices, table, text_buffer, tidy, written
from ..operators.components import components
from .shingles import shingle_sets

#: Points and elements of a cluster that one task joins; pivots of a round; rounds at least before blocks; the share of the points that a
#: round may leave for the next one to be worth it.
POINTS, ELEMENTS, PIVOTS, ROUNDS, SHED = 1024, 1 << 21, 8, 3, 0.75
#: Points of a part up to which its pairs are counted; classes and equal parts in a tag.
FEW, TAG = 16, 1 << 16
#: Rows of the smaller side up to which it is broadcast; points that a task of small clusters takes.
SMALL, TASK = 1 << 20, 2048
EPS = 1e-9


def size_classes(percent: int, top: int = 1 << 40) -> np.ndarray:
    """First sizes of the classes: sets that can link are in the same class or in neighbouring ones."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, dtype=np.int64)


def most_apart(classes: np.ndarray, c: int, percent: int) -> int:
    """Most elements in which a set of class c and a linked set at least as large can differ."""
    n = int(classes[c + 1]) - 1
    m = min(int(classes[c + 2]) - 1, n * 100 // percent)
    # of the union's elements, (100 - percent) % at most are not shared; union <= 100 (n + m) / (100 + percent)
    return (100 - percent) * (n + m) // (100 + percent)


def spare(apart: int) -> int:
    """Parts beyond those that may differ: linked sets share one more than this, where all of them hold something."""
    return 2 + apart // 8


def part_values(own: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A value for every part of the set that holds something, for its own size class and the one below, and the part's tag.

    A tag is the class times TAG plus the equal parts that a linked set must show: 1 + spare, less this set's empty parts, which
    have no value. Where parts that hold something are not more than those that may differ, the empty ones have values too: two
    linked sets that differ in each part that holds something share an empty one.
    """
    n = len(own)
    c = int(np.searchsorted(classes, n, side="right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(own))])
    out, tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for k in (c, c - 1):
        if k < 0 or (apart := most_apart(classes, k, percent)) == 0:
            continue  # only equal sets link, and they are one point
        parts = apart + 1 + spare(apart)
        at = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending, as own is
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        held, value = at[first], sums[np.concatenate([first[1:], [n]])] - sums[first]
        must = max(1, 1 + spare(apart) - (parts - len(held)))
        if len(held) <= apart:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), held)
            held, value = np.concatenate([held, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
        seed = held * np.uint64(0x9E3779B97F4A7C15) + np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        out.append(mix64(value ^ mix64(seed)))
        tags.append(np.full(len(held), k * TAG + min(must, TAG - 1), dtype=np.int32))
    return np.concatenate(out), np.concatenate(tags)


def linked(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


class Sets:
    """Some sets, with a code for each of their elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.heads = np.concatenate([[0], np.cumsum(self.sizes)])
        kinds, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(kinds), dtype=bool)

    def own(self, x: int) -> np.ndarray:
        return self.codes[self.heads[x] : self.heads[x + 1]]

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Elements that set x shares with each of the others."""
        if not len(others):
            return np.zeros(0, dtype=np.int64)
        self.mark[self.own(x)] = True
        if len(others) == len(self.sizes):
            hit = np.add.reduceat(self.mark[self.codes], self.heads[:-1], dtype=np.int64)
        else:
            hit = np.array([np.count_nonzero(self.mark[self.own(y)]) for y in others.tolist()], dtype=np.int64)
        self.mark[self.own(x)] = False
        return hit

    def distances(self, x: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The distance of set x from each of the others, and whether they are linked."""
        n, m, hit = self.sizes[x], self.sizes[others], self.shared(x, others)
        return 1 - hit / (n + m - hit), linked(hit, n, m, percent)


def within(held: Sets, x: int, own: np.ndarray, far_x: np.ndarray, far_own: np.ndarray, percent: int) -> int:
    """The first of own that is linked with x, or -1. far_x, far_own: distances from the pivots; by the triangle inequality
    those that differ by more than the link distance are not compared."""
    apart = np.abs(far_own - far_x[:, None]).max(axis=0)
    for y in own[apart <= 1 - percent / 100 + EPS].tolist():
        if held.distances(x, np.array([y]), percent)[1][0]:
            return y
    return -1


def join_points(ids: list[int], sets: list[np.ndarray], percent: int, pivots: int = PIVOTS) -> list[tuple[int, int]]:
    """Links that join the same points as all links of the cluster do, by pivots and Voronoi regions."""
    if len(ids) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if linked(shared, len(sets[0]), len(sets[1]), percent) else []
    held, t = Sets(sets), 1 - percent / 100 + EPS
    label, out = np.arange(len(ids)), []

    def tie(x: int, y: int) -> None:
        if label[x] != label[y]:
            out.append((ids[x], ids[y]))
            label[label == label[y]] = label[x]

    active = np.arange(len(ids))
    while len(active) > 1:
        k = min(pivots, 1 + len(active) // 32)
        both = [held.distances(int(p), active, percent) for p in active[:k]]
        far, near = np.stack([b[0] for b in both]), np.stack([b[1] for b in both])
        for p, x in np.argwhere(near).tolist():
            tie(int(active[p]), int(active[x]))
        others = np.arange(len(active)) >= k
        nearest, owned = far.argmin(axis=0), near.any(axis=0)
        for p in range(k):
            own = np.flatnonzero(owned & others & (nearest == p))
            if not len(own) or label[active].min() == label[active].max():
                continue
            boundary = np.flatnonzero(others & ~near[p] & (far[p] <= far[p, own].max() + t))
            for x in boundary.tolist():
                if label[active[x]] != label[active[own[0]]] and (y := within(held, int(active[x]), active[own], far[:, x], far[:, own], percent)) >= 0:
                    tie(int(active[x]), y)
        active = active[others & ~owned]
    return out


def _digests(sets: list[np.ndarray]) -> list[np.ndarray]:
    """A 128-bit digest of each set, in two halves."""
    import xxhash

    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
    return [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]


def _points(texts: DataFrame, size: int, percent: int = 80) -> DataFrame:
    """(key, n, m, a, b) of every text. m: shingles in the range that is counted for that percentage. a, b: a digest of the set."""
    kind, below = texts.schema["key"].dataType.simpleString(), np.uint64(_range_of(percent))

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            sets = shingle_sets(*text_buffer(batch.column(1)), size)
            n, m = [len(s) for s in sets], [int(np.searchsorted(s, below)) for s in sets]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), *map(pa.array, _digests(sets))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "m", "a", "b"])

    return texts.mapInArrow(run, f"key {kind}, n long, m long, a long, b long")


def _range_of(percent: int) -> int:
    """The shingles below this value are counted: half as many again as may be missing, so that points without a near one are
    proved so with few exceptions."""
    return min((1 << 64) - 1, (1 << 64) * 3 * (100 - percent) // 200)


#: Counted shingles that a task packs at a time, and that a part has; the bytes of each that are kept.
PACKED, KEPT = 1 << 20, 5


def _sampled(texts: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """(part, shingles, owners): the shingles in the range by parts of it, KEPT bytes of each, and the first half of their set's digest.

    Two shingles that agree in a part and these bytes count as one, which makes points pass for less alone than they are, never for more.
    """
    below = _range_of(percent)

    def packed(sets, owners):
        import pyarrow as pa

        flat, owner = np.concatenate(sets), np.repeat(np.array(owners, np.int64), [len(s) for s in sets])
        part = np.minimum((flat >> np.uint64(32)) * np.uint64(parts) // np.uint64((below >> 32) + 1), np.uint64(parts - 1)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        flat, owner, part = flat[order], owner[order], part[order]
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        low = np.ascontiguousarray(flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT])
        spans = list(zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True))
        columns = [pa.array(part[heads[:-1]]), pa.array([low[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([owner[i:j].tobytes() for i, j in spans], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "shingles", "owners"])

    def run(batches):
        held, owners, waiting, seen = [], [], 0, set()
        for batch in slices(batches, 0):
            sets = [s for s in shingle_sets(*text_buffer(batch.column(0)), size) if len(s)]
            if not sets:
                continue
            for s, a, b in zip(sets, *(d.tolist() for d in _digests(sets)), strict=True):
                if (a, b) not in seen and (own := s[: np.searchsorted(s, np.uint64(below))]).size:
                    seen.add((a, b))  # copies are one point
                    held.append(own.copy())
                    owners.append(a)
                    waiting += len(own)
            if waiting >= PACKED:
                yield packed(held, owners)
                held, owners, waiting, seen = [], [], 0, set()
        if held:
            yield packed(held, owners)

    return texts.select("text").mapInArrow(run, "part int, shingles binary, owners binary")


def _shared(sampled: DataFrame) -> DataFrame:
    """(a, shared): how many of a set's counted shingles stand in another set too. Those that stand in one set alone, which are most, are not told."""

    def run(own):
        import pyarrow as pa

        low = np.frombuffer(b"".join(own.column("shingles").to_pylist()), np.uint8).reshape(-1, KEPT)
        owner = np.frombuffer(b"".join(own.column("owners").to_pylist()), np.int64)
        value = np.zeros(len(low), np.uint64)
        for k in range(KEPT):
            value |= low[:, k].astype(np.uint64) << np.uint64(8 * k)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        heads = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        apart = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
        told = np.repeat(apart, np.diff(np.concatenate([heads, [len(value)]])))
        # a set that came from several tasks counts once for a shingle
        both = np.unique(np.stack([owner[told], value[told].view(np.int64)], axis=1), axis=0) if told.any() else np.zeros((0, 2), np.int64)
        names, n = np.unique(both[:, 0], return_counts=True)
        return pa.table({"a": pa.array(names, pa.int64()), "shared": pa.array(n, pa.int64())})

    return sampled.groupBy("part").applyInArrow(run, "a long, shared long").groupBy("a").agg(F.sum("shared").alias("shared"))


def _not_isolated(texts: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(point, key, a, b): the points that may have links. point is a number of its own.

    Two points could pass for one here only if the halves of their digests agreed; that matters if they are linked besides.
    """
    counted = rows.agg(F.sum("m")).first()[0] or 0
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-counted // (4 * PACKED)))
    shared = _shared(_sampled(texts, size, percent, parts).repartition(parts, "part"))
    points = rows.where("n > 0").groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.min("key").alias("key"))
    some = points.join(shared, "a", "left").where(100 * (F.col("m") - F.coalesce("shared", F.lit(0))) <= (100 - percent) * F.col("n"))
    return cut(some.select(F.monotonically_increasing_id().alias("point"), "key", "a", "b"))


def _sets(texts: DataFrame, some: DataFrame, size: int) -> DataFrame:
    """(point, set) of the points."""
    some = some.withColumnRenamed("key", "chosen")
    some = F.broadcast(some) if some.count() <= SMALL else some
    chosen = texts.join(some, F.col("key").eqNullSafe(F.col("chosen"))).select("text", "point", "a", "b")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 0):
            sets = shingle_sets(*text_buffer(batch.column(0)), size)
            a, b = _digests(sets)
            keep = (a == batch.column(2).to_numpy()) & (b == batch.column(3).to_numpy())  # a key may have other texts
            held = pa.array([s.tobytes() for s, k in zip(sets, keep.tolist(), strict=True) if k], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(keep)), held], names=["point", "set"])

    sets = written(chosen.mapInArrow(run, "point long, set binary"))
    if sets.groupBy("point").count().where("count > 1").isEmpty():
        return sets
    return written(sets.dropDuplicates(["point"]))  # rows that repeat under one key


def _parts(sets: DataFrame, percent: int) -> DataFrame:
    """(part, point, tag) of the parts of every point."""
    classes = size_classes(percent)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            both = [part_values(np.frombuffer(s, dtype=np.uint64), classes, percent) for s in batch.column(1).to_pylist()]
            flat = np.concatenate([*(v for v, _ in both), np.zeros(0, np.uint64)])
            tags = np.concatenate([*(t for _, t in both), np.zeros(0, np.int32)])
            points = np.repeat(batch.column(0).to_numpy(), [len(v) for v, _ in both])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(points), pa.array(tags)], names=["part", "point", "tag"])

    return sets.select("point", "set").mapInArrow(run, "part long, point long, tag int")


def clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(point, region): points that can be linked share a region.

    Parts of up to FEW points: two points that share as many parts as linked ones must are tied. Parts of more points: the points are
    tied to the least of them. A pair's missing parts may be among those, so the parts that a point has there count for it.
    """
    some = written(_parts(sets, percent))
    groups = some.groupBy("part").agg(F.count("*").alias("m"), F.min("point").alias("least")).where("m > 1")
    held = some.join(groups, "part").withColumn("class", F.floor(F.col("tag") / TAG).cast("int")).withColumn("must", (F.col("tag") % TAG).cast("int"))
    held = written(held.drop("tag"))
    many = held.where(F.col("m") > FEW)
    wide = many.groupBy("point", "class").agg(F.count("*").alias("wide"))
    few = held.where(F.col("m") <= FEW).select("part", "point", "class", "must")
    a = few.withColumnsRenamed({"point": "a", "must": "must_a"})
    b = few.select("part", F.col("point").alias("b"), F.col("must").alias("must_b"))
    pairs = a.join(b, "part").where("a < b").groupBy("a", "b", "class").agg(F.count("*").alias("shared"), F.max(F.greatest("must_a", "must_b")).alias("must"))
    for end in ("a", "b"):
        pairs = pairs.join(wide.withColumnsRenamed({"point": end, "wide": f"wide_{end}"}), [end, "class"], "left")
    need = F.col("must") - F.least(F.coalesce("wide_a", F.lit(0)), F.coalesce("wide_b", F.lit(0)))
    ties = many.select(F.col("least").alias("a"), F.col("point").alias("b")).distinct()
    found = components(pairs.where(F.col("shared") >= need).select("a", "b").unionByName(ties))
    return found.select(F.col("v").alias("point"), F.col("component").alias("region"))


_LINKS = "a long, b long"


def _link_table(links: list[tuple[int, int]]):
    import pyarrow as pa

    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(s, dtype=np.uint64) for s in column.to_pylist()]


def _joined(members: DataFrame, percent: int, pivots: int) -> DataFrame:
    """Links of regions that fit a task; a task takes several, of about TASK points and ELEMENTS elements together."""
    points, elements = members.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("set") / 8), F.lit(0))).first()
    n = max(1, -(-points // TASK), -(-int(elements) // ELEMENTS))

    def run(own):
        own = own.sort_by([("region", "ascending"), ("point", "ascending")])
        region, links = own.column("region").to_numpy(), []
        heads = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            part = own.slice(a, b - a)
            if b - a > 1:
                links += join_points(part.column("point").to_pylist(), _unpacked(part.column("set")), percent, pivots)
        return _link_table(links)

    return members.groupBy(F.pmod(F.xxhash64("region"), F.lit(n)).alias("task")).applyInArrow(run, _LINKS)


def _large(members: DataFrame, most: int) -> DataFrame:
    """(region, points, blocks) of the regions that do not fit a task."""
    sizes = members.groupBy("region").agg(F.count("*").alias("points"), F.sum(F.octet_length("set") / 8).alias("elements"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("points") / most), F.ceil(F.col("elements") / ELEMENTS)).cast("int"))
    return cut(sizes.where("blocks > 1").select("region", "points", "blocks"))


def _block(blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "point"), blocks).cast("int")


def _measured(members: DataFrame, sizes: DataFrame, percent: int, pivots: int, level: int) -> DataFrame:
    """region, point, set, far (distances from the pivots), links (pivots that it is linked with), pivot (its own number or -1).

    A task has a block of a region's points and the region's pivots.
    """
    sized = members.join(sizes, "region")
    drawn = F.pmod(F.xxhash64(F.lit(level), "point"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(4.0 * pivots) / F.col("points")
    first = Window.partitionBy("region").orderBy(F.xxhash64(F.lit(level + 100), "point"), "point")
    chosen = sized.where(drawn).withColumn("k", F.row_number().over(first) - 1).where(F.col("k") < pivots)  # about 4 * pivots rows a region
    centres = chosen.select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "k", "point", "set")
    rows = sized.select("region", _block(F.col("blocks"), level).alias("block"), F.lit(-1).alias("k"), "point", "set")

    def run(own):
        import pyarrow as pa

        own = own.sort_by([("k", "ascending"), ("point", "ascending")])
        k, point, packed = own.column("k").to_numpy(), own.column("point").to_numpy(), own.column("set")
        n, held = int((k < 0).sum()), Sets(_unpacked(packed))
        both = [held.distances(p, np.arange(len(k)), percent) for p in range(n, len(k))]
        far = [list(map(float, row)) for row in zip(*(b[0][:n] for b in both), strict=True)] or [[]] * n
        links = [list(map(int, np.flatnonzero(row))) for row in zip(*(b[1][:n] for b in both), strict=True)] or [[]] * n
        numbers = {int(p): int(j) for p, j in zip(point[n:], k[n:], strict=True)}
        return pa.table({
            "region": own.column("region").slice(0, n), "point": point[:n], "set": packed.slice(0, n), "far": pa.array(far, pa.list_(pa.float64())),
            "links": pa.array(links, pa.list_(pa.int32())), "pivot": pa.array([numbers.get(int(p), -1) for p in point[:n]], pa.int32()),
            "centres": pa.array([point[n:].tolist()] * n, pa.list_(pa.int64())),
        })

    schema = "region long, point long, set binary, far array<double>, links array<int>, pivot int, centres array<long>"
    return written(rows.unionByName(centres).repartition("region", "block").groupBy("region", "block").applyInArrow(run, schema))


def _pivot_classes(measured: DataFrame) -> DataFrame:
    """(region, classes): pivots that points tie together have one class. A region has 2 ** pivots kinds of ties at most."""

    def run(own):
        import pyarrow as pa

        lists = own.column("links").to_pylist()
        label = list(range(max(max(x) for x in lists) + 1))
        for x in lists:
            old = {label[j] for j in x}
            label = [min(old) if c in old else c for c in label]
        return pa.table({"region": own.column("region").slice(0, 1), "classes": pa.array([label], pa.list_(pa.int32()))})

    return cut(measured.where(F.size("links") > 0).select("region", "links").distinct().groupBy("region").applyInArrow(run, "region long, classes array<int>"))


def _boundaries(measured: DataFrame, classes: DataFrame, percent: int, most: int) -> DataFrame | None:
    """Links between a Voronoi region's own points and its boundary, if it has one; blocks of both meet."""
    far, links = F.col("far"), F.col("links")
    points = measured.where("pivot < 0").join(classes, "region")
    points = points.withColumn("mine", F.when(F.size("links") > 0, F.get("classes", F.get("links", F.lit(0)))))
    nearest = (F.array_position(far, F.array_min(far)) - 1).cast("int")
    owned = points.where(F.size(links) > 0).withColumn("cell", nearest)
    margin = 1 - percent / 100 + EPS
    reach = cut(owned.groupBy("region", "cell").agg((F.max(F.array_min(far)) + margin).alias("reach"), F.count("*").alias("n_own"), F.sum(F.octet_length("set") / 8).alias("e_own")))
    near = points.join(reach, "region").where((F.get("far", F.col("cell")) <= F.col("reach")) & ~F.array_contains("links", F.col("cell")))
    near = near.where(~F.get("classes", F.col("cell")).eqNullSafe(F.col("mine"))).select("region", "cell", "point", "set", "far")
    near = written(near)
    if near.isEmpty():
        return None
    counts = near.groupBy("region", "cell").agg(F.count("*").alias("n_near"), F.sum(F.octet_length("set") / 8).alias("e_near"))
    blocks = lambda n, e: F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(e) / ELEMENTS)).cast("int")
    shape = cut(counts.join(reach, ["region", "cell"]).select("region", "cell", blocks("n_own", "e_own").alias("rows"), blocks("n_near", "e_near").alias("columns")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = owned.join(shape, ["region", "cell"]).select("region", "cell", _block(F.col("rows"), 7).alias("i"), each("columns").alias("j"), F.lit(True).alias("own"), "point", "set", "far")
    right = near.join(shape, ["region", "cell"]).select("region", "cell", each("rows").alias("i"), _block(F.col("columns"), 8).alias("j"), F.lit(False).alias("own"), "point", "set", "far")

    def run(part):
        part = part.sort_by("point")
        is_own, point = part.column("own").to_numpy(zero_copy_only=False), part.column("point").to_numpy()
        own, links = np.flatnonzero(is_own), []
        if len(own) and len(own) < len(point):
            held, far = Sets(_unpacked(part.column("set"))), np.array(part.column("far").to_pylist()).T
            for x in np.flatnonzero(~is_own).tolist():
                if (y := within(held, x, own, far[:, x], far[:, own], percent)) >= 0:
                    links.append((int(point[x]), int(point[y])))
        return _link_table(links)

    return left.unionByName(right).repartition("region", "cell", "i", "j").groupBy("region", "cell", "i", "j").applyInArrow(run, _LINKS)


def _pairs_of_blocks(members: DataFrame, sizes: DataFrame, percent: int, pivots: int) -> DataFrame:
    """Every two points of a region meet, and a pair of blocks fits a task."""
    sized = members.join(sizes.select("region", F.col("blocks").alias("g")), "region")
    mine = _block(F.col("g"), 9)
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    rows = sized.select(F.explode(pairs).alias("pair"), "region", "point", "set")

    def run(own):
        own = own.sort_by("point")
        return _link_table(join_points(own.column("point").to_pylist(), _unpacked(own.column("set")), percent, pivots) if own.num_rows > 1 else [])

    return rows.select("region", "pair.i", "pair.j", "point", "set").repartition("region", "i", "j").groupBy("region", "i", "j").applyInArrow(run, _LINKS)


def region_links(members: DataFrame, *, percent: int, points: int = POINTS, pivots: int = PIVOTS, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) that join the same points as all links of each region do: members have region, point, set. Each step is cut off, so
    the driver plans one of them at a time."""
    links, now, before = [], members, 0
    for level in itertools.count():
        sizes = _large(now, points)
        left = sizes.agg(F.sum("points")).first()[0] or 0
        if not left:
            links.append(cut(_joined(now, percent, pivots)))
            break
        links.append(cut(_joined(now.join(sizes, "region", "left_anti"), percent, pivots)))
        now = now.join(sizes, "region", "left_semi").select("region", "point", "set")
        if level >= rounds and left > SHED * before:
            links.append(cut(_pairs_of_blocks(now, sizes, percent, pivots)))
            break
        before = left
        measured = _measured(now, sizes, percent, pivots, level)
        to_pivots = measured.select("point", F.explode(F.transform("links", lambda j: F.get("centres", j))).alias("pivot_point")).where("point <> pivot_point")
        links.append(to_pivots.select(F.col("point").alias("a"), F.col("pivot_point").alias("b")))
        if (boundary := _boundaries(measured, _pivot_classes(measured), percent, points)) is not None:
            links.append(cut(boundary))
        now = measured.where("pivot < 0 AND size(links) = 0").select("region", "point", "set")
    return functools.reduce(DataFrame.unionByName, links)


def near_copies(
    docs: DataFrame, *, size: int, percent: int, key: str = "doc_id", text: str = "text", points: int = POINTS, pivots: int = PIVOTS, rounds: int = ROUNDS
) -> DataFrame:
    """key, n_shingles, component_id (least key of those that links reach) of every row. A link: percent of the union is shared."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = cut(_points(texts, size, percent))
    some = _not_isolated(texts, rows, size, percent)
    tidy(spark)  # the counted shingles are the most that is shuffled; they go before the next step has its own
    sets = _sets(texts, some, size)
    tidy(spark)
    regions = cut(clusters(sets, percent))
    tidy(spark)
    regions = F.broadcast(regions) if regions.count() <= SMALL else regions
    members = sets.join(regions, "point").select("region", "point", "set")
    classes = components(region_links(members, percent=percent, points=points, pivots=pivots, rounds=rounds))
    # points that nothing is linked with are their own class and need no row
    named = some.join(classes, F.col("point") == F.col("v")).select("component", "key", "a", "b")
    heads = named.groupBy("component").agg(F.min("key").alias("component_id"))
    named = named.join(heads, "component").select("a", "b", F.lit(True).alias("joined"), "component_id")
    alone = rows.where("n > 0").groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("key").alias("least")).where("copies > 1").select("a", "b", "least")
    found = rows.join(named, ["a", "b"], "left").join(alone, ["a", "b"], "left")
    own = F.when(F.col("joined"), F.col("component_id")).when(F.col("n") == 0, F.col("key")).otherwise(F.coalesce("least", "key"))
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op3_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), size=3, percent=90)


SQL_OP3 = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(coalesce((SELECT min(b) FROM reach r WHERE r.a = s.doc_id), s.doc_id) AS BIGINT) AS component_id
FROM sets s
"""
