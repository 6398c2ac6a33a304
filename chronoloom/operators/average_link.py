"""Average-link clusters of a key's vectors by cosine distance, exact for any number of them.

The mean distance between two clusters of unit vectors is one less the product of their mean vectors, so a cluster is a sum and a count and
no matrix of distances is kept: a task holds CELLS of them. Average link never brings a third cluster nearer by a merge, so all pairs that are each other's nearest can be merged at
once, in rounds, and give the same tree as one merge at a time. Every two blocks of a key's clusters meet in a task, which gives each
cluster's nearest one, not the pairs; keys of a block or less are merged to the end in one task, which looks again only for the nearest ones of clusters that
were merged or whose nearest one was. The work is that of all pairs of a key in the
first round, and falls with the clusters that are left; vectors in a line, each nearer to the next than the last one, take a round for each merge.
Equal vectors are merged before the first round.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship, tidy
from .components import components
from .vectors import _rows

#: Clusters of a key that a task merges to the end, and clusters of a block; distances that a task holds at a time.
BLOCK, CELLS = 1 << 14, 1 << 20
#: Digits of a distance; beyond them the least ids decide.
DIGITS = 12


def _means(part) -> np.ndarray:
    return _rows(part.column("s")) / part.column("n").to_numpy()[:, None]


def _nearest(mean: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of rows the place of its nearest other one in columns, the first of equal ones, and how far it is; the same for each of
    columns among rows, of the same distances, which are made in slices of CELLS. rows and columns ascend."""
    at, low = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    back, back_low = np.zeros(len(columns), np.int64), np.full(len(columns), np.inf)
    others, step = np.ascontiguousarray(mean[columns].T), max(1, CELLS // max(1, len(columns)))
    for a in range(0, len(rows), step):
        own = rows[a : a + step]
        d = np.round(1 - mean[own] @ others, DIGITS)
        self_at = np.searchsorted(columns, own)
        here = np.flatnonzero((self_at < len(columns)) & (columns[np.minimum(self_at, len(columns) - 1)] == own))
        d[here, self_at[here]] = np.inf
        best = d.argmin(axis=1)
        at[a : a + step], low[a : a + step] = columns[best], d[np.arange(len(own)), best]
        best = d.argmin(axis=0)
        far = d[best, np.arange(len(columns))]
        less = far < back_low
        back[less], back_low[less] = own[best[less]], far[less]
    return at, low, back, back_low


def _pairs(held: DataFrame, sizes: DataFrame, key: str, block: int) -> DataFrame:
    """(key, a, b, height) of clusters that are each other's nearest."""
    parts = F.ceil(F.col("clusters") / block).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = held.join(sizes.withColumn("parts", parts), key).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "n", "s")
    kinds = {c: held.schema[c].dataType.simpleString() for c in (key, "id")}

    def meet(part):
        import pyarrow as pa

        part = part.sort_by("id")
        mine, mean = part.column("mine").to_numpy(), _means(part)
        within = part.column("i")[0].as_py() == part.column("j")[0].as_py()
        left = np.arange(len(mine)) if within else np.flatnonzero(mine == part.column("i")[0].as_py())
        right = left if within else np.flatnonzero(mine != part.column("i")[0].as_py())
        froms, tos, far = [], [], []
        if len(left) and len(right):
            at, low, back, back_low = _nearest(mean, left, right)
            sides = ((left, at, low), (right, back, back_low))
            if within:  # a distance may differ in its last digit from itself the other way
                sides = ((left, np.where(low < back_low, at, np.where(low > back_low, back, np.minimum(at, back))), np.minimum(low, back_low)),)
            for rows, places, lows in sides:
                ok = np.isfinite(lows)
                froms.append(rows[ok])
                tos.append(places[ok])
                far.append(lows[ok])
        froms, tos, far = (np.concatenate(x) if x else np.zeros(0) for x in (froms, tos, far))
        ids, take = part.column("id").combine_chunks(), lambda x: pa.array(x.astype(np.int64))
        keys = part.column(key).combine_chunks()
        return pa.table({key: keys.take(take(froms)), "a": ids.take(take(froms)), "b": ids.take(take(tos)), "height": pa.array(far, pa.float64())})

    schema = f"{key} {kinds[key]}, a {kinds['id']}, b {kinds['id']}, height double"
    found = dealt.groupBy(key, "i", "j").applyInArrow(meet, schema)
    near = cut(found.groupBy(key, "a").agg(F.min(F.struct("height", "b")).alias("m")).select(key, "a", F.col("m.b").alias("b"), F.col("m.height").alias("height")))
    back = near.select(key, F.col("a").alias("b"), F.col("b").alias("a"))
    return near.where("a < b").join(back, [key, "a", "b"])


def _merged(held: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The clusters after the merges: the second of a pair is added to the first."""
    gone = pairs.select(key, F.col("b").alias("id"))
    added = held.hint("merge").join(pairs.select(key, F.col("b").alias("id"), "a"), [key, "id"]).select(key, F.col("a").alias("id"), F.col("n").alias("more"), F.col("s").alias("t"))
    # vectors are taken for short arrays by the planner, and would be sent through the driver
    kept = held.join(gone, [key, "id"], "left_anti").join(added.hint("merge"), [key, "id"], "left")
    both = F.when(F.col("t").isNull(), F.col("s")).otherwise(F.zip_with("s", "t", lambda x, y: x + y))
    return kept.select(key, "id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), both.alias("s"))


def merges(rows: DataFrame, key: str, vector: str, *, block: int = BLOCK) -> DataFrame:
    """(key, a, b, height, n): every merge of the key's tree. b joins a, the lesser id, in a cluster of n rows; an id joins another once.

    rows: key, id (each once in a key), a vector. Rows with a null in one of these are left out. A vector of zeros is at distance 1 from all.
    """
    ship(rows.sparkSession)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, "id")}
    v = F.col(vector).cast("array<double>")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    there = rows.where(F.col(key).isNotNull() & F.col("id").isNotNull() & F.col(vector).isNotNull()).select(key, "id", v.alias("v")).withColumn("size", size)
    units = cut(there.select(key, "id", F.transform("v", lambda x: x / F.greatest(F.col("size"), F.lit(1e-12))).alias("s")))
    # equal vectors are merged first, all at once; zeros are not near each other
    alone = F.when(~F.exists("s", lambda x: x != 0), F.col("id")).alias("alone")
    held = cut(units.groupBy(key, "s", alone).agg(F.min("id").alias("id"), F.count("*").alias("n")).select(key, "id", "n", "s"))
    equal = held.where("n > 1").select(key, "s", "n", F.col("id").alias("a"))
    copies = units.join(equal.hint("merge"), [key, "s"]).where("id <> a").select(key, "a", F.col("id").alias("b"), F.lit(0.0).alias("height"), "n")
    schema = f"{key} {kinds[key]}, a {kinds['id']}, b {kinds['id']}, height double, n long"
    found = [cut(copies)]
    while True:
        sizes = cut(held.groupBy(key).agg(F.count("*").alias("clusters")).where(F.col("clusters") > block))
        if sizes.isEmpty():
            break
        big = held.join(sizes.select(key), key, "left_semi")
        pairs = cut(_pairs(big, sizes, key, block))
        held = cut(_merged(held, pairs, key))
        found.append(cut(pairs.join(held.select(key, F.col("id").alias("a"), "n"), [key, "a"]).select(key, "a", "b", "height", "n")))
        tidy(held.sparkSession)

    def finish(part):
        import pyarrow as pa

        part = part.sort_by("id")
        ids, n, out = part.column("id").to_pylist(), part.column("n").to_numpy().astype(np.float64), []
        s = _rows(part.column("s"))
        mean, alive = s / n[:, None], np.arange(len(ids))
        near, far = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        stale = alive
        while len(alive) > 1:
            # a merge brings no third cluster nearer, so the nearest one of the others stands
            near[stale], far[stale], *_ = _nearest(mean, stale, alive)
            first = alive[(near[near[alive]] == alive) & (alive < near[alive])]
            if not len(first):  # last digits that differ each way can leave no such pair
                a = alive[far[alive].argmin()]
                first = np.array([min(a, near[a])])
                far[first], near[first] = far[a], max(a, near[a])
            gone = near[first]
            n[first] += n[gone]
            s[first] += s[gone]
            mean[first] = s[first] / n[first, None]
            out += [(ids[a], ids[b], h, int(m)) for a, b, h, m in zip(first.tolist(), gone.tolist(), far[first].tolist(), n[first].tolist(), strict=True)]
            changed = np.zeros(len(ids), bool)
            changed[first] = changed[gone] = True
            alive = np.setdiff1d(alive, gone)
            stale = alive[changed[alive] | changed[near[alive]]]
        kind, own = part.schema.field("id").type, part.column(key).combine_chunks()
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((kind, kind, pa.float64(), pa.int64()))]
        return pa.table(dict(zip((key, "a", "b", "height", "n"), [own.slice(0, len(out)), *columns], strict=True)))

    found.append(cut(held.groupBy(key).applyInArrow(finish, schema)))
    return functools.reduce(DataFrame.unionByName, found)


def themes(rows: DataFrame, key: str, vector: str, *, most: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, id, theme): half as many average-link clusters as rows, two to ``most``; fewer than four rows are one. Themes are numbered
    from 0 by their least ids. Rows without a vector have no theme. Of merges at one distance, those of the least ids come first."""
    rows = rows.select(key, "id", vector)
    made = merges(rows, key, vector, block=block)
    sizes = rows.where(F.col(vector).isNotNull() & F.col("id").isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    wanted = F.when(F.col("rows") < 4, 1).otherwise(F.greatest(F.lit(2), F.least(F.floor(F.col("rows") / 2), F.lit(most))))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("height"), F.desc("n"), F.desc("a"), F.desc("b")))
    split = made.withColumn("last", last).where(F.col("last") < most).join(sizes.select(key, wanted.alias("wanted")), key).where("last < wanted")
    kept = made.join(split.select(key, "b"), [key, "b"], "left_anti")
    vertex = lambda c: F.struct(F.col(key).alias("k"), F.col(c).alias("x"))
    found = components(kept.select(vertex("a").alias("a"), vertex("b").alias("b")))
    heads = found.select(F.col("v.k").alias(key), F.col("v.x").alias("id"), F.col("component.x").alias("head"))
    held = cut(rows.join(heads, [key, "id"], "left").select(key, "id", F.when(F.col(vector).isNotNull() & F.col("id").isNotNull(), F.coalesce("head", "id")).alias("head")))
    order = F.row_number().over(Window.partitionBy(key).orderBy("head")) - 1
    numbers = held.where(F.col("head").isNotNull()).select(key, "head").distinct().withColumn("theme", order.cast("bigint"))
    return held.join(numbers, [key, "head"], "left").select(key, "id", "theme")
