"""Vector codes: product quantisation whose codebooks come from filtering Lloyd rounds.

Every component becomes floor(scale * x). Vectors are cut into equal consecutive parts, and each part has a codebook. A partition
reads its vectors in chunks of bounded size and builds, once, a kd-tree over each part of a chunk: boxes, sums and counts of all
nodes are written with the points. A Lloyd round walks the trees from the root with the entries that can still be the nearest one
somewhere in a node's box. An entry goes when another is nearer at the place of the box that favours it most; when one entry is
left, the whole subtree is its own, and the cached sum and count are added at once. Leaves compare their points with the entries
that are left. All of it is integer arithmetic, so the result is that of plain Lloyd rounds, ties included, however the rows lie.

What leaves a task in a round are sums and counts of the codebooks' entries; the driver holds codebooks only.

Defined cases: a vector that is null, or holds a null, NaN or infinite component, is left out; shorter vectors are filled up with
zeros to the longest one's length, and that to a multiple of the parts; components beyond LIMIT (before that: 32,768) are held
there, so that errors fit a long; fewer kept vectors than entries give as many entries; repeated rows count each; of equal keys
those with the least components start the codebooks first, null keys come last; null labels are one label; an empty table gives an
empty result; other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, ship, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bytes of a chunk's points; points of a leaf; pairs of node and entry that are tested at a time; largest component.
CHUNK, LEAF, PAIRS, LIMIT = 1 << 20, 32, 1 << 15, 1 << 25
#: A label with more than this share of the rows is broadcast with its sum; there are as many such labels at most.
HOT = 256


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x width."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def starts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: halves of halves."""
    return (n * np.arange((1 << level) + 1, dtype=np.int64)) >> level


def depth_of(n: int) -> int:
    return max(0, (max(n, 1) - 1) // LEAF).bit_length()


class Tree:
    """A kd-tree whose nodes are ranges of its points; boxes and sums by level, one after the other."""

    def __init__(self, points, order, low, high, total):
        self.points, self.order, self.low, self.high, self.total = points, order, low, high, total
        self.depth = depth_of(len(points))

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n = len(points)
        order = np.arange(n)
        for level in range(depth_of(n)):
            ends, middles = starts(n, level), starts(n, level + 1)[1::2]
            for a, m, b in zip(ends[:-1].tolist(), middles.tolist(), ends[1:].tolist(), strict=True):
                own = points[order[a:b]]
                widest = int(np.argmax(own.max(0) - own.min(0)))
                order[a:b] = order[a:b][np.argpartition(own[:, widest], m - a)]
        points = points[order]
        at = [starts(n, level)[:-1] for level in range(depth_of(n) + 1)]
        low, high = (np.concatenate([f.reduceat(points, a) for a in at]) for f in (np.minimum, np.maximum))
        return cls(points, order, low, high, np.concatenate([np.add.reduceat(points, a) for a in at]))

    def packed(self) -> bytes:
        return b"".join(x.astype(k).tobytes() for x, k in zip(self._fields(), self._kinds(), strict=True))

    def _fields(self):
        return self.points, self.order, self.low, self.high, self.total

    @staticmethod
    def _kinds():
        return "<i4", "<i4", "<i4", "<i4", "<i8"

    @classmethod
    def unpacked(cls, data: bytes, n: int, width: int) -> Tree:
        nodes, at, out = (2 << depth_of(n)) - 1, 0, []
        for shape, kind in zip([(n, width), (n,), (nodes, width), (nodes, width), (nodes, width)], cls._kinds(), strict=True):
            count = int(np.prod(shape))
            out.append(np.frombuffer(data, kind, count, at).reshape(shape).astype(np.int64))
            at += count * np.dtype(kind).itemsize
        return cls(*out)

    def settle(self, book: np.ndarray):
        """Pairs of an entry and what it owns: whole nodes as (level, nodes, entries), then points as (places, entries)."""
        n, k = len(self.points), len(book)
        nodes, alive, whole = np.zeros(1, np.int64), np.ones((1, k), bool), []
        for level in range(self.depth + 1):
            first = (1 << level) - 1
            low, high = self.low[first + nodes], self.high[first + nodes]
            best = _nearest(low + high, 2 * book, alive)  # any live entry would do: it decides how much is cut, not what is right
            node, entry = np.nonzero(alive)
            for a in range(0, len(node), PAIRS):
                i, j = node[a : a + PAIRS], entry[a : a + PAIRS]
                b = best[i]
                apart, both = book[j] - book[b], book[j] + book[b]
                gap = (apart * both).sum(1) - 2 * np.maximum(apart * low[i], apart * high[i]).sum(1)
                alive[i, j] = (gap < 0) | ((gap == 0) & (j <= b))
            one = alive.sum(1) == 1
            whole.append((level, nodes[one], best[one]))
            nodes, alive = nodes[~one], alive[~one]
            if level < self.depth:
                nodes, alive = np.repeat(2 * nodes, 2), np.repeat(alive, 2, axis=0)
                nodes[1::2] += 1
        ends = starts(n, self.depth)
        places = [np.arange(ends[x], ends[x + 1]) for x in nodes.tolist()]
        owners = [(live := np.flatnonzero(row))[_nearest(self.points[p], book[live])] for p, row in zip(places, alive, strict=True)]
        none = [np.zeros(0, np.int64)]
        return whole, (np.concatenate(places or none), np.concatenate(owners or none))

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the points of each entry."""
        count, total = np.zeros(len(book), np.int64), np.zeros_like(book)
        whole, (places, owners) = self.settle(book)
        for level, nodes, entries in whole:
            ends = starts(len(self.points), level)
            np.add.at(count, entries, ends[nodes + 1] - ends[nodes])
            np.add.at(total, entries, self.total[(1 << level) - 1 + nodes])
        np.add.at(count, owners, 1)
        np.add.at(total, owners, self.points[places])
        return count, total

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point, in the order in which the chunk's rows came."""
        whole, (places, owners) = self.settle(book)
        own = np.empty(len(self.points), np.int64)
        own[places] = owners
        for level, nodes, entries in whole:
            ends = starts(len(self.points), level)
            for a, b, e in zip(ends[nodes].tolist(), ends[nodes + 1].tolist(), entries.tolist(), strict=True):
                own[a:b] = e
        error = ((self.points - book[own]) ** 2).sum(1)
        found, far = np.empty_like(own), np.empty_like(error)
        found[self.order], far[self.order] = own, error
        return found, far


def _nearest(points: np.ndarray, book: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
    """The nearest entry of each point, the first of equals. Floats hold these integers exactly where they are small enough."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 8 * book.shape[1] * most * most < 1 << 53 else np.int64
    p, c = points.astype(kind), book.astype(kind)
    far = (c * c).sum(1) - 2 * (p @ c.T)
    if alive is not None:
        far[~alive] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
    return far.argmin(1)


def _kept(vectors: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    named = F.col(label) if label else F.lit(None).cast("int")
    return vectors.where(v.isNotNull() & ~odd).select(F.col(key).alias("key"), named.alias("label"), held.alias("x"))


def _trees(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """A row for each chunk: its keys, its labels and a packed tree for each part."""
    ship(kept.sparkSession)
    names = [f"tree{p}" for p in range(parts)]
    most = max(LEAF, CHUNK // (4 * parts * width))

    def rows_of(batch):
        x = batch.column(2)
        offsets = x.offsets.to_numpy().astype(np.int64)
        flat = x.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), parts * width), np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
        return out

    def build(batches):
        import pyarrow as pa

        held, points = [], []

        def made():
            rows, x = pa.Table.from_batches(held).combine_chunks().to_batches()[0], np.concatenate(points)
            columns = [pa.array([c.to_pylist()], type=pa.list_(c.type)) for c in rows.columns]
            columns += [pa.array([Tree.build(x[:, p * width : (p + 1) * width]).packed()], type=pa.binary()) for p in range(parts)]
            return pa.RecordBatch.from_arrays(columns, names=["keys", "labels", *names])

        waiting = 0
        for batch in batches:
            x, thin = rows_of(batch), batch.select([0, 1])
            while batch.num_rows and len(x):
                take = most - waiting
                held.append(thin.slice(0, take))
                points.append(x[:take])
                waiting += len(points[-1])
                x, thin = x[take:], thin.slice(take)
                if waiting == most:
                    yield made()
                    held, points, waiting = [], [], 0
        if waiting:
            yield made()

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    fields = [f"keys array<{kinds['key']}>", f"labels array<{kinds['label']}>", *(f"{n} binary" for n in names)]
    return written(kept.mapInArrow(build, ", ".join(fields)))


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. Every task gives a count and a sum for each entry that owns something."""
    parts, _, width = books.shape

    def settle(batches):
        import pyarrow as pa

        count, total = np.zeros(books.shape[:2], np.int64), np.zeros_like(books)
        for batch in batches:
            for row in range(batch.num_rows):
                n = len(batch.column(0)[row])
                for p in range(parts):
                    c, t = Tree.unpacked(batch.column(2 + p)[row].as_py(), n, width).totals(books[p])
                    count[p] += c
                    total[p] += t
        part, entry = np.nonzero(count)
        sums = [pa.array(total[part, entry, k]) for k in range(width)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(count[part, entry]), *sums], names=["part", "entry", "n", *(f"s{k}" for k in range(width))]
        )

    fields = ["part long", "entry long", "n long", *(f"s{k} long" for k in range(width))]
    found = trees.mapInArrow(settle, ", ".join(fields)).groupBy("part", "entry").agg(F.sum("n"), *(F.sum(f"s{k}") for k in range(width)))
    after = books.copy()
    for part, entry, n, *total in found.collect():  # parts x entries rows at most
        after[part, entry] = np.array(total, np.int64) // n
    return after


def fit(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[Codebooks, DataFrame]:
    """The codebooks after all rounds, and the trees that ``encode`` takes."""
    kept = _kept(vectors, key, vector, label, scale)
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = kept.orderBy(F.asc_nulls_last("key"), "x").select("x").limit(entries).collect()
    books = np.zeros((len(first), parts * width), np.int64)
    for k, r in enumerate(first):
        books[k, : len(r.x)] = r.x
    books = np.ascontiguousarray(books.reshape(len(first), parts, width).swapaxes(0, 1))
    trees = _trees(kept, parts, width)
    for _ in range(rounds if len(first) else 0):
        books = _round(trees, books)
    return Codebooks(books, scale), trees


def encode(trees: DataFrame, books: Codebooks) -> DataFrame:
    """key, label, code (two hex digits a part), error."""
    held = books.entries
    parts, most, width = held.shape
    kinds = {f.name: f.dataType.elementType.simpleString() for f in trees.schema if f.name in ("keys", "labels")}
    digits = [f"{x:02x}" for x in range(most)]

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                keys, labels = batch.column(0)[row].values, batch.column(1)[row].values
                found = [Tree.unpacked(batch.column(2 + p)[row].as_py(), len(keys), width).codes(held[p]) for p in range(parts)]
                codes = ["".join(digits[e] for e in each) for each in zip(*(f[0].tolist() for f in found), strict=True)]
                error = np.sum([f[1] for f in found], axis=0)
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array(codes, pa.string()), pa.array(error)], names=["key", "label", "code", "error"])

    return trees.mapInArrow(code, f"key {kinds['keys']}, label {kinds['labels']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """codes with the vector that each one stands for, as column restored; a null code has none."""
    ship(codes.sparkSession)
    held, scale, parts = books.entries, books.scale, len(books.entries)

    @F.pandas_udf("array<double>")
    def restored(code: pd.Series) -> pd.Series:
        return code.map(lambda c: None if c is None else np.concatenate([held[p, int(c[2 * p : 2 * p + 2], 16)] for p in range(parts)]) / scale)

    return codes.withColumn("restored", restored(code))


def with_label_error(found: DataFrame) -> DataFrame:
    """found with the error summed over rows of an equal label. Labels with many rows are broadcast, others meet in a shuffle."""
    found = written(found)
    sums = cut(found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    rows = sums.agg(F.sum("n")).first()[0] or 0
    same = F.col("a.label").eqNullSafe(F.col("b.label"))
    hot = F.broadcast(sums.where(F.col("n") * HOT > rows)).alias("b")
    marked = found.alias("a").join(hot, same, "left").select("a.*", "b.label_error", F.col("b.n").isNull().alias("cold"))
    few = marked.where("cold").drop("label_error").alias("a").join(sums.where(F.col("n") * HOT <= rows).alias("b"), same)
    return marked.where("NOT cold").drop("cold").unionByName(few.select("a.key", "a.label", "a.code", "a.error", "b.label_error"))


def compress(vectors: DataFrame, **settings) -> tuple[DataFrame, Codebooks]:
    """fit and encode: key, label, code, error, label_error, and the codebooks."""
    books, trees = fit(vectors, **settings)
    return with_label_error(encode(trees, books)), books


def save(books: Codebooks, spark: SparkSession, path: str | None = None) -> str:
    """The codebooks as a table of part, entry, vector; the place."""
    path = path or f"{shared_dir(spark)}/codebooks-{uuid.uuid4().hex}"
    rows = [(p, e, v.tolist(), books.scale) for p, book in enumerate(books.entries) for e, v in enumerate(book)]
    spark.createDataFrame(rows, "part int, entry int, vector array<long>, scale int").coalesce(1).write.parquet(path)
    return path


def load(spark: SparkSession, path: str) -> Codebooks:
    rows = spark.read.parquet(path).orderBy("part", "entry").collect()
    parts = len({r.part for r in rows}) or 1
    return Codebooks(np.array([r.vector for r in rows], np.int64).reshape(parts, len(rows) // parts, -1), rows[0].scale if rows else SCALE)


def op11_filtering_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain Lloyd rounds: every part against every entry."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS r, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0)),
dim AS (SELECT greatest(1, (max(len(x)) + 3) // 4) AS w FROM kept),
place AS (SELECT unnest(range(4 * w)) AS i, w FROM dim),
flat AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, coalesce(x[i + 1], 0) AS x FROM kept, place),
book0 AS MATERIALIZED (SELECT part, r AS entry, pos, x AS c FROM flat WHERE r < 256)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""far{k} AS (SELECT r, part, entry, sum((x - c) * (x - c))::BIGINT AS far FROM flat JOIN book{k} USING (part, pos) GROUP BY ALL),
own{k} AS MATERIALIZED (SELECT r, part, min({{'far': far, 'entry': entry}}) AS own FROM far{k} GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""mean{k} AS (SELECT part, own.entry AS entry, pos, (sum(x) // count(*) - (sum(x) % count(*) < 0)::INT)::BIGINT AS c
  FROM own{k} JOIN flat USING (r, part) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, pos))""")
    last = ROUNDS
    steps.append(f"""coded AS (SELECT r, string_agg(lpad(lower(to_hex(own.entry)), 2, '0'), '' ORDER BY part) AS code, sum(own.far)::BIGINT AS error
  FROM own{last} GROUP BY r)""")
    return f"""WITH {",\n".join(steps)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{last}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


SQL_OP11 = _sql()
