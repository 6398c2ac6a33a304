"""Vector search and links between vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, tidy

#: Query vectors that are held against the rows at a time.
BLOCK = 4096
#: Products of a query and a row that a task holds at a time.
CELLS = 1 << 20


def _rows(column) -> np.ndarray:
    """A column of vectors of one length, as rows; no Python object is made of a number."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def similar(queries: DataFrame, rows: DataFrame, least: float, *, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, row, cosine) of every query with every other row that is at least so near.

    The queries are a stated set. Up to BLOCK of them are sent to the rows, which stay where they are; more are dealt in blocks, and so are
    the rows, and every two blocks meet in a task of bounded size.
    """
    spark = rows.sparkSession
    ship(spark)
    schema = "query long, row long, cosine double"

    def unit(column) -> np.ndarray:
        v = np.array(column, dtype=np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)

    def near(ids, q, there, v):
        """What is near, in slices of the rows, so that a task holds no more than CELLS products."""
        import pyarrow as pa

        step = max(1, CELLS // len(ids))
        for at in range(0, len(there), step):
            cosine = q @ v[at : at + step].T
            a, b = np.nonzero((cosine >= least) & (ids[:, None] != there[None, at : at + step]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(there[at + b]), pa.array(cosine[a, b])], names=["query", "row", "cosine"])

    held = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    some = held.limit(block + 1).collect()  # block + 1 vectors
    if not some:
        return spark.createDataFrame([], schema)
    if len(some) <= block:
        sent = spark.sparkContext.broadcast((np.array([r.id for r in some]), unit([r.v for r in some])))

        def search(batches):
            import pyarrow as pa

            ids, q = sent.value
            for batch in batches:
                if batch.num_rows:
                    yield from near(ids, q, batch.column(0).to_numpy(), unit(_rows(batch.column(1))))

        return rows.select(key, vector).mapInArrow(search, schema)

    q_blocks, r_blocks = -(-queries.count() // block), -(-rows.count() // (4 * block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = held.select(dealt(q_blocks).alias("i"), each(r_blocks).alias("j"), F.lit(True).alias("asks"), "id", "v")
    right = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).select(each(q_blocks).alias("i"), dealt(r_blocks).alias("j"), F.lit(False).alias("asks"), "id", "v")

    def meet(part):
        import pyarrow as pa

        asks, ids = part.column("asks").to_numpy(zero_copy_only=False), part.column("id").to_numpy()
        if not asks.any() or asks.all():
            return pa.table({"query": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        v = unit(_rows(part.column("v")))
        return pa.Table.from_batches(near(ids[asks], v[asks], ids[~asks], v[~asks]))

    return left.unionByName(right).repartition("i", "j").groupBy("i", "j").applyInArrow(meet, schema)


#: Vectors of a block at most, and numbers in them; pivots of the rows, and the sample that they are drawn from.
LINK_BLOCK, NUMBERS, PIVOTS = 1 << 15, 1 << 22, 64
#: Copies of vectors that a task deals out at a time.
COPIES = 4096
#: How often a pass deals out the vectors, at most; nearness in doubt that is looked at again at a time.
PASS, DOUBTS = 2, 1 << 14


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """root (the least place that each place is tied to) after the ties of a with b, and those of the ties that it takes."""
    taken = [a[:0]], [b[:0]]
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root, np.concatenate(taken[0]), np.concatenate(taken[1])
        a, b = a[apart], b[apart]
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        order = np.argsort(low, kind="stable")
        which = order[np.unique(high[order], return_index=True)[1]]  # of each root the tie with the least one; roots point downwards only
        root[high[which]] = low[which]
        taken[0].append(a[which])
        taken[1].append(b[which])
        while (root != root[root]).any():
            root = root[root]


def _tied(v: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and right, vectors of unit length, that join what all near pairs of them do. Products are taken in single precision, in slices
    of CELLS; those that may be near are looked at again in double."""
    root, narrow, froms, tos = np.arange(len(v)), v.astype(np.float32), [left[:0]], [left[:0]]
    others, doubt = np.ascontiguousarray(narrow[right].T), np.float32(least - (v.shape[1] + 16) * 1.2e-7)
    step = max(1, CELLS // len(right))
    for at in range(0, len(left), step):
        if not root.any():  # all are tied
            break
        a, b = np.nonzero(narrow[left[at : at + step]] @ others >= doubt)
        a, b = left[at + a], right[b]
        fit = (root[a] != root[b]) & (group[a] == group[b])
        a, b = a[fit], b[fit]
        while len(a):
            x, y = a[:DOUBTS], b[:DOUBTS]
            near = np.einsum("ij,ij->i", v[x], v[y]) >= least
            root, x, y = _joined(root, x[near], y[near])
            froms.append(x)
            tos.append(y)
            a, b = a[DOUBTS:], b[DOUBTS:]
            fit = root[a] != root[b]
            a, b = a[fit], b[fit]
    return np.concatenate(froms), np.concatenate(tos)


def near_links(rows: DataFrame, least: float, *, key: str = "vec_id", vector: str = "embedding", by: str | None = None, pivots: int = PIVOTS, block: int = LINK_BLOCK) -> DataFrame:
    """(a, b) of vectors whose cosine is at least so much: not every such pair, but links that join the same vectors as all of them.

    The angle between vectors is a metric. Every vector belongs to the region of its nearest pivot, and a region is cut into blocks of bounded size.
    Two blocks meet in a task if by the triangle inequality they can hold a pair, and of each those vectors that can be near the other's. What is
    dealt out to tasks goes in passes of PASS times the vectors at most, and a pass is let go before the next, so the disk follows the vectors and not
    their pairs; the work is that of all pairs where vectors lie far from all pivots. Equal vectors are linked in a chain first and stand in the join
    once. Exact for any data. With ``by``, only vectors that are equal in it are linked.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[key].dataType.simpleString()
    group = F.col(by) if by else F.lit(0)
    held = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & group.isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), group.alias("g"))
    equal = held.groupBy("g", "v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeats = held.join(equal.where("n > 1").hint("merge"), ["g", "v"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    points = cut(equal.select(F.col("first").alias("id"), "v", "g", F.xxhash64("first").alias("number")))
    many, longest = points.agg(F.count("*"), F.max(F.size("v"))).first()
    if not many:
        return repeats
    block = max(1, min(block, NUMBERS // max(1, longest)))
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(min(pivots, -(-many // block))).collect()  # so many vectors
    centre = np.array([r.v for r in drawn])
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-300)
    angle, sent = float(np.arccos(np.clip(least, -1, 1))) + 1e-7, spark.sparkContext.broadcast(centre)

    def far(column) -> np.ndarray:
        v = _rows(column)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return np.arccos(np.clip(v @ sent.value.T, -1, 1))

    def nearest(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(far(batch.column(1)).argmin(axis=1).astype(np.int32))], names=["cell"])

    sizes = {r.cell: r["count"] for r in points.mapInArrow(nearest, "cell int").groupBy("cell").count().collect()}
    parts = np.array([-(-sizes.get(c, 0) // block) for c in range(len(centre))])
    begins = np.cumsum(parts) - parts

    def blocks_of(batch, d: np.ndarray) -> np.ndarray:
        home = d.argmin(axis=1)
        return begins[home] + batch.column(3).to_numpy() % parts[home]

    def spans(batches):
        """Of each block, how far its vectors are from each pivot."""
        import pyarrow as pa

        low, high, n = np.full((parts.sum(), len(centre)), np.inf), np.full((parts.sum(), len(centre)), -np.inf), np.zeros(parts.sum(), np.int64)
        for batch in batches:
            if batch.num_rows:
                d = far(batch.column(1))
                own = blocks_of(batch, d)
                np.minimum.at(low, own, d)
                np.maximum.at(high, own, d)
                n += np.bincount(own, minlength=len(n))
        b, p = np.divmod(np.flatnonzero(np.isfinite(low)), len(centre))
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(low[b, p]), pa.array(high[b, p]), pa.array(n[b])], names=["b", "p", "low", "high", "n"])

    # a number for each block and pivot
    found = points.mapInArrow(spans, "b int, p int, low double, high double, n long").groupBy("b", "p").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    low, high, n = np.full((parts.sum(), len(centre)), np.inf), np.full((parts.sum(), len(centre)), -np.inf), np.zeros(parts.sum(), np.int64)
    for r in found:
        low[r.b, r.p], high[r.b, r.p], n[r.b] = r.low, r.high, r.n
    low, high = low - angle, high + angle

    def dealt(tiles: list[tuple[int, int]]):
        def run(batches):
            """A row for each tile that a vector is in: a block with itself, or with another."""
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                d = far(batch.column(1))
                own = blocks_of(batch, d)
                places = {b: np.flatnonzero(own == b) for b in np.unique(own).tolist()}
                for tile, (i, j) in enumerate(tiles):
                    for mine, other in {(i, j), (j, i)}:
                        at = places.get(mine, own[:0])
                        at = at[((d[at] >= low[other]) & (d[at] <= high[other])).all(axis=1)] if i != j else at
                        for a in range(0, len(at), COPIES):
                            take = pa.array(at[a : a + COPIES])
                            named = [pa.array(np.full(len(take), tile, np.int32)), pa.array(np.full(len(take), mine == i))]
                            yield pa.RecordBatch.from_arrays([*named, *[batch.column(c).take(take) for c in range(3)]], names=["tile", "own", "id", "v", "g"])

        return run

    def join(part):
        import pyarrow as pa

        part = part.sort_by("id")
        own, ids = part.column("own").to_numpy(zero_copy_only=False), part.column("id").combine_chunks()
        left, right = np.flatnonzero(own), np.flatnonzero(~own)
        if own.all():
            right = left
        a = b = left[:0]
        if len(left) and len(right):
            v = _rows(part.column("v"))
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            a, b = _tied(v, part.column("g").combine_chunks().dictionary_encode().indices.to_numpy(), left, right, least)
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})

    near = [(i, j) for i in range(len(n)) for j in range(i, len(n)) if n[i] and n[j] and (low[i] <= high[j] - angle).all() and (low[j] <= high[i] - angle).all()]
    passes: list[list[tuple[int, int]]] = [[]]
    copies = 0
    for i, j in near:
        more = int(n[i] + n[j] * (i != j))
        if passes[-1] and copies + more > PASS * many:
            passes.append([])
            copies = 0
        passes[-1].append((i, j))
        copies += more
    links = repeats
    schema = f"tile int, own boolean, id {kind}, v array<double>, g {points.schema['g'].dataType.simpleString()}"
    for tiles in passes:
        # as many parts as tiles at least: a tile is small, and much work
        pairs = points.mapInArrow(dealt(tiles), schema).repartition(2 * max(len(tiles), spark.sparkContext.defaultParallelism), "tile")
        links = links.unionByName(cut(pairs.groupBy("tile").applyInArrow(join, f"a {kind}, b {kind}")))
        tidy(spark)
    return links


def links(found: DataFrame) -> DataFrame:
    """Each pair once, smaller id first."""
    return found.select(F.least("query", "row").alias("a"), F.greatest("query", "row").alias("b"), "cosine").dropDuplicates(["a", "b"])
