"""Topics of texts: latent Dirichlet allocation by variational rounds over all texts, with neither words nor model in the driver.

Texts are packed where they lie in tiles of about TILE words: a tile holds its texts' counts and names each of its words once. The model is
a table (term, v0, v1, ..). In a round a word's numbers are sent to the tiles that use it, a tile goes on from its texts' shares of the
topics for INNER steps, and what its texts give each word is summed by word. Only the topics' totals, a number each, pass through the
driver. A round goes in passes of some tiles, which send SENT words or about as many; what a pass has written and shuffled is let go before the next,
so the disk holds the model, and not what all tiles use of it in all rounds. The words alone decide where the rounds begin, so topics don't depend on where rows lie.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir, ship, tidy

#: Words of a tile; counts that are worked on at a time.
TILE, SLICE = 1 << 22, 1 << 16
#: Words of tiles that a pass sends, each once in a tile.
SENT = 1 << 24
#: Steps of a text in a round; steps at most, and the mean change that ends them, when the model stands.
INNER, LAST, STILL = 2, 100, 1e-3


def digamma(x: np.ndarray) -> np.ndarray:
    """For x above 0: six steps upwards, and the series from there."""
    down = sum(1 / (x + k) for k in range(6))
    y = x + 6
    s = 1 / (y * y)
    return np.log(y) - 0.5 / y - s * (1 / 12 - s * (1 / 120 - s / 252)) - down


def _tiles(texts: DataFrame, key: str, words: str) -> DataFrame:
    """(tile, body): an Arrow table of one row, docs (the keys), sizes (distinct words of each), at (places among terms), n (how often), terms."""

    def pack(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number, held, waiting = TaskContext.get().partitionId() << 32, [], 0

        def tile():
            nonlocal number, held, waiting
            docs = pa.chunked_array([h.column(0) for h in held]).combine_chunks()
            lists = pa.chunked_array([h.column(1) for h in held]).combine_chunks()
            coded = lists.flatten().dictionary_encode()
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = max(1, len(coded.dictionary))
            pairs, n = np.unique(np.repeat(np.arange(len(docs)), lengths) * terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            sizes = np.bincount(pairs // terms, minlength=len(docs))
            columns = (docs, *(pa.array(y.astype(np.int32)) for y in (sizes, pairs % terms, n)), coded.dictionary)
            body = pa.RecordBatch.from_arrays([_listed(x) for x in columns], names=["docs", "sizes", "at", "n", "terms"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(body)
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["tile", "body"])
            number, held, waiting = number + 1, [], 0
            return out

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            a = 0
            while a < batch.num_rows:
                before = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + TILE - waiting, side="right")))
                held.append(batch.slice(a, b - a))
                waiting, a = waiting + int(ends[b - 1]) - before, b
                if waiting >= TILE or a < batch.num_rows:
                    yield tile()
        if held:
            yield tile()

    return texts.select(key, words).mapInArrow(pack, "tile long, body binary")


def _body(data: bytes) -> list:
    """docs, sizes, at, n and terms of a tile."""
    import pyarrow as pa

    (batch,) = pa.ipc.open_stream(data)
    return [c.flatten() for c in batch.columns]


def _spots(batches):
    """(tile, term) of tiles."""
    import pyarrow as pa

    for batch in batches:
        for tile, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            terms = _body(body.as_buffer())[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), tile)), terms], names=["tile", "term"])


def _listed(values):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _steps(gamma, at, n, sizes, beta, alpha, most, still=0.0):
    """gamma (texts x topics) after the steps; what the texts give each word of beta (topics x words), yet to be multiplied by it, while ``still`` is 0."""
    given = np.zeros_like(beta)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        first = ends[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(ends, first + SLICE, side="right")))
        own, count, size = at[first : ends[b - 1]], n[first : ends[b - 1]].astype(np.float64), sizes[a:b]
        rows, g, going = beta.take(own, axis=1), gamma[a:b].T.copy(), np.arange(a, b)

        def step(g, rows, count, size):
            """The texts' shares, and for each of their words how often it comes for its chance."""
            theta = np.exp(digamma(g) - digamma(g.sum(axis=0)))
            chance = np.full(len(count), 1e-100)
            for share, row in zip(theta, rows, strict=True):
                part = np.repeat(share, size)
                part *= row
                chance += part
            return theta, np.divide(count, chance, out=chance)

        for _ in range(most):
            theta, ratio = step(g, rows, count, size)
            starts = np.cumsum(size) - size
            new = theta * np.array([np.add.reduceat(ratio * row, starts) for row in rows]) + alpha
            moves, g = np.abs(new - g).mean(axis=0) >= still, new
            gamma[going] = g.T
            if not still:
                continue
            if not moves.any():
                break
            if 2 * moves.sum() < len(moves):  # go on with the others alone
                kept = np.repeat(moves, size)
                g, rows, count, size, going = g[:, moves], rows[:, kept], count[kept], size[moves], going[moves]
        if not still:
            theta, ratio = step(g, rows, count, size)
            for k, share in enumerate(theta):
                given[k] += np.bincount(own, ratio * np.repeat(share, size), given.shape[1])
        a = b
    return gamma, given


def dominant(texts: DataFrame, key: str, words: str, *, k: int = 8, rounds: int = 10) -> DataFrame:
    """(key, topic long): the topic that has the largest share of each row's words, from 0; that of a row without words is 0.

    words: an array of strings. Shares and topics have symmetric priors of 1 / k. Every row counts in every round. Other columns are not looked at.
    """
    spark = texts.sparkSession
    ship(spark)
    alpha = eta = 1 / k
    names = [f"v{j}" for j in range(k)]
    place = f"{shared_dir(spark)}/topics-{uuid.uuid4().hex}"
    _tiles(texts, key, words).write.parquet(place)
    tiles = spark.read.parquet(place)
    kind = texts.schema[key].dataType.simpleString()
    spots = cut(tiles.mapInArrow(_spots, "tile long, term string"))
    at_random = lambda j: F.pmod(F.xxhash64("term", F.lit(j)), F.lit(1 << 20)) / (1 << 20) + 0.5
    model = cut(spots.select("term").distinct().select("term", *(at_random(j).alias(c) for j, c in enumerate(names))))
    state = None
    sizes = {r.tile: r["count"] for r in spots.groupBy("tile").count().collect()}  # a number for each tile
    passes: list[list[int]] = [[]]
    for (tile,) in tiles.select("tile").orderBy("tile").collect():
        if passes[-1] and sum(sizes.get(t, 0) for t in passes[-1]) + sizes.get(tile, 0) > SENT:
            passes.append([])
        passes[-1].append(tile)

    def round_of(own: list[int], totals: np.ndarray, last: bool):
        off = digamma(totals)

        def run(tile, sent):
            import pyarrow as pa
            import pyarrow.compute as pc

            docs, sizes, at, n, terms = _body(tile.column("body")[0].as_buffer())
            sizes, at, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (sizes, at, n))
            known = sent.filter(sent.column("term").is_valid())
            order = pc.index_in(terms, value_set=known.column("term").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
            lam = np.array([known.column(c).to_numpy()[order] for c in names])
            beta = np.exp(digamma(lam) - off[:, None])
            before = [x for x in sent.column("state").to_pylist() if x]
            full = sizes > 0
            gamma = np.frombuffer(before[0]).reshape(-1, k).copy() if before else np.ones((int(full.sum()), k))
            gamma, given = _steps(gamma, at, n, sizes[full], beta, alpha, LAST if last else INNER, STILL if last else 0.0)
            if last:
                topic = np.zeros(len(docs), np.int64)
                topic[full] = gamma.argmax(axis=1)
                return pa.Table.from_arrays([docs, pa.array(topic)], names=[key, "topic"])
            given *= beta
            row = [pa.array(np.full(len(terms) + 1, tile.column("tile")[0].as_py())), pa.concat_arrays([terms.cast(pa.string()), pa.nulls(1, pa.string())])]
            row += [pa.concat_arrays([pa.nulls(len(terms), pa.binary()), pa.array([gamma.tobytes()], pa.binary())]), *(pa.array(np.append(x, 0.0)) for x in given)]
            return pa.Table.from_arrays(row, names=["tile", "term", "state", *names])

        here = lambda rows: rows.where(F.col("tile").isin(own)) if len(passes) > 1 else rows
        # a model is taken for small by the planner, and would be sent through the driver
        out = here(spots).join(model.hint("merge"), "term").select("tile", "term", F.lit(None).cast("binary").alias("state"), *names)
        if state is not None:
            out = out.unionByName(here(state))
        made = f"{key} {kind}, topic long" if last else "tile long, term string, state binary, " + ", ".join(f"{c} double" for c in names)
        return here(tiles).groupBy("tile").cogroup(out.groupBy("tile")).applyInArrow(run, made)

    for number in range(rounds + 1):
        totals = np.array([x or 1.0 for x in model.agg(*(F.sum(c) for c in names)).first()])  # k numbers
        if number == rounds:
            return functools.reduce(DataFrame.unionByName, (cut(found) if len(passes) > 1 else found for found in (round_of(own, totals, True) for own in passes)))
        states, given = [], None
        for own in passes:
            found = cut(round_of(own, totals, False))
            states.append(cut(found.where("term IS NULL")))
            told = found.where("term IS NOT NULL").select("term", *names)
            given = cut((told if given is None else given.unionByName(told)).groupBy("term").agg(*(F.sum(c).alias(c) for c in names)))
            del found, told
            tidy(spark)
        state = functools.reduce(DataFrame.unionByName, states)
        model = given.select("term", *((F.col(c) + eta).alias(c) for c in names))
