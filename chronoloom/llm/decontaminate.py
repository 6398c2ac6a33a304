"""Benchmark passages in documents, by latent semantic retrieval and a check of what was found.

1. Items are the stated query set. They are cut into passages of PASSAGE words (the last may be shorter) every STRIDE words, and
   taken in blocks of at most BLOCK_WORDS words; all that is broadcast or reaches the driver is bounded by a block.
2. Document frequencies of a block's words are counted over all documents.
3. A distributed randomised SVD of the items' TF-IDF passages gives the latent space: partitions multiply their rows with a random
   matrix and back, sums are taken by term, and two power rounds sharpen them.
4. Every document is cut into passages, which are folded into the space. A passage whose cosine with an item's passage reaches
   CANDIDATE is a candidate, if its words have OVERLAP of the item's passage by weight. Words outside the block count as the
   items' words do in the mean, and its length as no more than LONGEST times that of the item's passage, so what else
   stands beside a short item plays no great part, nor the number of documents, by which all weights grow.
5. Around a candidate the longest common subsequence of words with the whole item is taken. SAME of the item's words in order
   is a copy. A paraphrase has LIKE of them and the answer too: the rarest ANSWER words of the item's last third. Both
   must have LIKE of the words by weight, so common words alone never make a match.
6. What was found is left out when the same item is looked for beside it, so an item that stands in a text several times has a row for
   each place.

Words are runs of letters, digits and all bytes beyond ASCII, in lower case.

Defined cases: null or empty texts hold no words and match nothing, as items too; repeated rows are matched each on their own; items
with equal texts all match; of two overlapping places of one item the one that the earlier passage leads to is given; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_table, mix64, ship, slices, table, text_buffer
from .shingles import powers

PASSAGE, STRIDE = 32, 16
#: Dimensions of the latent space, and more that the random matrix has.
DIMENSIONS, EXTRA, ROUNDS = 128, 16, 2
CANDIDATE, OVERLAP, LONGEST = 0.2, 0.3, 2.0
SAME, LIKE, ANSWER = 0.8, 0.55, 3
#: Words of the items that are searched for at a time.
BLOCK_WORDS = 200_000
LOWERED = "__lowered"

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_VALUE = byte_table(71)


def words(bytes_: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for every word, and where each text's words begin and end among them."""
    inside = _INSIDE[bytes_]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = np.cumsum(first)[at] - 1
    lengths = np.bincount(word)
    value = _VALUE[bytes_[at]] * powers(int(lengths.max()))[at - starts[word]]
    sums = np.add.reduceat(value, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return mix64(sums + lengths.astype(np.uint64)), np.searchsorted(starts, offsets)


def windows(n: int) -> list[tuple[int, int]]:
    """Passages of a text of n words."""
    return [(a, min(a + PASSAGE, n)) for a in range(0, max(n - STRIDE, 1), STRIDE)] if n else []


@dataclass
class Block:
    """What the tasks need of some items."""

    ids: list
    texts: list[np.ndarray]  # word values of each item
    terms: np.ndarray  # sorted
    idf: np.ndarray
    mean: float  # root of the items' words' mean squared weight
    basis: np.ndarray  # [terms, dimensions], times the terms' weights
    vectors: np.ndarray  # [passages, dimensions]
    owner: np.ndarray  # item of each passage
    answers: list[np.ndarray]
    places: list[np.ndarray]  # of each item's words among the terms
    weights: list[np.ndarray]  # of each item's words
    kinds: np.ndarray  # [passages, PASSAGE]: each passage's terms, and then one beyond them
    shares: np.ndarray  # of the passage's weight, of these terms


def _lookup(values: np.ndarray, terms: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Index of each value among the terms, or -1."""
    out = np.full(len(values), -1, dtype=np.int64)
    some = np.flatnonzero(filter_[(values >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(terms, values[some])
    at[at == len(terms)] = 0
    same = terms[at] == values[some]
    out[some[same]] = at[same]
    return out


def _filter(terms: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, dtype=bool)
    out[(terms >> np.uint64(44)).astype(np.int64)] = True
    return out


def _rows(items: list[np.ndarray], terms: np.ndarray, idf: np.ndarray):
    """(item, indices, weights) of each passage."""
    for k, own in enumerate(items):
        for a, b in windows(len(own)):
            at = np.searchsorted(terms, own[a:b])
            kinds, times = np.unique(at, return_counts=True)
            yield k, kinds, idf[kinds] * times


def latent_basis(spark: SparkSession, items: DataFrame, terms: np.ndarray, idf: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors of the items' TF-IDF passages, by randomised subspace iteration over the partitions of items."""
    width = min(dimensions + EXTRA, len(terms))
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((len(terms), width)))[0]
    for _ in range(ROUNDS + 1):
        sent = spark.sparkContext.broadcast((terms, idf, q))  # terms of one block

        def back(batches, sent=sent):
            import pyarrow as pa

            t, f, m = sent.value
            sums, seen = np.zeros_like(m), np.zeros(len(t), dtype=bool)
            for batch in batches:
                values, at = words(*text_buffer(batch.column(0)))
                own = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                for _, kinds, w in _rows(own, t, f):
                    sums[kinds] += np.outer(w, w @ m[kinds])
                    seen[kinds] = True
            k = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array([r.tobytes() for r in sums[k]], pa.binary())], names=["term", "row"])

        def add(own):
            import pyarrow as pa

            row = np.sum([np.frombuffer(r) for r in own.column("row").to_pylist()], axis=0)
            return pa.table({"term": own.column("term").slice(0, 1), "row": pa.array([row.tobytes()], pa.binary())})

        parts = items.select("text").mapInArrow(back, "term int, row binary").groupBy("term").applyInArrow(add, "term int, row binary")
        z = np.zeros_like(q)
        for r in parts.collect():  # a row for each term of the block
            z[r.term] = np.frombuffer(r.row)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        q = u
    return np.ascontiguousarray(q[:, : min(dimensions, int((s > s[0] * 1e-9).sum()))], dtype=np.float32)


def common_words(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence of a and b, and the span of b that a shortest match ends with."""
    best = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        hit = best[:-1] + (b == x)
        np.maximum(hit, best[1:], out=hit)
        best[1:] = np.maximum.accumulate(hit)
    n = int(best[-1])
    end = int(np.searchsorted(best, n)) if n else 0
    back = np.zeros(end + 1, dtype=np.int32)
    rev = b[:end][::-1]
    for x in a[::-1]:
        hit = back[:-1] + (rev == x)
        np.maximum(hit, back[1:], out=hit)
        back[1:] = np.maximum.accumulate(hit)
    return n, end - int(np.searchsorted(back, n)), end


def _folded(own: np.ndarray, at: np.ndarray, b: Block, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages (text, first word, end word) of the texts, and their latent vectors. A passage is two strides of words, and a
    stride is summed once."""
    sizes = np.diff(at)
    n = -(-sizes // STRIDE)  # strides of each text
    text = np.repeat(np.arange(len(n)), n)
    place = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    first = at[text] + place
    if not len(first):
        return np.zeros((0, 3), dtype=np.int64), np.zeros((0, b.basis.shape[1]), dtype=np.float32)
    sums = np.zeros((len(first) + 1, b.basis.shape[1]), dtype=np.float32)
    hit = np.flatnonzero(term >= 0)
    of = np.searchsorted(first, hit, side="right") - 1
    held, heads = np.unique(of, return_index=True)
    for a in range(0, len(held), 1024):  # the words of so many strides at a time
        own_heads = heads[a : a + 1024]
        stop = heads[a + 1024] if a + 1024 < len(heads) else len(hit)
        sums[held[a : a + 1024]] = np.add.reduceat(b.basis[term[hit[own_heads[0] : stop]]], own_heads - own_heads[0], axis=0)
    last = place + STRIDE >= sizes[text]
    passage = sums[:-1] + np.where(last[:, None], np.float32(0), sums[1:])
    spans = np.stack([text, first, np.minimum(first + PASSAGE, at[text + 1])], axis=1)
    keep = ~last | (place == 0)
    return spans[keep], passage[keep]


def _open(found: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """The parts of low to high that were not found before."""
    out = []
    for s, e in sorted(found):
        if s < high and e > low:
            out.append((low, s))
            low = e
    return [*out, (low, high)]


def accepted(b: Block, item: int, found: np.ndarray, shared: int) -> bool:
    """Whether the words found, of which so many are common with the item in its order, repeat or paraphrase it."""
    text, weights, answer = b.texts[item], b.weights[item], b.answers[item]
    if len(found) > 2 * len(text) + 8 or shared < LIKE * len(text):
        return False
    if weights[np.isin(text, found)].sum() < LIKE * weights.sum():
        return False  # by common words alone
    return shared >= SAME * len(text) or np.isin(answer, found).sum() * 3 >= 2 * len(answer)


def _search(own: np.ndarray, at: np.ndarray, b: Block, filter_: np.ndarray, candidate: float):
    """(text, item, first word, end word, LCS, cosine) of each match, in the texts whose words own[at[k]:at[k + 1]] are."""
    term = _lookup(own, b.terms, filter_)
    spans, folded = _folded(own, at, b, term)
    squares = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, b.idf[term], b.mean) ** 2)])
    length = np.sqrt(squares[spans[:, 2]] - squares[spans[:, 1]]).astype(np.float32)
    item_length = np.linalg.norm(b.vectors, axis=1)
    unit = b.vectors / np.maximum(item_length, 1e-12)[:, None]
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    there = np.zeros(len(b.terms) + 1, dtype=bool)
    step = max(16, min(1 << 12, (1 << 22) // len(unit), (1 << 23) // len(there)))
    for a in range(0, len(spans), step):
        part = spans[a : a + step]
        cosine = folded[a : a + step] @ unit.T
        cosine /= np.maximum(np.minimum(length[a : a + step, None], np.float32(LONGEST) * item_length[None, :]), 1e-12)
        rows, passages = np.nonzero(cosine >= candidate)
        if not len(rows):
            continue
        n = part[:, 2] - part[:, 1]
        present = np.zeros((len(part), len(there)), dtype=bool)
        at_word = np.repeat(part[:, 1] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        present[np.repeat(np.arange(len(part)), n), term[at_word]] = True  # -1 marks the last column
        present[:, -1] = False
        some = np.einsum("ij,ij->i", present[rows[:, None], b.kinds[passages]], b.shares[passages]) >= OVERLAP
        for r, p in zip(rows[some].tolist(), passages[some].tolist(), strict=True):
            k, x, y = part[r].tolist()
            item = int(b.owner[p])
            text = b.texts[item]
            weights, places, known = b.weights[item], b.places[item], found.setdefault((k, item), [])
            waiting = _open(known, max(int(at[k]), x - len(text)), min(int(at[k + 1]), y + len(text)))
            while waiting:
                low, high = waiting.pop()
                if high - low < LIKE * len(text):
                    continue
                there[:] = False
                there[term[low:high]] = True  # -1 marks the last place, which no item looks at
                held = there[places]
                if held.sum() < LIKE * len(text) or weights[held].sum() < LIKE * weights.sum():
                    continue  # more than the common subsequence can have
                shared, s, e = common_words(text, own[low:high])
                if accepted(b, item, own[low + s : low + e], shared):
                    s, e = low + s, low + e
                    # what was looked at may end within a place: once more, with it in the middle
                    ends = _open(known, max(int(at[k]), s - len(text)), min(int(at[k + 1]), e + len(text)))
                    left, right = next((x, y) for x, y in ends if x <= s and e <= y)
                    again = common_words(text, own[left:right])
                    if again[0] > shared:
                        shared, s, e = again[0], left + again[1], left + again[2]
                    known.append((s, e))
                    waiting = [w for a, z in [*waiting, (left, s), (e, right)] for w in _open(known, a, z)]
                    yield k, item, s - int(at[k]), e - int(at[k]), shared, float(cosine[r, p])


def block_of(spark: SparkSession, docs: DataFrame, items: list[tuple], dimensions: int) -> Block:
    """Counts the block's words in all documents and builds its latent space."""
    import pyarrow as pa

    values, at = words(*text_buffer(pa.array([t for _, t in items], pa.large_string())))
    texts = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    terms = np.unique(values)
    sent = spark.sparkContext.broadcast(terms)

    def frequencies(batches):
        import pyarrow as pa

        mine, n, total = sent.value, np.zeros(len(sent.value), dtype=np.int64), 0
        filter_ = _filter(mine)
        for batch in slices(batches, 0):
            own, where = words(*text_buffer(batch.column(0)))
            term = _lookup(own, mine, filter_)
            hit = np.flatnonzero(term >= 0)
            doc = np.searchsorted(where, hit, side="right") - 1
            n += np.bincount(np.unique(doc * len(mine) + term[hit]) % len(mine), minlength=len(mine))
            total += batch.num_rows
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1).astype(np.int32)), pa.array(np.append(n[k], total))], names=["term", "n"])

    counts, total = np.zeros(len(terms)), 0
    for r in docs.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term >= 0:  # a row for each term of the block
            counts[r.term] = r.n
        else:
            total = r.n
    idf = np.log(1 + (total + 1) / (counts + 1))
    rows = spark.createDataFrame([(t,) for _, t in items], "text string").repartition(max(1, min(64, len(items) // 256)))
    basis = latent_basis(spark, rows, terms, idf, dimensions)
    return made([i for i, _ in items], texts, terms, idf, basis)


def made(ids: list, texts: list[np.ndarray], terms: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> Block:
    basis = basis * idf[:, None].astype(np.float32)
    owner, vectors, n = [], [], sum(len(windows(len(t))) for t in texts)
    held, shares = np.full((n, PASSAGE), len(terms)), np.zeros((n, PASSAGE))
    for row, (k, kinds, w) in enumerate(_rows(texts, terms, idf)):
        owner.append(k)
        vectors.append((w / idf[kinds]).astype(np.float32) @ basis[kinds])
        held[row, : len(kinds)], shares[row, : len(kinds)] = kinds, idf[kinds] / idf[kinds].sum()
    answers = []
    for t in texts:
        tail = np.unique(t[len(t) * 2 // 3 :])
        answers.append(tail[np.argsort(-idf[np.searchsorted(terms, tail)], kind="stable")[:ANSWER]])
    places = [np.searchsorted(terms, t) for t in texts]
    weights = [idf[p] for p in places]
    mean = float(np.sqrt(np.mean(np.concatenate(weights) ** 2)))
    return Block(ids, texts, terms, idf, mean, basis, np.stack(vectors), np.array(owner), answers, places, weights, held, shares)


def blocks(spark: SparkSession, docs: DataFrame, items: DataFrame, *, text: str, item_key: str, item_text: str, dimensions: int, block_words: int):
    """A Block for each block_words words of the items."""
    texts = docs.select(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    rows = items.select(F.col(item_key).alias("id"), F.lower(item_text).alias("text")).where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    waiting, size = [], 0
    for r in rows.toLocalIterator():
        waiting.append((r.id, r.text))
        size += len(r.text.split()) + len(r.text) // 8
        if size >= block_words:
            yield block_of(spark, texts, waiting, dimensions)
            waiting, size = [], 0
    if waiting:
        yield block_of(spark, texts, waiting, dimensions)


def leaks(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    dimensions: int = DIMENSIONS, candidate: float = CANDIDATE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """key, item_key, word_start, word_end, shared_words, item_words, share, cosine of every match."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_key].dataType)
    rows = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    schema = f"key {kind}, item {item_kind}, word_start long, word_end long, shared_words long, item_words long, share double, cosine double"

    def search(block: Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # bounded by block_words

        def run(batches):
            import pyarrow as pa

            b = sent.value
            filter_ = _filter(b.terms)
            for batch in slices(batches, 1):
                own, at = words(*text_buffer(batch.column(1)))
                found = list(_search(own, at, b, filter_, candidate))
                keys = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                size = [len(b.texts[f[1]]) for f in found]
                columns = [[f[2] for f in found], [f[3] for f in found], [f[4] for f in found], size]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array([b.ids[f[1]] for f in found], item_type),
                        *[pa.array(c, pa.int64()) for c in columns],
                        pa.array([f[4] / n for f, n in zip(found, size, strict=True)], pa.float64()),
                        pa.array([f[5] for f in found], pa.float64()),
                    ],
                    names=["key", "item", "word_start", "word_end", "shared_words", "item_words", "share", "cosine"],
                )

        return rows.mapInArrow(run, schema)

    made = blocks(spark, docs, items, text=text, item_key=item_key, item_text=item_text, dimensions=dimensions, block_words=block_words)
    parts = [search(b) for b in made]
    result = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return result.withColumnsRenamed({"key": key, "item": item_key})


def clean(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    dimensions: int = DIMENSIONS, candidate: float = CANDIDATE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of docs in which no item is found. Rows are judged where they lie: ids and joins play no part."""
    spark = docs.sparkSession
    ship(spark)
    for block in blocks(spark, docs, items, text=text, item_key=item_key, item_text=item_text, dimensions=dimensions, block_words=block_words):
        sent = spark.sparkContext.broadcast(block)  # bounded by block_words

        def run(batches, sent=sent):
            import pyarrow as pa

            b = sent.value
            filter_ = _filter(b.terms)
            for batch in slices(batches, -1):
                own, at = words(*text_buffer(batch.column(batch.num_columns - 1)))
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[f[0] for f in _search(own, at, b, filter_, candidate)]] = False
                yield batch.drop_columns([LOWERED]).filter(pa.array(keep))

        schema = docs.schema
        docs = docs.withColumn(LOWERED, F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))).mapInArrow(run, schema)
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a document that repeats or paraphrases a benchmark item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
