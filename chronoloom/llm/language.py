"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to ORDER bytes, over all 256 bytes. A byte that a context has not seen costs an
escape and is coded by the next shorter context, without the bytes that the longer one has seen (method C with exclusions);
below order 0 all bytes left are alike. Contexts that a language has never met are passed over. The statistics are frozen
after training, so the bits of a byte depend on the ORDER bytes before it and itself, and are the same wherever these stand:
they are tabulated for all strings of the sample, one row for all languages, and for others they are put together from the
shorter strings' rows and what the longer contexts add. The predicted language codes the text in the fewest bits.

Training takes at most about TRAIN_DOCS labelled documents a language, chosen by a hash of id and text, and of their strings of ORDER
+ 1 bytes the GRAMS most frequent ones of each language. The sample is dealt to COUNTERS tasks, so the scan is as wide as the table. The
model is put together in a task, written to the shared folder and read by the workers that need it; the driver holds its place.
It is bounded by LANGUAGES times GRAMS strings, and more languages are refused.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from everything is ``und``;
ties go to the first language by name; repeated rows are predicted each on their own; a null id counts as held out; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shared_dir, ship, slices, table, text_buffer

#: Bytes of the longest context.
ORDER = 4
#: Documents of the training sample and strings that are kept, for each language; languages.
TRAIN_DOCS, GRAMS, LANGUAGES = 3000, 1 << 16, 64
#: Values that are looked up at a time; tasks that count the sample.
SLICE, COUNTERS = 1 << 22, 8
UNKNOWN = "und"
#: What stands before a text.
START = 10


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def grams(bytes_: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each byte and itself, as one number."""
    out = bytes_.astype(np.uint64)
    for k in range(1, ORDER + 1):
        before = np.empty_like(bytes_)
        before[k:] = bytes_[:-k]
        before[:k] = START
        for j in range(k):  # the first bytes of each text
            at = offsets[:-1][np.diff(offsets) > j] + j
            before[at] = START
        out |= before.astype(np.uint64) << np.uint64(8 * k)
    return out


def _low(codes: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes."""
    return codes & np.uint64((1 << 8 * n) - 1)


class Keys:
    """Rows of 64-bit keys, found by open addressing."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        waiting, slot = np.arange(len(keys)), self._first(keys)
        while len(waiting):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = waiting[free]
            left = self.slots[slot] != waiting
            waiting, slot = waiting[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        slot = self._first(keys)
        out = self.slots[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            slot_ = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            slot[wrong] = slot_
            out[wrong] = self.slots[slot_]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != keys[wrong])]
        return out


@dataclass
class Model:
    """Of order k: strings[k] (context and byte) have bits[k] and seen[k] of each language; contexts[k] have what they add to the
    bits of the next shorter one, where that one has seen the byte (found[k]) and where it has not (escaped[k])."""

    languages: list[str]
    strings: list[Keys]
    bits: list[np.ndarray]
    seen: list[np.ndarray]
    contexts: list[Keys]
    found: list[np.ndarray]
    escaped: list[np.ndarray]


@dataclass(frozen=True)
class Stored:
    """A model in the shared folder; a process reads it once, when it needs it."""

    path: str

    def load(self) -> Model:
        return _read(self.path)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.load(), name)


@functools.lru_cache(maxsize=1)
def _read(path: str) -> Model:
    import pickle

    import pyarrow.dataset as ds
    from pyarrow import fs

    files, folder = fs.FileSystem.from_uri(path)
    return pickle.loads(ds.dataset(folder, filesystem=files, format="parquet").to_table().column("model")[0].as_py())


def _log2(x: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(x, 1e-300))


def _tree(codes: np.ndarray, counts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """A language's contexts and strings of every order, from its counted strings of ORDER + 1 bytes."""
    tree: list[dict[str, np.ndarray]] = []
    for k in range(ORDER + 1):
        own, at = np.unique(_low(codes, k + 1), return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(own))
        contexts, where = np.unique(own >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(where, weights=n, minlength=len(contexts)), np.bincount(where, minlength=len(contexts)).astype(float)
        escapes = np.where(kinds < 256, kinds, 0)  # nothing is left to escape to
        level = {"codes": own, "n": n, "where": where, "contexts": contexts, "total": total, "kinds": kinds}
        level["start"] = _log2(total + escapes)
        level["escape"] = np.where(kinds > 0, level["start"] - _log2(escapes), 0.0)
        if k:
            up = tree[-1]
            above = np.searchsorted(up["contexts"], _low(contexts, k - 1))
            excluded = np.bincount(where, weights=up["n"][np.searchsorted(up["codes"], _low(own, k))], minlength=len(contexts))
            total_, kinds_ = up["total"][above] - excluded, up["kinds"][above] - kinds
            escapes_ = np.where(kinds_ < 256 - kinds, kinds_, 0)
            after = _log2(total_ + escapes_)
            level["found"] = level["escape"] + after - up["start"][above]
            level["escaped"] = level["escape"] + np.where(kinds_ > 0, after - _log2(escapes_), 0.0) - up["escape"][above]
        tree.append(level)
    return tree


def model_of(languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """counted: of each language the strings of ORDER + 1 bytes, as grams() has them, and how often they occur."""
    trees = [_tree(c.astype(np.uint64), n.astype(float)) for c, n in counted]
    strings, bits, seen, contexts, found, escaped = [], [], [], [], [], []
    for k in range(ORDER + 1):
        codes = np.arange(256, dtype=np.uint64) if k == 0 else np.unique(np.concatenate([t[k]["codes"] for t in trees]))
        above = np.unique(np.concatenate([t[k]["contexts"] for t in trees]))
        more, less = np.zeros((len(above), len(trees))), np.zeros((len(above), len(trees)))
        for j, t in enumerate(trees if k else []):
            rows = np.searchsorted(above, t[k]["contexts"])
            more[rows, j], less[rows, j] = t[k]["found"], t[k]["escaped"]
        if k:
            up = np.searchsorted(strings[-1].keys, _low(codes, k))
            at = np.searchsorted(above, codes >> np.uint64(8))
            b = bits[-1][up] + np.where(seen[-1][up], more[at], less[at])
        else:
            b = np.stack([np.full(256, t[0]["escape"].sum() + np.log2(256 - t[0]["kinds"].sum())) for t in trees], axis=1)
        s = np.zeros(b.shape, dtype=bool)
        for j, t in enumerate(trees):
            rows = np.searchsorted(codes, t[k]["codes"])
            b[rows, j] = t[k]["start"][t[k]["where"]] - np.log2(t[k]["n"])
            s[rows, j] = True
        strings.append(Keys(codes))
        bits.append(b)
        seen.append(s)
        contexts.append(Keys(above))
        found.append(more.astype(np.float32))
        escaped.append(less.astype(np.float32))
    return Model(languages, strings, [b.astype(np.float32) for b in bits], seen, contexts, found, escaped)


def _bits(k: int, codes: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each string's last byte under every language, by contexts of k bytes and less, and whether that of k bytes saw it."""
    if k == 0:
        return m.bits[0][codes.astype(np.int64)], m.seen[0][codes.astype(np.int64)]
    rows = m.strings[k].rows(codes)
    out, seen = m.bits[k][rows], m.seen[k][rows]
    if len(lost := np.flatnonzero(rows < 0)):
        shorter, known = _bits(k - 1, _low(codes[lost], k), m)
        at = m.contexts[k].rows(codes[lost] >> np.uint64(8))
        some = at >= 0
        shorter[some] += np.where(known[some], m.found[k][at[some]], m.escaped[k][at[some]])
        out[lost], seen[lost] = shorter, False
    return out, seen


def text_bits(bytes_: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Code length of every text under every language."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    if not len(bytes_) or not len(model.strings[ORDER].keys):
        return total
    codes, step = grams(bytes_, offsets), max(1, SLICE // len(model.languages))
    for a in range(0, len(bytes_), step):
        b = min(a + step, len(bytes_))
        first = np.searchsorted(offsets, a, side="right") - 1
        last = np.searchsorted(offsets, b, side="left") - 1
        docs = np.arange(first, last + 1)
        docs = docs[(offsets[docs + 1] > np.maximum(offsets[docs], a))]
        total[docs] += np.add.reduceat(_bits(ORDER, codes[a:b], model)[0], np.maximum(offsets[docs], a) - a, axis=0, dtype=np.float64)
    return total


def train(docs: DataFrame, *, per_language: int = TRAIN_DOCS, kept: int = GRAMS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Stored | None:
    """A model of the rows whose lang is not null."""
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))]), F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < share * F.lit(float(1 << 30))).select("lang", "text").repartition(COUNTERS)

    def count(batches):
        import pyarrow as pa

        held: dict[str, list] = {}
        for batch in slices(batches, 1):
            bytes_, offsets = text_buffer(batch.column(1))
            codes, of = grams(bytes_, offsets), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in sorted(set(names)):
                held.setdefault(name, []).append(np.unique(codes[(names == name)[of]], return_counts=True))
                if len(held[name]) > 16:
                    held[name] = [_sum(held[name])]
        for name, parts in held.items():
            codes, n = _sum(parts)
            for a in range(0, len(codes), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes[part]), pa.string()), pa.array(codes[part].astype(np.int64)), pa.array(n[part].astype(np.int64))], names=["lang", "code", "n"])

    counted = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    often = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    kept_rows = counted.withColumn("r", F.row_number().over(often)).where(F.col("r") <= kept)
    number = F.element_at(F.create_map(*[x for j, k in enumerate(languages) for x in (F.lit(k), F.lit(j))]), F.col("lang"))

    def build(rows):
        import pickle

        import pyarrow as pa

        rows = rows.drop_null()
        lang, code, n = (rows.column(c).to_numpy() for c in ("lang", "code", "n"))
        made = model_of(languages, [(code[lang == j], n[lang == j]) for j in range(len(languages))])
        return pa.table({"model": pa.array([pickle.dumps(made)], pa.binary())})

    # one task, and LANGUAGES * GRAMS rows at most; an empty group of its own stands for a sample without strings
    nothing = spark.createDataFrame([(None, None, None)], "lang int, code long, n long")
    place = f"{shared_dir(spark)}/languages-{uuid.uuid4().hex}"
    rows = kept_rows.select(number.alias("lang"), "code", "n").unionByName(nothing)
    rows.groupBy(F.lit(0).alias("all")).applyInArrow(build, "model binary").write.parquet(place)
    return Stored(place)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


def predict(docs: DataFrame, model: Model | Stored | None, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, the columns to keep, lang_pred, score, bits_per_byte. score: the language's share, all being as likely before."""
    spark, keep = docs.sparkSession, [c for c in keep or [] if c != key]
    if model is None:
        model = model_of([UNKNOWN], [(np.zeros(0, np.int64), np.zeros(0, np.int64))])
    ship(spark)
    held = model if isinstance(model, Stored) else spark.sparkContext.broadcast(model)  # bounded by LANGUAGES and GRAMS
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(key), *keep, F.when(letter, F.col(text).cast("string")).alias("__text"), letter.alias("__letter"))
    schema = T.StructType([f for f in rows.schema if not f.name.startswith("__")])
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("bits_per_byte", T.DoubleType())

    def score(batches):
        import pyarrow as pa

        m = held.load() if isinstance(held, Stored) else held.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in slices(batches, len(schema) - 3):
            bytes_, offsets = text_buffer(batch.column("__text"))
            known = np.asarray(batch.column("__letter").to_numpy(zero_copy_only=False), dtype=bool)
            bits = text_bits(bytes_, offsets, m)
            least = bits.min(axis=1)
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            best = np.where(known, bits.argmin(axis=1), len(m.languages))
            per_byte = pa.array(least / np.maximum(np.diff(offsets), 1), mask=~known)
            found = [pa.array(names[best], pa.string()), pa.array(np.where(known & (names[best] != UNKNOWN), share, 0.0)), per_byte]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], names=schema.names)

    return rows.mapInArrow(score, schema)


def op4_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out, and predicts all."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~is_held_out()))
    return predict(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
