"""Bounded-space online packing of token ids into sequences of one length.

Each input partition is read once with a fixed number of open windows. A document's full sequences go straight out; its
remainder goes to the fullest window that has room for it (best fit). When none has room the fullest window is emitted: its
gap is filled with the head of the waiting piece where at least ``min_cut`` ids fit, and is padding otherwise. The windows left
at the end of the partitions are merged, some partitions at a time, level by level, until one sequence at most is not full.

Memory per task: ``windows`` sequences and one slice of texts. Merging moves ``windows`` sequences per partition, no more.

Ids are those of the ``tokenizers`` file. tiktoken gives the same several times as fast from the same vocabulary, with the file's added
tokens (<|endoftext|>, found inside a text too); a text with RUN blanks in a row, which its pattern cannot take, is encoded by
``tokenizers`` itself, and ``encoder(tokenizer="...json")`` uses nothing else.

Defined cases: a null text is an empty text, so the document is its end id alone; an empty table gives an empty result; repeated
rows are packed each on their own; other columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, ship, table

LENGTH = 1024
#: Open windows of a partition; ids below which a gap is left as padding; partitions whose leftovers are merged in one task.
WINDOWS, MIN_CUT, FAN_IN = 32, 16, 64
#: Blanks in a row from which tiktoken is not used.
RUN = 4096
#: Bytes of text that are encoded before their pieces are handed on.
SLICE = 4 << 20


@functools.cache
def encoder(tokenizer: str = "byte_bpe_50k.tiktoken"):
    """A function from text to an array of ids."""
    import public_tokenizers

    path = public_tokenizers.path(tokenizer)
    if tokenizer.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import base64
    import json

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(tokenizer.removesuffix(".tiktoken") + ".json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    own = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    blanks, library = re.compile(rf"\s{{{RUN}}}"), encoder(tokenizer.removesuffix(".tiktoken") + ".json")

    def encode(text: str) -> np.ndarray:
        if len(text) >= RUN and blanks.search(text):
            return library(text)
        return own.encode_to_numpy(text, allowed_special="all")

    return encode


class Windows:
    """Open sequences. A piece is (doc_id, start, ids, doc_tokens); emitted are lists of pieces."""

    def __init__(self, most: int, length: int, min_cut: int):
        self.most, self.length, self.min_cut = most, length, min_cut
        self.fill: list[int] = []  # ascending; held stands in the same order
        self.held: list[list[tuple]] = []

    def _put(self, fill: int, pieces: list[tuple]) -> None:
        k = bisect.bisect(self.fill, fill)
        self.fill.insert(k, fill)
        self.held.insert(k, pieces)

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        doc, start, ids, total = piece
        while len(ids) >= self.length:
            yield [(doc, start, ids[: self.length], total)]
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return
        k = bisect.bisect(self.fill, self.length - len(ids)) - 1  # the fullest with room
        if k >= 0:
            fill, pieces = self.fill.pop(k), self.held.pop(k)
        elif len(self.fill) < self.most:
            fill, pieces = 0, []
        else:
            full, out = self.fill.pop(), self.held.pop()
            if (gap := self.length - full) >= self.min_cut:
                out.append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            yield out
            fill, pieces = 0, []
        pieces.append((doc, start, ids, total))
        if fill + len(ids) == self.length:
            yield pieces
        elif len(ids):
            self._put(fill + len(ids), pieces)

    def merge(self) -> Iterator[list[tuple]]:
        """Fill the fullest windows from the emptiest, cutting where needed, until one window at most is open."""
        while len(self.fill) > 1:
            self.fill.pop(0)
            for piece in self.held.pop(0):
                doc, start, ids, total = piece
                while len(ids) and self.fill:
                    full, out = self.fill.pop(), self.held.pop()
                    gap = self.length - full
                    out.append((doc, start, ids[:gap], total))
                    start, ids = start + min(gap, len(ids)), ids[gap:]
                    if sum(len(p[2]) for p in out) == self.length:
                        yield out
                    else:
                        self._put(sum(len(p[2]) for p in out), out)
                if len(ids):
                    self._put(len(ids), [(doc, start, ids, total)])


def _schema(doc: T.DataType) -> T.StructType:
    fields = [("doc_id", doc), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType())]
    fields += [("sequence_id", T.LongType()), ("offset", T.LongType()), ("open", T.BooleanType()), ("part", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


class _Rows:
    """Columns of emitted pieces; sequence ids are level, partition and running number."""

    def __init__(self, level: int, part: int):
        self.level, self.part, self.next, self.rows = level, part, (level << 56) | (part << 32), []

    def add(self, pieces: list[tuple], is_open: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, at, is_open, self.part))
            at += len(ids)
        self.next += 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(
    docs: DataFrame, *, length: int = LENGTH, windows: int = WINDOWS, min_cut: int = MIN_CUT, end_id: int = 0, key: str = "doc_id", text: str = "text",
    tokenizer: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """A row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship(spark)
    schema = _schema(docs.schema[key].dataType)
    arrow = to_arrow_schema(schema)
    place = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"

    def stream(batches):
        from pyspark import TaskContext

        encode, open_, out = encoder(tokenizer), Windows(windows, length, min_cut), _Rows(0, TaskContext.get().partitionId())
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            waiting = 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py() or ""
                ids = np.concatenate([encode(body), end])
                for done in open_.place((doc, 0, ids, len(ids))):
                    out.add(done)
                waiting += len(body)
                if waiting > SLICE:
                    yield _batch(out.take(), arrow)
                    waiting = 0
            yield _batch(out.take(), arrow)
        for pieces in open_.held:
            out.add(pieces, is_open=True)
        yield _batch(out.take(), arrow)

    def save(df: DataFrame, level: int) -> DataFrame:
        """Partitioned by open, so that merging reads the leftovers only."""
        path = f"{place}/{level}"
        df.write.option("compression", "zstd").partitionBy("open").parquet(path)
        return spark.read.schema(schema).parquet(path)

    levels = [save(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(stream, schema), 0)]
    while True:
        left = levels[-1].where("open")
        top = left.agg(F.max("part").alias("part")).first().part
        if top is None or (top == 0 and len(levels) > 1):
            break
        level = len(levels)

        def merge(own):
            import pyarrow as pa

            open_, rows = Windows(1 << 30, length, min_cut), own.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
            out = _Rows(level, rows[0]["part"] // FAN_IN)
            held: dict[int, list[tuple]] = {}
            for r in rows:
                held.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"]))
            for pieces in held.values():
                open_._put(sum(len(p[2]) for p in pieces), pieces)
            for done in open_.merge():
                out.add(done)
            for pieces in open_.held:
                out.add(pieces, is_open=True)
            return pa.Table.from_batches([_batch(out.take(), arrow)])

        # a group holds FAN_IN * windows sequences at most
        levels.append(save(left.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(merge, schema), level))
    done = [x.where("NOT open") for x in levels[:-1]] + [levels[-1]]
    result = functools.reduce(DataFrame.unionByName, done)
    return result.select(F.col("doc_id").alias(key), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def op2_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
