"""Substring deduplication with content-defined chunks.

A gear hash rolls over the bytes of a text; where its middle bits are small, a chunk ends. The decision looks at the last WINDOW
bytes only, so an insertion moves the cuts near it and no others, and a passage that stands in two texts is cut alike in both but
for its edges. Chunks are compared by digest over the whole table. Neighbouring chunks that occur elsewhere too form a
run; runs of LEAST bytes are repeated passages. The first occurrence of a chunk (in the order of the rows) is kept, the
others are removable.

The gear values are summed in halves (window 1, 2, 4, ...), so a batch costs a few array operations. The first
occurrence and the count of a digest are partial aggregates, and only repeated chunks are gathered by document, as a chunk list
of one text.

Defined cases: a null or empty text has no chunks; repeated rows are texts of their own, and repeat each other; passages that repeat
within one text count; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_table, mix64, shared_dir, ship, slices, table, text_buffer

#: A chunk ends where bits SHIFT to SHIFT + 7 of the hash are below CUT_BELOW: every 256 / CUT_BELOW bytes in the mean.
SHIFT, CUT_BELOW = 8, 11
WINDOW = SHIFT + 8
#: Longer chunks are split at multiples of this; shorter runs are not passages.
MOST, LEAST = 1024, 96
PACK = 2 * MOST

_GEAR = (byte_table(41) >> np.uint64(40)).astype(np.uint32)
_VALUE = byte_table(43)


def cuts(bytes_: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all chunks, ascending."""
    h, width = _GEAR[bytes_], 1
    while width < WINDOW:  # sum over 2 * width bytes from two sums over width bytes
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    ends = np.flatnonzero(((h >> np.uint32(SHIFT)) & np.uint32(255)) < CUT_BELOW) + 1
    first = offsets[:-1][np.diff(offsets) > 0]
    # within WINDOW bytes of its start, what stands before a text would play a part: no cuts there
    own = np.searchsorted(first, ends - 1, side="right") - 1
    ends = ends[(ends - first[own] >= WINDOW) & (ends < len(bytes_))]
    starts = np.union1d(first, ends)
    lengths = np.diff(np.append(starts, len(bytes_)))
    long = np.flatnonzero(lengths > MOST)
    more = [np.arange(starts[k] + MOST, starts[k] + lengths[k], MOST) for k in long.tolist()]
    return np.union1d(starts, np.concatenate(more)) if more else starts


def digests(bytes_: np.ndarray, starts: np.ndarray) -> np.ndarray:
    lengths = np.diff(np.append(starts, len(bytes_)))
    powers = np.full(MOST, 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    at = np.arange(len(bytes_)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(_VALUE[bytes_] * np.cumprod(powers)[at], starts)
    return mix64(sums ^ mix64(lengths.astype(np.uint64)))


def chunk_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, place, mark, digest) of every chunk, written to the shared folder.

    place is where the chunk starts, times PACK, plus its size. mark is twice the row, and one more where the text has had the
    chunk before: so marks order all occurrences, and a digest is repeated if it has two marks.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 2):
            bytes_, offsets = text_buffer(batch.column(2))
            if not len(bytes_):
                continue
            starts = cuts(bytes_, offsets)
            doc = np.searchsorted(offsets, starts, side="right") - 1
            digest = digests(bytes_, starts)
            order = np.lexsort((digest, doc))
            again = np.zeros(len(starts), dtype=np.int64)
            again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
            rows_ = batch.column(0).to_numpy()[doc]
            place = (starts - offsets[doc]) * PACK + np.diff(np.append(starts, len(bytes_)))
            columns = [pa.array(rows_), batch.column(1).take(pa.array(doc)), pa.array(place), pa.array(rows_ * 2 + again), pa.array(digest.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "place", "mark", "digest"])

    found = rows.mapInArrow(run, f"row long, key {kind}, place long, mark long, digest long")
    place = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    found.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(found.schema).parquet(place)


def passages(docs: DataFrame, *, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated passages: key, span_start, span_end (bytes), n_chunks, removable_bytes (those that stand in an earlier place)."""
    chunks = chunk_table(docs, key=key, text=text)
    repeated = chunks.groupBy("digest").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first < last").select("digest", "first")
    held = chunks.select("digest", "mark", "place").join(repeated, "digest")
    at, size = F.floor(F.col("place") / PACK), F.col("place") % PACK
    held = held.select(F.shiftright("mark", 1).alias("row"), at.alias("at"), size.alias("size"), F.when(F.col("mark") == F.col("first"), 0).otherwise(size).alias("removable"))
    inside = Window.partitionBy("row").orderBy("at")  # the repeated chunks of one text
    opens = F.when(F.lag(F.col("at") + F.col("size")).over(inside) == F.col("at"), 0).otherwise(1)
    runs = held.withColumn("opens", opens).withColumn("run", F.sum("opens").over(inside)).groupBy("row", "run").agg(
        F.min("at").alias("span_start"),
        F.max(F.col("at") + F.col("size")).alias("span_end"),
        F.count("*").alias("n_chunks"),
        F.sum("removable").alias("removable_bytes"),
    )
    keys = chunks.where(F.col("place") < PACK).select("row", "key")  # a text's first chunk starts at 0
    return (
        runs.where(F.col("span_end") - F.col("span_start") >= least)
        .join(keys, "row")
        .select(F.col("key").alias(key), "span_start", "span_end", "n_chunks", "removable_bytes")
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
