"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import cut, shared_dir, tidy
from ..session import ship as ship_code

__all__ = ["byte_table", "cut", "mix64", "shared_dir", "ship", "slices", "table", "text_buffer", "tidy", "written"]


#: Rows of a batch that goes to Python: texts make rows large.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """The package's code, and batches that fit rows of text."""
    ship_code(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed table: for what is large."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def slices(batches, column: int, most: int = 1 << 20):
    """The batches in pieces of about ``most`` bytes of text (one text at least), so that memory doesn't follow the batch size."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(column % batch.num_columns))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow string (or large string) array; nulls have length 0."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
