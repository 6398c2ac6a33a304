"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key, so that a key's rows are read alone; a later save replaces the keys that it holds."""
    df.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def read_key(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    return spark.read.parquet(path).where(F.col(key) == value)


def save_lines(lines: DataFrame, path: str, order: str = "path", line: str = "line") -> None:
    """Text files of the lines in order: sorted by range, so that the files follow each other."""
    lines.orderBy(order).select(line).write.mode("overwrite").text(path)


def save_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
