"""Parquet tables, and the shapes that the operators read, derived from them.

Media time is seconds as a double. A line of n characters lasts n / 16 seconds: sixteenths are exact in binary, so sums are too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHARS_PER_SECOND = 16.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Timed lines (pos, start, end) from rows with a text column; lines without content go."""
    w = Window.partitionBy(group).orderBy(*order)
    lines = rows.where(F.trim("text") != "")
    end = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(CHARS_PER_SECOND)
    return (
        lines.withColumn("end", end)
        .withColumn("start", F.col("end") - F.length("text") / F.lit(CHARS_PER_SECOND))
        .withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    )


def document_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captions(video_id, pos, start, end, text): a document is a video, its lines are captions."""
    return captions_of(table(spark, sf_dir, "documents"))


def captions_of(docs: DataFrame) -> DataFrame:
    """captions of documents (doc_id, text), which stay where they are if they are dealt by doc_id."""
    # not a plain posexplode: Spark would look for empty arrays before documents are dealt
    rows = docs.select(F.col("doc_id").alias("video_id"), F.posexplode_outer(F.split("text", "\n")).alias("line", "text"))
    return lines_of(rows, "video_id", ["line"]).select("video_id", "pos", "start", "end", "text")


def conversation_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captions of conversations. The first line of a turn whose role is another than before is marked as a new speaker's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("other", F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(False)))
    rows = turns.select(F.col("conv_id").alias("video_id"), "turn", "other", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    marked = F.when(F.col("other") & (F.col("line") == 0), F.concat(F.lit(">> "), "text")).otherwise(F.col("text"))
    return lines_of(rows.withColumn("text", marked), "video_id", ["turn", "line"]).select("video_id", "pos", "start", "end", "text")


SQL_DOCUMENT_CAPTIONS = """
captions AS (
  SELECT video_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, CAST(sum(length(text)) OVER w / 16.0 AS DOUBLE) - length(text) / 16.0 AS start,
    CAST(sum(length(text)) OVER w / 16.0 AS DOUBLE) AS "end", text
  FROM (SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
  WHERE trim(text) <> '' WINDOW w AS (PARTITION BY video_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

SQL_CONVERSATION_CAPTIONS = """
turns AS (
  SELECT conv_id AS video_id, turn, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, false) AS other, string_split(text, chr(10)) AS lines FROM conversations
), turn_lines AS (
  SELECT video_id, turn, other, unnest(lines) AS text, generate_subscripts(lines, 1) AS line FROM turns
), captions AS (
  SELECT video_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, CAST(sum(length(text)) OVER w / 16.0 AS DOUBLE) - length(text) / 16.0 AS start,
    CAST(sum(length(text)) OVER w / 16.0 AS DOUBLE) AS "end", text
  FROM (SELECT video_id, turn, line, CASE WHEN other AND line = 1 THEN '>> ' || text ELSE text END AS text FROM turn_lines)
  WHERE trim(text) <> '' WINDOW w AS (PARTITION BY video_id ORDER BY turn, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""
