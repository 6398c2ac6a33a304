"""Queries of the timeline operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import timeline as T
from ..sources.tables import SQL_CONVERSATION_CAPTIONS, SQL_DOCUMENT_CAPTIONS, conversation_captions, document_captions, table
from . import Registry
from .text import WORDS, sql_clean, sql_clock, sql_sentences, sql_truncated, sql_unescape

registry = Registry()

SQL_ENTRIES = f"""
cleaned AS (SELECT video_id, pos, start, "end", {sql_clean('text')} AS text, regexp_matches({sql_unescape('text')}, '{L.NEW_SPEAKER}') AS new_speaker FROM captions),
unrepeated AS (SELECT * FROM cleaned WHERE text <> '' QUALIFY coalesce(lag(lower(text)) OVER (PARTITION BY video_id ORDER BY pos) <> lower(text), true)),
entries AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start, pos) - 1 AS INTEGER) AS idx, start, greatest("end", start + 0.5) AS "end", text, new_speaker FROM unrepeated)"""


def sql_blocks(seconds: float, name: str = "blocks") -> str:
    cut = f"(e.new_speaker OR e.\"end\" - b.first > {seconds * T.OVER} OR (e.\"end\" - b.first > {seconds} AND regexp_matches(b.text, '[.?!]$')))"
    return f"""
folded AS (
  SELECT video_id, idx, start AS first, text, 0 AS block_no FROM entries WHERE idx = 0
  UNION ALL
  SELECT e.video_id, e.idx, CASE WHEN {cut} THEN e.start ELSE b.first END, e.text, b.block_no + CASE WHEN {cut} THEN 1 ELSE 0 END
  FROM folded b JOIN entries e ON e.video_id = b.video_id AND e.idx = b.idx + 1
), {name} AS (
  SELECT e.video_id, CAST(block_no AS INTEGER) AS block_no, arg_min(e.start, e.idx) AS start, arg_max(e."end", e.idx) AS "end", string_agg(e.text, ' ' ORDER BY e.idx) AS text,
    arg_min(e.new_speaker, e.idx) AS new_speaker FROM folded f JOIN entries e USING (video_id, idx) GROUP BY e.video_id, block_no
)"""


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS}, {SQL_ENTRIES} SELECT * FROM entries")
def captions_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.normalized(document_captions(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.normalized(conversation_captions(spark, sf_dir))


@registry.query(f"WITH RECURSIVE {SQL_CONVERSATION_CAPTIONS}, {SQL_ENTRIES}, {sql_blocks(T.BLOCK)} SELECT * FROM blocks")
def caption_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.blocks(_entries(spark, sf_dir))


@registry.query(
    f"""WITH RECURSIVE {SQL_CONVERSATION_CAPTIONS}, {SQL_ENTRIES}, {sql_blocks(T.SENTENCE_BLOCK)},
parts AS (SELECT *, {sql_sentences('text')} AS ps FROM blocks),
each AS (SELECT *, unnest(ps) AS sentence, generate_subscripts(ps, 1) AS part, greatest(length(array_to_string(ps, '')), 1) AS total FROM parts)
SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY block_no, part) - 1 AS INTEGER) AS sent_no,
  start + ("end" - start) * length(array_to_string(ps[1:part - 1], '')) / total AS start, start + ("end" - start) * length(array_to_string(ps[1:part], '')) / total AS "end",
  sentence AS text, new_speaker AND len(ps) = 1 AS new_speaker FROM each"""
)
def sentences_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.timed_sentences(_entries(spark, sf_dir))


_WORDS_N = f"len({WORDS.format('e.text')})"


@registry.query(
    f"""WITH RECURSIVE {SQL_CONVERSATION_CAPTIONS}, {SQL_ENTRIES}, folded AS (
  SELECT video_id, idx, start AS first, {_WORDS_N} AS words, 0 AS unit_no,
    (regexp_matches(text, '[.?!।॥؟。？！]$') AND "end" - start >= 2.5) OR "end" - start >= 10 OR {_WORDS_N} >= 40 AS closed FROM entries e WHERE idx = 0
  UNION ALL
  SELECT video_id, idx, first, words, unit_no, (regexp_matches(text, '[.?!।॥؟。？！]$') AND "end" - first >= 2.5) OR "end" - first >= 10 OR words >= 40 FROM (
    SELECT e.video_id, e.idx, e.text, e."end", CASE WHEN b.closed THEN e.start ELSE b.first END AS first, {_WORDS_N} + CASE WHEN b.closed THEN 0 ELSE b.words END AS words,
      b.unit_no + CASE WHEN b.closed THEN 1 ELSE 0 END AS unit_no FROM folded b JOIN entries e ON e.video_id = b.video_id AND e.idx = b.idx + 1)
) SELECT e.video_id, CAST(unit_no AS INTEGER) AS unit_no, arg_min(e.start, e.idx) AS start, arg_max(e."end", e.idx) AS "end", string_agg(e.text, ' ' ORDER BY e.idx) AS text,
  arg_min(e.new_speaker, e.idx) AS new_speaker FROM folded f JOIN entries e USING (video_id, idx) GROUP BY e.video_id, unit_no"""
)
def translation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.units(_entries(spark, sf_dir))


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS} SELECT video_id, pos, CAST(row_number() OVER (PARTITION BY video_id ORDER BY
  CASE WHEN pos % 8 = 0 THEN 0 WHEN pos % 4 = 0 THEN 1 WHEN pos % 2 = 0 THEN 2 ELSE 3 END, pos) AS INTEGER) AS visit FROM captions"""
)
def stride_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy(T.stride_rank(F.col("pos")), "pos")
    return document_captions(spark, sf_dir).select("video_id", "pos", F.row_number().over(w).alias("visit"))


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line of a conversation is a chapter; some descriptions are none."""
    rows = conversation_captions(spark, sf_dir)
    title = F.concat(F.lit(" ["), X.clock(F.col("start")), F.lit("] - "), X.truncated(F.col("text"), 40))
    marked = rows.where("pos % 5 = 0").groupBy("video_id").agg(F.expr("max(`end`)").alias("duration"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", title.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    return marked.select("video_id", F.when(F.col("video_id") % 3 == 0, F.lit(None)).otherwise(F.col("duration")).alias("duration"), F.concat(F.lit("Intro\n"), "t", F.lit("\nbye")).alias("description"))


_SQL_CHAPTERS = f"""
marks AS (SELECT video_id, pos, "end", ' [' || {sql_clock('start')} || '] - ' || {sql_truncated('text', 40)} AS t FROM captions WHERE pos % 5 = 0),
lines AS (SELECT video_id, pos, max("end") OVER (PARTITION BY video_id) AS m, regexp_extract(t, '{T.CHAPTER_LINE}', 1) AS stamp, trim(regexp_extract(t, '{T.CHAPTER_LINE}', 2), ' -–—') AS title FROM marks WHERE regexp_matches(t, '{T.CHAPTER_LINE}')),
timed AS (SELECT *, list_reduce(list_transform(string_split(stamp, ':'), lambda p: CAST(p AS DOUBLE)), lambda a, x: a * 60 + x) AS start, CASE WHEN video_id % 3 <> 0 THEN m END AS duration FROM lines),
kept AS (SELECT * FROM timed QUALIFY count(*) OVER (PARTITION BY video_id) >= 2 AND arg_min(start, pos) OVER (PARTITION BY video_id) <= 1),
chapters AS (SELECT video_id, CAST(row_number() OVER w - 1 AS INTEGER) AS chap_no, title, start, coalesce(lead(start) OVER w, CASE WHEN duration <> 0 THEN duration END, start + 60) AS "end"
  FROM kept WINDOW w AS (PARTITION BY video_id ORDER BY start, pos))"""


@registry.query(f"WITH {SQL_CONVERSATION_CAPTIONS}, {_SQL_CHAPTERS} SELECT * FROM chapters")
def chapters_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chapters(_descriptions(spark, sf_dir))


@registry.query(
    f"""WITH RECURSIVE {SQL_CONVERSATION_CAPTIONS}, {SQL_ENTRIES}, {sql_blocks(T.SENTENCE_BLOCK)}, {_SQL_CHAPTERS},
spans AS (SELECT *, lead(start) OVER (PARTITION BY video_id ORDER BY start, chap_no) AS until FROM chapters),
held AS (SELECT b.*, s.chap_no, s.title, row_number() OVER (PARTITION BY b.video_id, chap_no ORDER BY block_no) AS rank FROM blocks b JOIN spans s ON b.video_id = s.video_id AND b.start >= s.start - 1 AND (until IS NULL OR b.start < until)),
numbered AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY video_id ORDER BY chap_no) AS INTEGER) AS seg_no FROM held)
SELECT video_id, seg_no, title, min(start) AS start, arg_max("end", block_no) AS "end", count(*) AS n_blocks, count(*) FILTER (new_speaker AND rank > 1) + 1 AS speakers, string_agg(text, ' ' ORDER BY block_no) AS text
FROM numbered GROUP BY video_id, seg_no, title"""
)
def chapter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chapter_segments(T.blocks(_entries(spark, sf_dir), T.SENTENCE_BLOCK), T.chapters(_descriptions(spark, sf_dir)))


SQL_GAPS = """
v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER w - 1 AS gap, lag(CAST(embedding AS DOUBLE[]), 1) OVER w AS l1, lag(CAST(embedding AS DOUBLE[]), 2) OVER w AS l2,
  lead(CAST(embedding AS DOUBLE[]), 1) OVER w AS r1 FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
s AS (SELECT label, CAST(gap AS INTEGER) AS gap, list_cosine_similarity(CASE WHEN l2 IS NULL THEN l1 ELSE list_transform(l1, lambda x, i: x + l2[i]) END,
  CASE WHEN r1 IS NULL THEN e ELSE list_transform(e, lambda x, i: x + r1[i]) END) AS similarity FROM v WHERE gap > 0),
m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY label) >= 3 THEN (coalesce(lag(similarity) OVER w, similarity) + similarity + coalesce(lead(similarity) OVER w, similarity)) / 3 ELSE similarity END AS smooth
  FROM s WINDOW w AS (PARTITION BY label ORDER BY gap)),
gaps AS (SELECT *, max(smooth) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + max(smooth) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * smooth AS depth
  FROM m WINDOW w AS (PARTITION BY label ORDER BY gap))"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return T.gap_depths(rows, "label", "vec_id", "e")


@registry.query(f"WITH {SQL_GAPS} SELECT label, gap, round(similarity, 6) AS similarity, round(smooth, 6) AS smooth, round(depth, 6) AS depth FROM gaps")
def gap_depth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("label", "gap", *[F.round(c, 6).alias(c) for c in ("similarity", "smooth", "depth")])


@registry.query()
def topic_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each label's row of vectors, every vector lasting 25 seconds."""
    gaps = _gaps(spark, sf_dir).withColumn("start", F.col("gap") * 25.0).withColumn("n", F.count("*").over(Window.partitionBy("label")) + 1)
    return T.boundaries(gaps.withColumn("duration", F.col("n") * 25.0).withColumn("n", F.col("n").cast("int")), "label", "deep")


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS}, d AS (SELECT video_id, max("end") AS duration, CAST(count(*) AS INTEGER) AS n FROM captions GROUP BY video_id)
SELECT video_id, duration, {", ".join(f"greatest(1, least(greatest({low}, least({high}, CAST(round_even(duration / {per}, 0) AS INTEGER))), n)) AS {m}" for m, (per, low, high) in T.MODES.items())} FROM d"""
)
def section_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_captions(spark, sf_dir).groupBy("video_id").agg(F.max("end").alias("duration"), F.count("*").cast("int").alias("n"))
    return d.select("video_id", "duration", *[T.section_target(F.col("duration"), F.col("n"), m).alias(m) for m in T.MODES])


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS} SELECT video_id, max_by(\"end\", pos) AS duration, string_agg(text, ' ' ORDER BY pos) AS full_text FROM captions GROUP BY video_id")
def full_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_captions(spark, sf_dir).groupBy("video_id").agg(F.max_by("end", "pos").alias("duration"), F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY pos)").alias("full_text"))
