"""Queries of the payload parsers, settings and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..sources import payloads as P
from ..sources.tables import table
from . import Registry

registry = Registry()


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as caption payloads in milliseconds."""
    t = table(spark, sf_dir, "conversations")
    seg = F.struct((F.col("turn") * 2500).cast("string").alias("startMs"), (F.col("turn") * 2500 + 2000).cast("string").alias("endMs"), F.left("text", F.lit(50)).alias("text"))
    return t.groupBy(F.col("conv_id").alias("video_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", seg.alias("s")))), lambda x: x["s"])).alias("payload"))


@registry.query("SELECT conv_id AS video_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, left(text, 50)) - 1 AS INTEGER) AS pos, turn * 2.5::DOUBLE AS start, turn * 2.5::DOUBLE + 2.0::DOUBLE AS \"end\", left(text, 50) AS text FROM conversations")
def segment_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.segment_captions(_payloads(spark, sf_dir))


@registry.query("SELECT doc_id AS video_id, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 2 WHEN doc_id % 2 = 0 THEN 1 WHEN lang = 'en' THEN 0 ELSE 0 END AS track FROM documents")
def caption_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document has a track in its language, an automatic English one if even, and a written one if also a third."""
    d = table(spark, sf_dir, "documents")
    tracks = F.concat(
        F.array(F.struct(F.lit(0).alias("track"), F.when(F.col("doc_id") % 2 == 0, F.lit("xx")).otherwise(F.col("lang")).alias("lang"), F.lit(True).alias("auto"))),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(1).alias("track"), F.lit("en").alias("lang"), F.lit(True).alias("auto")))).otherwise(F.array().cast("array<struct<track:int,lang:string,auto:boolean>>")),
        F.when(F.col("doc_id") % 6 == 0, F.array(F.struct(F.lit(2).alias("track"), F.lit("en").alias("lang"), F.lit(False).alias("auto")))).otherwise(F.array().cast("array<struct<track:int,lang:string,auto:boolean>>")),
    )
    return P.chosen_track(d.select(F.col("doc_id").alias("video_id"), F.explode(tracks).alias("t")).select("video_id", "t.*"))


@registry.query("WITH n AS (SELECT doc_id AS video_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT video_id, CASE WHEN n >= 3 THEN 'given' WHEN n >= 2 THEN 'captions' ELSE 'speech' END AS source FROM n")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given lines need three, captions one (here two), speech any."""
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.size(F.split("text", "\n")).alias("entries"))
    names = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("priority")) for k, s in enumerate(("given", "captions", "speech"))])
    return P.best_source(n.select("video_id", "entries", F.explode(names).alias("s")).select("video_id", "entries", "s.*"), {"given": 3, "captions": 2, "speech": 0})


@registry.query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN left(md5(url), 11) WHEN 1 THEN left(md5(url), 11) END AS video FROM pages")
def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.left(F.md5(F.col("url").cast("binary")), F.lit(11))
    given = F.when(F.col("page_id") % 3 == 0, key).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://host/watch?v="), key, F.lit("&t=3"))).otherwise(F.lit("no address"))
    return table(spark, sf_dir, "pages").select("page_id", P.video_id(given).alias("video"))


@registry.query("SELECT conv_id AS video_id, turn * 10 // 20 AS start, arg_min(role, turn) AS title FROM conversations GROUP BY ALL")
def chapter_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.expr("turn * 10 div 20").alias("start"), F.col("role").alias("title"), F.col("turn").alias("seq"))
    return P.chapter_markers(t)


@registry.query("WITH s AS (SELECT doc_id AS video_id, CAST(i AS INTEGER) AS level, CAST(48 * (i + 1) AS INTEGER) AS width, CAST(27 * (i + 1) AS INTEGER) AS height, 100 AS count, 10 AS cols, 5 AS rows, CAST(CASE WHEN i = 0 THEN floor(n_chars / 16.0 * 1000 / 100) ELSE 5000 END AS INTEGER) AS interval FROM documents, range(2) r(i)) SELECT * FROM s")
def storyboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), (F.col("n_chars") / F.lit(16.0)).alias("duration"), F.lit("https://host/$L|48#27#100#10#5#0#d|96#54#100#10#5#5000#d").alias("spec"))
    return P.storyboard(d)


@registry.query("WITH f AS (SELECT event_id, greatest(0, least(CAST(floor(value * 1000 / 2000) AS INTEGER), 99)) AS frame FROM events) SELECT event_id, frame, CAST(frame // 50 AS INTEGER) AS sheet, CAST(frame % 50 // 10 AS INTEGER) AS \"row\", CAST(frame % 10 AS INTEGER) AS col FROM f")
def storyboard_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = P.frame_place(F.col("value"), F.lit(2000), F.lit(100), F.lit(10), F.lit(5))
    return table(spark, sf_dir, "events").select("event_id", place.alias("p")).select("event_id", "p.*")


@registry.query("SELECT event_id, CAST(props::JSON->>'k' AS INTEGER) AS k FROM events")
def json_in_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON found fenced, bare or inside prose."""
    e = table(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" - done")))
    return e.select("event_id", F.try_variant_get(P.first_json(answer), "$.k", "int").alias("k"))


@registry.query("WITH u AS (SELECT user_id AS map_id, event_id, value AS coverage FROM events) SELECT map_id, max(coverage) AS coverage, arg_max(event_id, (coverage, event_id)) AS event_id FROM u GROUP BY map_id")
def upsert_most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored map gives way only to one that is as complete or more."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("map_id"), F.col("value").alias("coverage"), "event_id")
    return P.latest(rows, "map_id", F.struct("coverage", "event_id")).select("map_id", "coverage", "event_id")


@registry.query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'en' END AS language, CASE WHEN source = 'src1' THEN NULL ELSE source END AS theme FROM documents")
def migrated_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings: unknown values fall back, removed keys go."""
    stored = F.create_map(F.lit("language"), "lang", F.lit("theme"), "source", F.lit("old"), F.lit("x"))
    kept = F.map_filter(stored, lambda k, v: (k != "old") & ~((k == "theme") & (v == "src1")))
    valid = F.transform_values(kept, lambda k, v: F.when((k == "language") & ~v.isin("en", "de"), F.lit("en")).otherwise(v))
    return table(spark, sf_dir, "documents").select("doc_id", valid.alias("m")).select("doc_id", F.try_element_at("m", F.lit("language")).alias("language"), F.try_element_at("m", F.lit("theme")).alias("theme"))


@registry.query("SELECT conv_id, turn, array_to_string(CASE WHEN list_contains(t, role) THEN list_filter(t, lambda x: x <> role) ELSE list_append(t, role)[-3:] END, ',') AS tones, greatest(0, least(coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn AS INTEGER) - 2 END, 3), 3)) AS index FROM (SELECT conv_id, turn, role, ['calm', CASE WHEN turn % 2 = 0 THEN role ELSE 'dry' END, 'warm'] AS t FROM conversations)")
def tone_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toggling a tone keeps the last three; an insert index stays within the list."""
    t = F.array(F.lit("calm"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit("dry")), F.lit("warm"))
    index = F.when(F.col("turn") % 3 == 0, F.lit(None)).otherwise(F.col("turn").cast("int") - 2)
    c = table(spark, sf_dir, "conversations").withColumn("t", t)
    toggled = F.when(F.array_contains("t", F.col("role")), F.array_remove("t", F.col("role"))).otherwise(F.slice(F.array_append("t", F.col("role")), -3, 3))
    return c.select("conv_id", "turn", F.array_join(toggled, ",").alias("tones"), F.greatest(F.lit(0), F.least(F.coalesce(index, F.lit(3)), F.lit(3))).alias("index"))


@registry.query("SELECT source AS map_id, count(*) AS nodes, coalesce(max(lang), 'untitled') AS title, CAST(rank() OVER (ORDER BY max(doc_id) DESC) AS INTEGER) AS place FROM documents GROUP BY source")
def library_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps with their sizes, newest first."""
    m = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("map_id")).agg(F.count("*").alias("nodes"), F.coalesce(F.max("lang"), F.lit("untitled")).alias("title"), F.max("doc_id").alias("at"))
    return ranked(m, [F.desc("at")], "place").withColumn("place", F.col("place").cast("int")).drop("at")
