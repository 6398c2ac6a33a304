"""Queries of retrieval, cards and the label protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import labels as B
from ..operators import retrieval as R
from ..operators import timeline as T
from ..operators.average_link import themes
from ..sources.tables import SQL_DOCUMENT_CAPTIONS, document_captions, table
from . import Registry
from .text import WORDS, sql_clean, sql_clock, sql_truncated

registry = Registry()
QUESTION = "the thing with of reason and token"
_WORDS3, _WORDS4 = R.query_words(QUESTION, 3), R.query_words(QUESTION, 4)
_share = lambda c, ws: "(" + " + ".join(f"CASE WHEN contains({c}, '{w}') THEN 1.0 ELSE 0.0 END" for w in ws) + f") / {float(len(ws))}::DOUBLE"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the likeness of the vector of the same number, where there is one, to vector 0."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    query = F.array(*[F.lit(float(x)) for x in rows.where("doc_id = 0").first().v])
    return table(spark, sf_dir, "documents").join(rows, "doc_id", "left").withColumn("cosine", T.cosine(F.col("v"), query)).drop("v")


_SQL_V = "v AS (SELECT d.*, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS cosine FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"


@registry.query(
    f"""WITH {_SQL_V}, s AS (SELECT doc_id, round(coalesce(cosine, 0) * 0.75 + {_share('lower(text)', _WORDS3)} * 0.35 + CASE WHEN doc_id % 3 = 0 THEN 0.05 ELSE 0.0 END, 4) AS score FROM v),
t AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 12) SELECT * FROM t WHERE score >= greatest(0.15, 0.45 * (SELECT max(score) FROM t))"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = R.hybrid_score(F.coalesce("cosine", F.lit(0.0)), F.lower("text"), _WORDS3, F.col("doc_id") % 3 == 0)
    return R.best(_vectors(spark, sf_dir).select("doc_id", F.round(score, 4).alias("score")), 12, "doc_id")


@registry.query()
def retrieved_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five to eight lines of each document for a question, within the token budget."""
    lines = document_captions(spark, sf_dir).withColumn("score", R.word_share(F.lower("text"), _WORDS4) + F.when(F.col("start") <= 30, 0.15).otherwise(0.0))
    return R.within_budget(lines, ["video_id"], [F.desc("score"), F.col("pos")])


_NEAR = f"CASE WHEN start <= 20 THEN 1.5 ELSE 0.0 END + {_share('lower(text)', _WORDS4)} * {len(_WORDS4)}"


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS}, s AS (SELECT *, {_NEAR} AS score FROM captions), t AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, pos) AS n FROM s WHERE score > 0 AND length(text) > 15)
SELECT video_id, string_agg('• [' || {sql_clock('start')} || '] ' || {sql_truncated('text', 220)}, chr(10) ORDER BY start, pos) AS answer FROM t WHERE n <= 4 GROUP BY video_id"""
)
def offline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four lines that share the most words with the question, in time order."""
    near = F.when(F.col("start") <= 20, F.lit(1.5)).otherwise(F.lit(0.0))
    lines = document_captions(spark, sf_dir).withColumn("score", near + R.word_share(F.lower("text"), _WORDS4) * len(_WORDS4)).where((F.col("score") > 0) & (F.length("text") > 15))
    top = lines.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy(F.round("score", 9).desc(), "pos"))).where("n <= 4")
    line = F.concat(F.lit("• ["), X.clock(F.col("start")), F.lit("] "), X.truncated(F.col("text"), 220))
    return top.withColumn("line", line).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "pos", "line"))), lambda x: x["line"]), "\n").alias("answer"))


_SCORE = "CASE WHEN t = q THEN 1.0 WHEN contains(t, q) THEN 0.85 - least(0.3, (length(t) - length(q)) / 400.0) ELSE 0.7 * (CASE WHEN contains(t, 'the') THEN 0.5 ELSE 0.0 END + CASE WHEN contains(t, 'thing') THEN 0.5 ELSE 0.0 END) END"


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS}, s AS (SELECT video_id, pos, lower(text) AS t, 'the thing' AS q FROM captions), r AS (SELECT video_id, pos, round({_SCORE}, 6) AS score FROM s) SELECT video_id, pos, score, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM r WHERE score > 0.2 QUALIFY rank <= 10")
def local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best lines of each document for a search that needs no vectors."""
    r = document_captions(spark, sf_dir).select("video_id", "pos", F.round(X.fuzzy_score(F.lit("the thing"), F.col("text")), 6).alias("score")).where("score > 0.2")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "pos"))).where("rank <= 10")


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS}, s AS (SELECT video_id, pos, lower(text) AS t, 'the thing' AS q FROM captions), r AS (SELECT video_id, pos, round({_SCORE} + CASE WHEN pos % 4 = 0 THEN 0.05 ELSE 0 END, 6) AS score FROM s) SELECT video_id, arg_max(pos, (score, -pos)) AS node FROM r WHERE score > 0.25 GROUP BY video_id")
def named_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that a spoken name means."""
    bonus = F.when(F.col("pos") % 4 == 0, 0.05).otherwise(0.0)
    r = document_captions(spark, sf_dir).select("video_id", "pos", F.round(X.fuzzy_score(F.lit("the thing"), F.col("text")) + bonus, 6).alias("score")).where("score > 0.25")
    return r.groupBy("video_id").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("node"))


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS}, p AS (SELECT video_id, pos // 8 AS section, pos, start, row_number() OVER (PARTITION BY video_id, pos // 8 ORDER BY pos) AS turn FROM captions WHERE length(text) > 25),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY turn, section) AS n FROM p) SELECT video_id, pos, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start, pos) AS INTEGER) AS place FROM n WHERE n <= 6"""
)
def recall_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six lines to recall a document by, dealt from its sections in turn, in time order."""
    rows = document_captions(spark, sf_dir).where(F.length("text") > 25).withColumn("section", F.floor(F.col("pos") / 8))
    held = R.round_robin(rows, "video_id", "section", "pos", 6)
    return held.select("video_id", "pos", F.row_number().over(Window.partitionBy("video_id").orderBy("start", "pos")).alias("place"))


_ORDER = "CASE tag WHEN 'Def' THEN 0 WHEN 'Formula' THEN 1 WHEN 'Eg' THEN 2 WHEN 'Tip' THEN 3 WHEN 'Watch-out' THEN 4 ELSE 5 END"
_TAG = "CASE pos % 6 WHEN 0 THEN 'Eg' WHEN 1 THEN 'Tip' WHEN 2 THEN 'Def' WHEN 4 THEN 'Tip' END"


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS}, t AS (SELECT video_id, pos, {_TAG} AS tag FROM captions), f AS (SELECT *, row_number() OVER (PARTITION BY video_id, tag ORDER BY pos) AS k FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN tag IS NOT NULL AND k = 1 THEN 0 ELSE 1 END, pos) AS n FROM f)
SELECT video_id, pos, tag, CAST(row_number() OVER (PARTITION BY video_id ORDER BY {_ORDER}, pos) AS INTEGER) AS place FROM r WHERE n <= 5"""
)
def tag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each tag, then the rest, five in all, in the order of the tags."""
    t = document_captions(spark, sf_dir).select("video_id", "pos", F.expr(_TAG).alias("tag"))
    k = F.row_number().over(Window.partitionBy("video_id", "tag").orderBy("pos"))
    later = F.when(F.col("tag").isNotNull() & (F.col("k") == 1), 0).otherwise(1)
    r = t.withColumn("k", k).withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy(later, "pos"))).where("n <= 5")
    return r.select("video_id", "pos", "tag", F.row_number().over(Window.partitionBy("video_id").orderBy(F.expr(_ORDER), "pos")).alias("place"))


@registry.query("WITH f AS (SELECT label, vec_id, abs(embedding[1]::DOUBLE) AS density, abs(embedding[2]::DOUBLE - lag(embedding[2]::DOUBLE) OVER (PARTITION BY label ORDER BY vec_id)) AS change FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY change * density DESC, vec_id) AS n FROM f WHERE change > 0.05 AND density > 0.02 AND density < 0.25) SELECT label, vec_id, round(change * density, 9) AS score FROM k WHERE n <= 8")
def keyframe_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that change and are neither empty nor crowded, the best eight of each label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = lambda k: F.element_at("embedding", k).cast("double")
    f = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.abs(e(1)).alias("density"), F.abs(e(2) - F.lag(e(2)).over(w)).alias("change"))
    k = f.where("change > 0.05 AND density > 0.02 AND density < 0.25").withColumn("score", F.col("change") * F.col("density"))
    top = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return k.withColumn("n", top).where("n <= 8").select("label", "vec_id", F.round("score", 9).alias("score"))


@registry.query("WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: list_avg(list_transform(vs, lambda v: v[i]))) AS m FROM (SELECT label, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS vs FROM embeddings GROUP BY label)) SELECT label, arg_max(vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), m), 9)) AS nearest FROM embeddings JOIN c USING (label) GROUP BY label")
def centroid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each label that is nearest to the label's mean."""
    rows = table(spark, sf_dir, "embeddings")
    dims = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    held = rows.join(mean, "label").select("label", "vec_id", F.round(T.dot(F.col("embedding").cast("array<double>"), F.col("m")), 9).alias("s"))
    return held.groupBy("label").agg(F.max_by("vec_id", "s").alias("nearest"))


_SQL_MMR = """WITH v AS (SELECT label, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY ALL), m AS (SELECT label, list(x ORDER BY i) AS m FROM d GROUP BY label),
r AS (SELECT v.*, least(1, greatest(-1, list_dot_product(v, m))) AS rel FROM v JOIN m USING (label)),
c1 AS (SELECT label, arg_max(id, (round(0.7 * rel, 12), -id)) AS id FROM r GROUP BY label), p1 AS (SELECT r.* FROM r JOIN c1 USING (label, id)),
r2 AS (SELECT r.*, list_dot_product(r.v, p1.v) AS near FROM r JOIN p1 ON p1.label = r.label AND p1.id <> r.id),
c2 AS (SELECT label, arg_max(id, (round(0.7 * rel - 0.3 * near, 12), -id)) AS id FROM r2 GROUP BY label), p2 AS (SELECT r.* FROM r JOIN c2 USING (label, id)),
r3 AS (SELECT r2.label, r2.id, r2.rel, greatest(near, list_dot_product(r2.v, p2.v)) AS near FROM r2 JOIN p2 ON p2.label = r2.label AND p2.id <> r2.id),
c3 AS (SELECT label, arg_max(id, (round(0.7 * rel - 0.3 * near, 12), -id)) AS id FROM r3 GROUP BY label)
SELECT label, id, CAST(1 AS BIGINT) AS pick FROM c1 UNION ALL SELECT label, id, 2 FROM c2 UNION ALL SELECT label, id, 3 FROM c3"""


@registry.query(_SQL_MMR)
def mmr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), "embedding")
    return R.mmr(rows, "label", "embedding", 3)


@registry.query()
def vector_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the sections of videos, a dozen to each."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 12).alias("video_id"), F.col("vec_id").alias("id"), "embedding")
    return themes(rows, "video_id", "embedding")


@registry.query()
def label_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of all vectors of a label, however many it has."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), "embedding")
    return themes(rows, "label", "embedding")


@registry.query(f"WITH {_SQL_V} SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 1) > 0.6 AND cosine IS NOT NULL THEN round(greatest(0, cosine), 2) END AS faith FROM v")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near a label is to what it stands for; only Latin text has a value."""
    return _vectors(spark, sf_dir).select("doc_id", F.when((X.ascii_share(F.col("text")) > 0.6) & F.col("cosine").isNotNull(), F.round(F.greatest(F.lit(0.0), "cosine"), 2)).alias("faith"))


@registry.query("SELECT source, coalesce(avg(CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 1.0) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return held.groupBy("source").agg(F.coalesce(F.avg(F.coalesce("has", F.lit(0)).cast("double")), F.lit(1.0)).alias("coverage"))


_CARD = "CASE WHEN doc_id % 3 = 0 THEN left(text, 9) || ': ' || lang || ' ' || source ELSE left(text, 14) END"


@registry.query(
    f"""WITH c AS (SELECT doc_id, source, {_CARD} AS t, 'part of ' || source AS summary FROM documents),
s AS (SELECT doc_id, source, CASE WHEN contains(t, ':') THEN trim(split_part(t, ':', 1)) ELSE t END AS term, CASE WHEN contains(t, ':') THEN trim(substring(t, instr(t, ':') + 1)) ELSE summary END AS meaning FROM c)
SELECT source, doc_id, 'What is meant by “' || term || '”?' AS front, meaning AS back FROM s WHERE meaning <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 12"""
)
def flashcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve cards of each source."""
    c = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(_CARD).alias("t"), F.concat(F.lit("part of "), "source").alias("summary"))
    term, meaning = B.card_sides(F.col("t"), F.col("summary"))
    s = c.select("source", "doc_id", F.concat(F.lit("What is meant by “"), term, F.lit("”?")).alias("front"), meaning.alias("back")).where("back <> ''")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 12").drop("n")


@registry.query(
    """WITH c AS (SELECT item_id, item_id % 4 AS quiz, left(text, 20) AS term, substring(text, 21, 30) AS meaning, row_number() OVER (PARTITION BY item_id % 4 ORDER BY md5(CAST(item_id AS VARCHAR))) - 1 AS n, count(*) OVER (PARTITION BY item_id % 4) AS k FROM benchmark)
SELECT c.quiz, c.item_id, 'Which statement best describes “' || c.term || '”?' AS question, c.meaning AS answer, a.meaning || ' | ' || b.meaning || ' | ' || d.meaning AS distractors
FROM c JOIN c a ON a.quiz = c.quiz AND a.n = (c.n + 1) % c.k JOIN c b ON b.quiz = c.quiz AND b.n = (c.n + 2) % c.k JOIN c d ON d.quiz = c.quiz AND d.n = (c.n + 3) % c.k WHERE c.k > 3"""
)
def quiz_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each item of a quiz; the wrong answers are those of the next three items in hash order, round the ring."""
    c = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("quiz"), F.left("text", F.lit(20)).alias("term"), F.substring("text", 21, 30).alias("meaning"))
    w = Window.partitionBy("quiz").orderBy(F.md5(F.col("item_id").cast("string").cast("binary")))
    left = F.col("k") - F.col("n")  # rows from here to the end, this one too
    after = [F.coalesce(F.lead("meaning", j).over(w), F.get("heads", j - left)) for j in (1, 2, 3)]
    held = c.withColumn("n", F.row_number().over(w) - 1).withColumn("k", F.count("*").over(Window.partitionBy("quiz")))
    first = held.where("n < 3").groupBy("quiz").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "meaning"))), lambda x: x["meaning"]).alias("heads"))
    out = held.join(first, "quiz").where("k > 3").withColumn("distractors", F.concat_ws(" | ", *after))
    return out.select("quiz", "item_id", F.concat(F.lit("Which statement best describes “"), "term", F.lit("”?")).alias("question"), F.col("meaning").alias("answer"), "distractors")


_ANSWER = "'R|' || left(replace(text, chr(10), ' '), 30) || chr(10) || '- S|s1|' || lang || ' part|about ' || source || chr(10) || '**C**|c1|' || source || '|' || left(replace(text, chr(10), ' '), 20) || chr(10) || 'D|c1|Def|is ' || lang || chr(10) || '[c2]|bare ' || lang || chr(10) || 'X|c1->c2|leads to' || chr(10) || 'nonsense' || chr(10) || 'S|s1|second'"


@registry.query(
    f"""WITH a AS (SELECT doc_id AS answer_id, {_ANSWER} AS text FROM documents), l AS (SELECT answer_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM a),
k AS (SELECT answer_id, CAST(line AS INTEGER) AS line, raw, upper(left(regexp_extract(raw, '(?i)^\\s*(?:[-*•>]+|\\d+[.)])?\\s*(?:\\*\\*)?\\s*([RSCXMD])\\s*(?:\\*\\*)?\\s*\\|(.*)$', 1), 1)) AS k1, upper(left(regexp_extract(raw, '(?i)^\\s*(?:[-*•]+\\s*)?\\[?([scd]\\d+)\\]?\\s*\\|(.*)$', 1), 1)) AS k2 FROM l WHERE trim(raw) <> '')
SELECT answer_id, line, CASE WHEN k1 <> '' THEN k1 WHEN k2 <> '' THEN k2 END AS kind FROM k"""
)
def label_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.expr(_ANSWER.replace("chr(10)", "'\\n'")).alias("text"))
    return B.parsed(answers).select("answer_id", "line", "kind")


@registry.query()
def label_lines_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.expr(_ANSWER.replace("chr(10)", "'\\n'")).alias("text"))
    return B.parsed(answers)


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS}, s AS (SELECT video_id, pos // 8 AS section, string_agg(text, chr(10) ORDER BY pos) AS t FROM captions GROUP BY ALL) SELECT video_id, section, left(sha1(t), 20) AS key FROM s")
def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = document_captions(spark, sf_dir).groupBy("video_id", F.floor(F.col("pos") / 8).cast("int").alias("section")).agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY pos)").alias("t"))
    return s.select("video_id", "section", B.section_key(F.col("t")).alias("key"))


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS} SELECT video_id, pos, 's' || dense_rank() OVER (PARTITION BY video_id ORDER BY pos // 8) AS section, 'c' || row_number() OVER (PARTITION BY video_id ORDER BY pos) AS concept FROM captions")
def candidate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates numbered through a whole document."""
    w = Window.partitionBy("video_id")
    rows = document_captions(spark, sf_dir)
    section = F.dense_rank().over(w.orderBy(F.floor(F.col("pos") / 8)))
    return rows.select("video_id", "pos", F.concat(F.lit("s"), section.cast("string")).alias("section"), F.concat(F.lit("c"), F.row_number().over(w.orderBy("pos")).cast("string")).alias("concept"))


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS}, s AS (SELECT video_id, pos // 8 AS section, count(*) AS n FROM captions GROUP BY ALL) SELECT video_id, 40 + CAST(sum(18 + n * 22) AS BIGINT) AS answer_tokens, string_agg('s' || (section + 1) || '|' || n, chr(10) ORDER BY section) AS prompt FROM s GROUP BY video_id")
def prompt_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = document_captions(spark, sf_dir).groupBy("video_id", F.floor(F.col("pos") / 8).cast("int").alias("section")).agg(F.count("*").alias("n"))
    s = s.withColumn("t", F.concat(F.lit("s"), (F.col("section") + 1).cast("string"), F.lit("|"), F.col("n").cast("string")))
    return s.groupBy("video_id").agg((F.sum(F.col("n") * 22 + 18) + 40).alias("answer_tokens"), F.expr("listagg(t, '\\n') WITHIN GROUP (ORDER BY section)").alias("prompt"))


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS}, c AS (SELECT video_id, pos, 'see [' || {sql_clock('start')} || '] and [' || {sql_clock(chr(34) + 'end' + chr(34))} || ']' AS t FROM captions) SELECT video_id, pos, CAST(len(regexp_extract_all(t, '\\[(\\d+:\\d{{2}}(?::\\d{{2}})?)\\]', 1)) AS INTEGER) AS n, regexp_extract_all(t, '\\[(\\d+:\\d{{2}}(?::\\d{{2}})?)\\]', 1)[1] AS first FROM c")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("see ["), X.clock(F.col("start")), F.lit("] and ["), X.clock(F.col("end")), F.lit("]"))
    stamps = F.regexp_extract_all(t, F.lit(r"\[(\d+:\d{2}(?::\d{2})?)\]"), F.lit(1))
    return document_captions(spark, sf_dir).select("video_id", "pos", F.size(stamps).alias("n"), F.element_at(stamps, 1).alias("first"))


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS} SELECT video_id, pos, regexp_replace(text, '(the|thing)', '<mark>\\1</mark>', 'gi') AS marked FROM captions")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_captions(spark, sf_dir).select("video_id", "pos", F.regexp_replace("text", "(?i)(the|thing)", "<mark>$1</mark>").alias("marked"))
