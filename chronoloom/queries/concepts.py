"""Queries of term statistics, mentions, joins in time, vector links and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import joins as J
from ..operators import lexical as C
from ..operators import vectors as V
from ..operators.components import components
from ..operators.ranks import ranked
from ..sources.tables import SQL_DOCUMENT_CAPTIONS, captions_of, document_captions, table
from . import Registry
from .text import SQL_TOKENS, sql_normal, sql_titled, sql_truncated

registry = Registry()
_STOPS = L.sql_list(L.STOPS)

_SQL_TF = f"""words AS (SELECT source AS grp, doc_id AS seg, unnest({SQL_TOKENS.format('text')}) AS term FROM documents),
tf AS (SELECT grp, seg, term, count(*) AS tf FROM words WHERE length(term) > 3 AND NOT list_contains({_STOPS}, term) GROUP BY ALL)"""


def _tf(spark: SparkSession, sf_dir: str) -> C.Dealt:
    texts = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("seg"), "text")
    return C.dealt(texts, lambda c: F.filter(X.tokens(c), lambda w: (F.length(w) > 3) & ~w.isin(L.STOPS)))


@registry.query(
    f"""WITH {_SQL_TF}, t AS (SELECT *, sum(tf) OVER (PARTITION BY grp, seg) AS seg_total, sum(tf) OVER (PARTITION BY grp, term) AS term_total,
  sum(tf) OVER (PARTITION BY grp) AS grp_total FROM tf), n AS (SELECT grp, count(DISTINCT seg) AS n FROM tf GROUP BY grp),
s AS (SELECT grp, seg, term, tf / seg_total * ln(1 + (grp_total / n) / term_total) AS score FROM t JOIN n USING (grp))
SELECT grp, seg, term, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY grp, seg ORDER BY round(score, 9) DESC, term) AS INTEGER) AS rank FROM s WHERE score > 0 QUALIFY rank <= 6"""
)
def ctfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six keywords of each document, against the documents of its source."""
    return C.top_terms(C.class_tf_idf_of(_tf(spark, sf_dir)), 6, "part").select("grp", "seg", "term", F.round("score", 6).alias("score"), "rank")


_SQL_MAX = f"""{_SQL_TF}, n AS (SELECT grp, count(DISTINCT seg) AS n FROM tf GROUP BY grp),
w AS (SELECT *, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM (SELECT *, count(*) OVER (PARTITION BY grp, term) AS df FROM tf) JOIN n USING (grp) WHERE n <= 3 OR df <= 0.95 * n),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY grp, seg)) AS v FROM w),
m AS (SELECT grp, term, max(v) AS score, count(*) AS segments FROM u GROUP BY grp, term)"""


@registry.query(
    f"""WITH {_SQL_MAX} SELECT grp, term, segments, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, term) AS INTEGER) AS rank,
  round(score * 1.0, 6) AS boosted FROM m QUALIFY rank <= 30"""
)
def tfidf_max_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.ranked_candidates(C.max_tf_idf(_tf(spark, sf_dir)), 30)
    return found.select("grp", "term", "segments", F.round("score", 6).alias("score"), "rank", F.round("boosted", 6).alias("boosted"))


@registry.query(
    f"""WITH {_SQL_MAX}, c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, term) AS rank FROM m QUALIFY rank <= 60),
g AS (SELECT grp, regexp_replace(term, '(ies|es|s|ing|ed)\\b', '', 'g') AS stem, sum(score) AS score, list(term ORDER BY score DESC, term) AS names FROM c GROUP BY ALL)
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, names[1]) AS INTEGER) AS concept, {sql_titled('names[1]')} AS label, round(score, 6) AS score, array_to_string(names, ',') AS names FROM g QUALIFY concept <= 20"""
)
def concept_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.rolled_up(C.ranked_candidates(C.max_tf_idf(_tf(spark, sf_dir)), 60), 20)
    return found.select("grp", "concept", "label", F.round("score", 6).alias("score"), F.array_join("names", ",").alias("names"))


_SQL_CONCEPTS = f"""main AS (SELECT doc_id AS video_id, unnest({SQL_TOKENS.format('text')}) AS alias FROM documents),
aliases AS (SELECT video_id, alias, CAST(row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, alias) AS INTEGER) AS concept FROM main
  WHERE length(alias) > 3 AND NOT list_contains({_STOPS}, alias) GROUP BY video_id, alias QUALIFY concept <= 6),
mentions AS (SELECT DISTINCT a.video_id, concept, pos, start FROM aliases a JOIN captions c ON a.video_id = c.video_id AND contains(lower(c.text), alias))"""
_SQL_MENTIONS = f"{SQL_DOCUMENT_CAPTIONS}, {_SQL_CONCEPTS}"


def _mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition(C.parts_of(docs), "doc_id")  # texts are dealt; their words and lines, many times as much, are not
    aliases, lines = C.main_words(docs), captions_of(docs)
    return aliases, lines, C.mentions(aliases, lines)


@registry.query(f"WITH {_SQL_MENTIONS} SELECT * FROM mentions")
def mention_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)[2]


@registry.query(f"WITH {_SQL_MENTIONS} SELECT a.video_id, a.concept, coalesce(min(start), 0.0) AS first_ts, count(start) AS n_mentions, array_to_string(list(start ORDER BY start) FILTER (start IS NOT NULL)[1:5], ',') IS NULL AS none FROM aliases a LEFT JOIN mentions USING (video_id, concept) GROUP BY a.video_id, a.concept")
def mention_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases, lines, _ = _mentions(spark, sf_dir)
    held = aliases.hint("merge").join(lines, "video_id", "left").withColumn("start", F.when(F.contains(F.lower("text"), "alias"), F.col("start"))).groupBy("video_id", "concept")
    return held.agg(F.coalesce(F.min("start"), F.lit(0.0)).alias("first_ts"), F.count("start").alias("n_mentions"), (F.count("start") == 0).alias("none"))


@registry.query(f"WITH {_SQL_MENTIONS} SELECT a.video_id, a.concept AS a, b.concept AS b, CAST(count(*) AS DOUBLE) AS weight FROM mentions a JOIN mentions b ON a.video_id = b.video_id AND a.pos = b.pos AND a.concept < b.concept GROUP BY ALL")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cooccurrence(_mentions(spark, sf_dir)[2])


@registry.query(
    f"""WITH {_SQL_MENTIONS}, e AS (SELECT a.video_id, a.concept AS a, b.concept AS b, CAST(count(*) AS DOUBLE) AS weight FROM mentions a JOIN mentions b ON a.video_id = b.video_id AND a.pos = b.pos AND a.concept < b.concept GROUP BY ALL),
n AS (SELECT video_id, count(*) AS n FROM aliases GROUP BY video_id)
SELECT video_id, a, b, weight, CAST(row_number() OVER (PARTITION BY video_id ORDER BY weight DESC, a, b) AS INTEGER) AS rank FROM e JOIN n USING (video_id) QUALIFY rank <= 2 * max(n) OVER (PARTITION BY video_id)"""
)
def strongest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases, _, found = _mentions(spark, sf_dir)
    return C.strongest(C.cooccurrence(found), aliases.groupBy("video_id").agg(F.count("*").alias("n")))


@registry.query(f"WITH {_SQL_MENTIONS} SELECT video_id, concept, {sql_normal('c.text')} AS normal, pos FROM mentions JOIN captions c USING (video_id, pos) QUALIFY row_number() OVER (PARTITION BY video_id, concept, normal ORDER BY pos) = 1")
def concept_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that mention a concept, the first of those that are alike."""
    aliases, lines, _ = _mentions(spark, sf_dir)
    held = C.mentions(aliases, lines, "text").withColumn("normal", X.normal(F.col("text")))
    return held.groupBy("video_id", "concept", "normal").agg(F.min("pos").alias("pos"))


@registry.query(f"WITH {_SQL_MENTIONS} SELECT video_id, concept, min(pos) AS node FROM mentions GROUP BY ALL")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)[2].groupBy("video_id", "concept").agg(F.min("pos").alias("node"))


_REL = "CASE video_id % 9 WHEN 0 THEN ' is a type of ' WHEN 1 THEN ' is a ' WHEN 2 THEN ' uses the ' WHEN 3 THEN ' leads to ' WHEN 4 THEN ' contains ' WHEN 5 THEN ' versus ' WHEN 6 THEN ' enables ' WHEN 7 THEN ' reduces ' ELSE ' with ' END"


def _sql_relation(flag: bool) -> str:
    rows = []
    for pattern, label in L.RELATIONS:
        for first, second, back in (("a", "b", False), ("b", "a", True)):
            out = str(back).lower() if flag else f"'{label}'"
            rows.append(f"WHEN regexp_matches(low, regexp_escape({first}) || '{pattern}' || regexp_escape({second})) THEN {out}")
    return "CASE " + " ".join(rows) + (" ELSE false END" if flag else f" ELSE '{L.UNRELATED}' END")


@registry.query(
    f"""WITH {_SQL_CONCEPTS.split('mentions AS')[0].rstrip().rstrip(',')}, p AS (SELECT x.video_id, x.alias AS a, y.alias AS b FROM aliases x JOIN aliases y ON x.video_id = y.video_id AND x.concept = 1 AND y.concept = 2),
s AS (SELECT video_id, a, b, CASE WHEN video_id % 2 = 0 THEN a || {_REL} || b ELSE b || {_REL} || a END AS low FROM p)
SELECT video_id, {_sql_relation(False)} AS label, {_sql_relation(True)} AS reversed FROM s"""
)
def relation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = C.main_words(table(spark, sf_dir, "documents"))
    pairs = aliases.where("concept = 1").select("video_id", F.col("alias").alias("a")).join(aliases.where("concept = 2").select("video_id", F.col("alias").alias("b")), "video_id")
    said = pairs.withColumn("low", F.expr(f"CASE WHEN video_id % 2 = 0 THEN a || {_REL} || b ELSE b || {_REL} || a END"))
    return said.select("video_id", C.relation(F.col("low"), F.col("a"), F.col("b")).alias("r")).select("video_id", "r.label", "r.reversed")


_SQL_SPANS = f"{SQL_DOCUMENT_CAPTIONS}, spans AS (SELECT video_id, pos AS node, start AS s_start, \"end\" AS s_end FROM captions WHERE pos % 5 = 0)"


def _spans(lines: DataFrame) -> DataFrame:
    return lines.where("pos % 5 = 0").select("video_id", F.col("pos").alias("node"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))


@registry.query(f"WITH {_SQL_SPANS} SELECT c.video_id, node, pos, start FROM captions c JOIN spans s ON c.video_id = s.video_id AND start >= s_start - 0.5 AND start < s_end + 0.5")
def section_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_captions(spark, sf_dir)
    return J.within(lines, _spans(lines), 0.5, 0.5).select("video_id", "node", "pos", "start")


@registry.query(f"WITH {_SQL_SPANS}, w AS (SELECT c.video_id, node, string_agg(text, ' ' ORDER BY pos) AS t FROM captions c JOIN spans s ON c.video_id = s.video_id AND start >= s_start - 20 AND start < s_end + 20 GROUP BY c.video_id, node) SELECT video_id, node, {sql_truncated('t', 300)} AS context FROM w")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said within 20 seconds of a node."""
    lines = document_captions(spark, sf_dir)
    held = J.within(lines, _spans(lines), 20.0, 20.0).groupBy("video_id", "node").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY pos)").alias("t"))
    return held.select("video_id", "node", X.truncated(F.col("t"), 300).alias("context"))


@registry.query(
    f"""WITH {_SQL_SPANS}, known AS (SELECT DISTINCT video_id, left(text, 60) AS head FROM captions WHERE pos % 5 = 0),
m AS (SELECT c.video_id, node, pos, c.text FROM captions c JOIN spans s ON c.video_id = s.video_id AND start >= s_start - 1 AND start < s_end + 45 ANTI JOIN known k ON c.video_id = k.video_id AND left(c.text, 60) = head)
SELECT video_id, node, pos, CAST(row_number() OVER (PARTITION BY video_id, node ORDER BY pos) AS INTEGER) AS rank FROM m WHERE length(text) > 25 QUALIFY rank <= 3"""
)
def expand_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three longer lines of a node that are not in the outline yet."""
    lines = document_captions(spark, sf_dir)
    known = lines.where("pos % 5 = 0").select("video_id", F.left("text", F.lit(60)).alias("head")).distinct()
    held = J.within(lines, _spans(lines), 1.0, 45.0).where(F.length("text") > 25).withColumn("head", F.left("text", F.lit(60))).join(known, ["video_id", "head"], "left_anti")
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("video_id", "node").orderBy("pos"))).where("rank <= 3").select("video_id", "node", "pos", "rank")


_TICKS = "SELECT video_id, unnest(generate_series(0, CAST(floor(d / 10) AS BIGINT))) * 10.0 AS t FROM (SELECT video_id, max(\"end\") AS d FROM captions GROUP BY video_id)"


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS}, ticks AS ({_TICKS})
SELECT t.video_id, CAST(t AS DOUBLE) AS t, arg_max(pos, (start, pos % 3)) AS node, max(start) AS start, CAST(arg_max(pos % 3, (start, pos % 3)) AS INTEGER) AS depth
FROM ticks t JOIN captions c ON t.video_id = c.video_id AND start <= t + 0.5 GROUP BY t.video_id, t"""
)
def follow_along_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that is on at every ten seconds of playing."""
    lines = document_captions(spark, sf_dir)
    ticks = lines.groupBy("video_id").agg(F.max("end").alias("d")).select("video_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("d") / 10))).alias("k")).select("video_id", (F.col("k") * 10.0).alias("t"))
    return J.as_of(ticks, lines.select("video_id", F.col("pos").alias("node"), "start", (F.col("pos") % 3).alias("depth")), 0.5)


@registry.query()
def frames_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, in time order, each to the latest node that has started and has none yet."""
    lines = document_captions(spark, sf_dir)
    nodes = lines.where("pos % 5 = 0").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", F.col("pos").alias("node")))).alias("nodes"))
    frames = lines.where("pos % 7 = 0").groupBy("video_id").agg(F.array_sort(F.collect_list(F.col("start") + 1)).alias("frames"))
    none = F.array().cast("array<struct<t:double,node:int>>")

    def take(held, t):
        free = F.filter("nodes", lambda n: (n["start"] <= t + 1) & ~F.exists(held, lambda h: h["node"] == n["node"]))
        last = F.try_element_at(free, F.lit(-1))
        return F.when(last.isNotNull(), F.array_append(held, F.struct(t.alias("t"), last["node"].alias("node")))).otherwise(held)

    return nodes.join(frames, "video_id").select("video_id", F.explode(F.aggregate("frames", none, take)).alias("f")).select("video_id", "f.t", "f.node")


_SQL_NEAR = "near AS (SELECT q.vec_id AS query, r.vec_id AS row, q.label AS ql, r.label AS rl, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS cosine FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)"


def _near(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    labels = rows.select(F.col("vec_id").alias("id"), "label")
    found = V.similar(rows.where("vec_id % 50 = 0"), rows, least)
    ql, rl = labels.withColumnsRenamed({"id": "query", "label": "ql"}), labels.withColumnsRenamed({"id": "row", "label": "rl"})
    return found.join(ql, "query").join(rl, "row")


@registry.query(f"WITH {_SQL_NEAR} SELECT query, row, round(cosine, 3) AS score, CAST(row_number() OVER (ORDER BY round(cosine, 9) DESC, query, row) AS INTEGER) AS rank FROM near WHERE ql <> rl AND cosine >= 0.25 QUALIFY rank <= 60")
def cross_document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty nearest vectors of other labels, for every fiftieth vector."""
    top = _near(spark, sf_dir, 0.25).where("ql <> rl").orderBy(F.round("cosine", 9).desc(), "query", "row").limit(60)
    return top.select("query", "row", F.round("cosine", 3).alias("score"), F.row_number().over(Window.orderBy(F.round("cosine", 9).desc(), "query", "row")).alias("rank"))


@registry.query(f"WITH {_SQL_NEAR} SELECT query, row, round(cosine, 6) AS weight FROM near WHERE ql = rl AND cosine >= 0.2 AND cosine < 0.5")
def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 0.2).where("ql = rl AND cosine < 0.5").select("query", "row", F.round("cosine", 6).alias("weight"))


#: Cosine from which vectors say the same; each vector also has a near copy of itself here, so that there is something to find.
SAME = 0.82
_SQL_SAME = f"""copies AS (SELECT CAST(vec_id AS BIGINT) AS v, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  UNION ALL SELECT CAST(vec_id AS BIGINT) + 1000000000, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i % 10 = 1 THEN x * (vec_id % 5) ELSE x END) FROM embeddings
  UNION ALL SELECT CAST(vec_id AS BIGINT) + 2000000000, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2) FROM embeddings WHERE vec_id % 3 = 0),
e AS (SELECT p.v AS a, q.v AS b FROM copies p JOIN copies q ON p.v <> q.v AND list_cosine_similarity(p.e, q.e) >= {SAME}),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT v, label, least(v, (SELECT min(b) FROM r WHERE a = v)) AS component FROM copies)"""


def _same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, label, component) of every vector, with altered and scaled copies of it."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("v"), "label", F.col("embedding").cast("array<double>").alias("e"))
    altered = F.transform("e", lambda x, i: F.when(i % 10 == 0, x * (F.col("v") % 5)).otherwise(x))
    scaled = rows.where("v % 3 = 0").select((F.col("v") + 2_000_000_000).alias("v"), "label", F.transform("e", lambda x: x * 2).alias("e"))
    copies = rows.unionByName(rows.select((F.col("v") + 1_000_000_000).alias("v"), "label", altered.alias("e"))).unionByName(scaled)
    found = components(V.near_links(copies, SAME, key="v", vector="e")).withColumnRenamed("v", "k")
    return copies.select("v", "label").join(found, F.col("v") == F.col("k"), "left").select("v", "label", F.coalesce("component", "v").alias("component"))


@registry.query(f"WITH RECURSIVE {_SQL_SAME} SELECT v, component FROM c")
def near_duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the least vector that links reach; all pairs count."""
    return _same(spark, sf_dir).select("v", "component")


@registry.query(
    f"""WITH RECURSIVE {_SQL_SAME} SELECT component, count(*) AS members, count(DISTINCT label) AS videos, arg_min(v, (length(CAST(v AS VARCHAR)), v)) AS head,
  CAST(row_number() OVER (ORDER BY count(*) DESC, component) AS INTEGER) AS rank FROM c GROUP BY component"""
)
def hub_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked vectors as shared topics: the most members first, the shortest name as head."""
    held = _same(spark, sf_dir).groupBy("component").agg(
        F.count("*").alias("members"), F.countDistinct("label").alias("videos"), F.min_by("v", F.struct(F.length(F.col("v").cast("string")), "v")).alias("head")
    )
    return ranked(held, [F.desc("members"), F.asc("component")], "rank").withColumn("rank", F.col("rank").cast("int"))


#: Documents of which phrases that occur in the same ones are alike.
BUCKETS = 64
_SQL_SIMILAR = f"""{_SQL_MAX}, top AS (SELECT grp, term FROM m QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, term) <= 60),
p AS (SELECT grp, term, [{", ".join(f"coalesce(sum(tf) FILTER (seg % {BUCKETS} = {b}), 0)::DOUBLE" for b in range(BUCKETS))}] AS v, regexp_replace(term, '(ies|es|s|ing|ed)\\b', '', 'g') AS stem FROM tf JOIN top USING (grp, term) GROUP BY grp, term),
e AS (SELECT a.grp, a.term AS a, b.term AS b FROM p a JOIN p b ON a.grp = b.grp AND a.term <> b.term AND (a.stem = b.stem OR list_cosine_similarity(a.v, b.v) >= 0.82
  OR ((contains(a.term, b.term) OR contains(b.term, a.term)) AND list_cosine_similarity(a.v, b.v) > 0.72))),
r(grp, a, b) AS (SELECT grp, a, b FROM e UNION SELECT r.grp, r.a, e.b FROM r JOIN e ON r.grp = e.grp AND r.b = e.a)
SELECT grp, term, least(term, (SELECT min(b) FROM r WHERE r.grp = p.grp AND r.a = p.term)) AS head FROM p"""


@registry.query(f"WITH RECURSIVE {_SQL_SIMILAR}")
def similar_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty best words of each source, those together that have one stem, or occur in the same documents, or partly so and one in the other."""
    tf = _tf(spark, sf_dir)
    top = C.ranked_candidates(C.max_tf_idf(tf), 60).select("grp", "term")
    counts = [F.coalesce(F.sum(F.when(F.col("seg") % BUCKETS == b, F.col("tf"))), F.lit(0)).cast("double") for b in range(BUCKETS)]
    here = tf.places.select("part", "grp", "term").join(top, ["grp", "term"])
    vectors = tf.rows(here.withColumn("told", F.lit(1.0))).groupBy("grp", "term").agg(F.array(*counts).alias("vector"))
    return C.similar_groups(vectors)


_KEY = "left(sha1(doc_id || '|' || left(text, 80)), 20)"


@registry.query(f"SELECT d.doc_id, {_KEY.replace('doc_id', 'd.doc_id')} AS key, quality FROM documents d LEFT JOIN (SELECT {_KEY.replace('doc_id', 'd.doc_id')} AS key, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id) c ON c.key = {_KEY.replace('doc_id', 'd.doc_id')}")
def label_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the cached label of their content key, where there is one."""
    docs = table(spark, sf_dir, "documents").withColumn("key", F.left(F.sha1(F.concat_ws("|", "doc_id", F.left("text", F.lit(80))).cast("binary")), F.lit(20)))
    cache = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("key", "quality")
    return docs.select("doc_id", "key").join(cache, "key", "left").select("doc_id", "key", "quality")


@registry.query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1)")
def focus_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in focus; all where nothing is."""
    docs, focus = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return docs if focus.isEmpty() else docs.join(focus, "doc_id", "left_semi")


@registry.query(
    f"""WITH {_SQL_MENTIONS}, e AS (SELECT video_id, a.concept AS a, b.concept AS b FROM mentions a JOIN mentions b USING (video_id, pos) WHERE a.concept < b.concept GROUP BY ALL)
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM aliases r WHERE r.video_id = e.video_id AND r.concept IN (e.a, e.b) AND length(r.alias) > 6)"""
)
def edge_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch no removed concept."""
    aliases, _, found = _mentions(spark, sf_dir)
    gone = aliases.where(F.length("alias") > 6).select("video_id", "concept")
    edges = C.cooccurrence(found).select("video_id", "a", "b")
    for end in ("a", "b"):
        edges = edges.join(gone.withColumnRenamed("concept", end), ["video_id", end], "left_anti")
    return edges.select("video_id", "a", "b")


@registry.query(f"WITH {_SQL_MENTIONS} SELECT video_id, pos FROM mentions WHERE concept = 1 INTERSECT SELECT video_id, pos FROM mentions WHERE concept = 2")
def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mentions(spark, sf_dir)[2]
    return found.where("concept = 1").select("video_id", "pos").intersect(found.where("concept = 2").select("video_id", "pos"))


@registry.query(f"WITH {_SQL_MENTIONS} SELECT video_id, pos FROM captions EXCEPT SELECT video_id, pos FROM mentions")
def unmentioned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines, found = _mentions(spark, sf_dir)
    return lines.select("video_id", "pos").join(found.select("video_id", "pos"), ["video_id", "pos"], "left_anti").distinct()


@registry.query("WITH a AS (SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 = 0), b AS (SELECT vec_id AS id, label + 100 AS label FROM embeddings WHERE vec_id % 2 = 0) SELECT id, CAST(label AS INTEGER) AS label FROM a UNION ALL SELECT id, CAST(label AS INTEGER) FROM b WHERE id NOT IN (SELECT id FROM a)")
def union_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base's rows, and of the other's those whose id the base lacks."""
    rows = table(spark, sf_dir, "embeddings")
    base = rows.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), "label")
    other = rows.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("label") + 100).cast("int").alias("label"))
    return base.unionByName(other.join(base, "id", "left_anti"))


@registry.query("WITH t AS (SELECT source, left(text, 12) AS title, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT source, left(string_agg(title, ' + ' ORDER BY first), 140) AS titles FROM t GROUP BY source")
def joined_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles of a source in the order of their first document, joined and cut."""
    t = table(spark, sf_dir, "documents").groupBy("source", F.left("text", F.lit(12)).alias("title")).agg(F.min("doc_id").alias("first"))
    # a title takes three characters at least with what joins it, so no more than these can show
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("first", "title"))).where(F.col("n") <= 140 // 3 + 2)
    return t.groupBy("source").agg(F.left(F.expr("listagg(title, ' + ') WITHIN GROUP (ORDER BY first)"), F.lit(140)).alias("titles"))
