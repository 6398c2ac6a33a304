"""Queries of the text and language functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language as G
from ..functions import lexicon as L
from ..functions import text as X
from ..operators.lexical import parts_of, phrase_rows
from ..sources.tables import SQL_DOCUMENT_CAPTIONS, document_captions, table
from . import Registry

registry = Registry()

SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_SIGNS = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")]


def sql_unescape(c: str) -> str:
    for entity, sign in _SIGNS:
        c = f"replace({c}, '{entity}', '{sign}')"
    return c


def sql_pattern(p: str) -> tuple[str, str]:
    """A pattern and its options for DuckDB."""
    return (p[4:], "gi") if p.startswith("(?i)") else (p, "g")


def sql_clean(c: str) -> str:
    noise, pause = sql_pattern(L.NOISE)[0], sql_pattern(L.FILLED_PAUSE)[0]
    c = f"regexp_replace({sql_unescape(sql_unescape(f'coalesce({c}, {chr(39) * 2})'))}, '{noise}', ' ', 'gi')"
    c = f"regexp_replace({c}, '^\\s*(?:>>|-)\\s*', '')"
    return SQUEEZE.format(f"regexp_replace({c}, '{pause}', '\\1\\2', 'gi')")


def sql_sentences(c: str) -> str:
    marked = f"regexp_replace({c}, '([.!?])\\s+([A-Z0-9\"''])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


SQL_TOKENS = "regexp_extract_all(lower({0}), '" + X.TOKEN.replace("'", "''") + "')"


def sql_truncated(c: str, limit: int) -> str:
    whole = SQUEEZE.format(f"coalesce({c}, '')")
    head = f"left({whole}, {limit - 1})"
    space = f"(length({head}) - instr(reverse({head}), ' '))"
    kept = f"CASE WHEN contains({head}, ' ') AND {space} > {limit * 0.6} THEN left({head}, {space}) ELSE {head} END"
    return f"CASE WHEN length({whole}) <= {limit} THEN {whole} ELSE rtrim({kept}, ',;: ') || '…' END"


def sql_clock(c: str) -> str:
    s = f"greatest(0, CAST(floor({c}) AS BIGINT))"
    return (
        f"CASE WHEN {c} IS NULL THEN '' WHEN {s} >= 3600 THEN ({s} // 3600) || ':' || lpad(CAST({s} // 60 % 60 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST({s} % 60 AS VARCHAR), 2, '0') ELSE ({s} // 60) || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') END"
    )


def sql_upper_first(c: str) -> str:
    return f"(replace(upper(left({c}, 1)), 'ẞ', 'SS') || substring({c}, 2))"


def sql_titled(c: str) -> str:
    small = L.sql_list(L.SMALL_WORDS)
    return (
        f"array_to_string(list_transform({WORDS.format(c)}, lambda w, i: CASE WHEN upper(w) = w AND lower(w) <> w AND length(w) > 1 THEN w "
        f"WHEN i > 1 AND list_contains({small}, lower(w)) THEN lower(w) ELSE {sql_upper_first('w')} END), ' ')"
    )


def sql_normal(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_captions(spark, sf_dir).select("video_id", "pos", "text")


@registry.query(
    "SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, list_aggregate(t, 'max') AS last_token "
    f"FROM (SELECT doc_id, {SQL_TOKENS.format('text')} AS t FROM documents)"
)
def tokens_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_max("t").alias("last_token"))


@registry.query(
    f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_no, unnest(s) AS sentence FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)"
)
def sentences_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sent_no", "sentence"))


_RAW = "CASE pos % 5 WHEN 0 THEN '>> ' || text WHEN 1 THEN '[Music] um, ' || text WHEN 2 THEN replace(text, ' ', ' &amp;nbsp; ') WHEN 3 THEN 'Anna: you know, ' || text ELSE text || ' (laughs) uh' END"


@registry.query(
    f"WITH {SQL_DOCUMENT_CAPTIONS}, raw AS (SELECT video_id, pos, {_RAW} AS raw FROM captions) "
    f"SELECT video_id, pos, {sql_clean('raw')} AS text, regexp_matches({sql_unescape('raw')}, '{L.NEW_SPEAKER}') AS new_speaker FROM raw"
)
def captions_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _lines(spark, sf_dir).select("video_id", "pos", F.expr(_RAW).alias("raw"))
    return raw.select("video_id", "pos", X.clean_caption(F.col("raw")).alias("text"), X.is_new_speaker(F.col("raw")).alias("new_speaker"))


@registry.query(
    f"SELECT doc_id, {sql_truncated('text', 60)} AS title, {sql_truncated('text', 140)} AS gist FROM documents"
)
def truncated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.truncated(F.col("text"), 60).alias("title"), X.truncated(F.col("text"), 140).alias("gist"))


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS} SELECT video_id, pos, {sql_titled('text')} AS title FROM captions")
def titled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("video_id", "pos", X.titled(F.col("text")).alias("title"))


@registry.query(
    f"WITH {SQL_DOCUMENT_CAPTIONS}, c AS (SELECT video_id, pos, {sql_clock('start')} AS stamp, {sql_clock('start * 40')} AS long_stamp FROM captions) "
    "SELECT *, CAST(list_reduce(list_transform(string_split(stamp, ':'), lambda p: CAST(p AS DOUBLE)), lambda a, x: a * 60 + x) AS DOUBLE) AS seconds, "
    "CAST(list_reduce(list_transform(string_split(long_stamp, ':'), lambda p: CAST(p AS DOUBLE)), lambda a, x: a * 60 + x) AS DOUBLE) AS long_seconds FROM c"
)
def clock_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_captions(spark, sf_dir).select("video_id", "pos", X.clock(F.col("start")).alias("stamp"), X.clock(F.col("start") * 40).alias("long_stamp"))
    return c.select("*", X.seconds_of(F.col("stamp")).alias("seconds"), X.seconds_of(F.col("long_stamp")).alias("long_seconds"))


@registry.query(
    "WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') AS a FROM documents), "
    "u AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM w), f AS (SELECT doc_id, min(i) AS i, arg_min(x, i) AS x FROM u GROUP BY doc_id, lower(trim(x))), "
    "k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM f GROUP BY doc_id) "
    "SELECT doc_id, CAST(len(a) AS INTEGER) AS n_items, CASE WHEN a IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept FROM w LEFT JOIN k USING (doc_id)"
)
def distinct_items_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", " "), lambda x: F.trim(x) != "").alias("a"))
    return w.select("doc_id", F.size("a").alias("n_items"), F.array_join(X.distinct_in_order(F.col("a")), " ").alias("kept"))


@registry.query(
    f"""WITH clauses AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{X.CLAUSE_BREAK}')) AS k FROM documents
), ws AS (SELECT doc_id, regexp_extract_all(k, '{X.PHRASE_WORD.replace("'", "''")}') AS w FROM clauses
), sized AS (SELECT doc_id, w, unnest([1, 2, 3]) AS n FROM ws
), grams AS (SELECT doc_id, unnest([w[i:i + n - 1] FOR i IN range(1, len(w) - n + 2)]) AS g FROM sized WHERE len(w) >= n
), counted AS (
  SELECT doc_id, array_to_string(g, ' ') AS phrase, count(*) AS times FROM grams
  WHERE NOT list_contains({L.sql_list(L.STOPS)}, g[1]) AND NOT list_contains({L.sql_list(L.STOPS)}, g[-1]) AND NOT list_contains({L.sql_list(L.EDGE_ADJECTIVES)}, g[-1])
    AND (len(g) < 3 OR g[2] = 'of' OR NOT list_contains({L.sql_list(L.STOPS)}, g[2]))
    AND len(list_filter(g, lambda x: list_contains({L.sql_list(L.VERBS)}, x) OR ends_with(x, 'ly') OR length(x) < 2)) = 0
  GROUP BY ALL
) SELECT doc_id, phrase, times, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, phrase) AS rank FROM counted QUALIFY rank <= 10"""
)
def candidate_phrases_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest phrases of each document."""
    from pyspark.sql import Window

    # the texts are dealt, in parts small enough to be counted in memory; their phrases, many times as much, are not
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = phrase_rows(texts.repartition(parts_of(texts), "doc_id"), ["doc_id"])
    found = rows.groupBy("doc_id", F.col("term").alias("phrase")).agg(F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("times"), "phrase"))
    return found.withColumn("rank", rank.cast("bigint")).where("rank <= 10")


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS} SELECT video_id, pos, {sql_normal('text')} AS normal, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM captions")
def normal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("video_id", "pos", X.normal(F.col("text")).alias("normal"), X.estimated_tokens(F.col("text")).alias("tokens"))


_ENDS = r",|;|\s(?:which|because|so that|whereas|while|although)\s|\s[-–—]\s"


def sql_compressed(c: str, most: int, source: str) -> str:
    lead = sql_pattern(L.LEAD_INS)[0]
    return f"""
a AS (SELECT *, regexp_replace({SQUEEZE.format(c)}, '^[“”"]+|[“”"]+$', '', 'g') AS t0 FROM {source}),
b AS (SELECT *, rtrim(CASE WHEN regexp_replace(t0, '{lead}', '', 'i') = '' THEN t0 ELSE regexp_replace(t0, '{lead}', '', 'i') END, ' .;,') AS t FROM a),
c AS (SELECT *, {WORDS.format('t')} AS ws, string_split(regexp_replace(t, '({_ENDS})', chr(1) || '\\1' || chr(2), 'gi'), chr(1)) AS ps FROM b),
d AS (SELECT *, list_filter(list_transform(range(1, len(ps)), lambda k: rtrim(replace(array_to_string(ps[1:k], ''), chr(2), ''), ' ,;:')),
  lambda h: len({WORDS.format('h')}) BETWEEN 4 AND {most}) AS fit FROM c),
e AS (SELECT *, CASE WHEN len(ws) <= {most} THEN t ELSE coalesce(fit[-1], rtrim(array_to_string(ws[1:{most}], ' '), ',;:') || '…') END AS short FROM d)"""


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS}, s AS (SELECT video_id, pos, 'So, and ' || text AS x FROM captions), {sql_compressed('x', 10, 's')} SELECT video_id, pos, {sql_upper_first('short')} AS line FROM e")
def compressed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("video_id", "pos", X.compressed(F.concat(F.lit("So, and "), "text"), 10).alias("line"))


def sql_tag(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{sql_pattern(p)[0].replace(chr(39), chr(39) * 2)}', 'i') THEN '{n}'" for n, p in L.TAGS.items()) + " END"


_TAGGED = "CASE pos % 7 WHEN 0 THEN text || ' 3 + 4' WHEN 1 THEN 'for example ' || text WHEN 2 THEN 'never ' || text WHEN 3 THEN 'remember ' || text WHEN 4 THEN 'it is a ' || text ELSE text END"


@registry.query(f"WITH {SQL_DOCUMENT_CAPTIONS}, s AS (SELECT video_id, pos, {_TAGGED} AS x FROM captions) SELECT video_id, pos, {sql_tag('x')} AS tag FROM s")
def line_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("video_id", "pos", X.line_tag(F.expr(_TAGGED)).alias("tag"))


def sql_lower_first(c: str) -> str:
    return f"CASE WHEN upper(left({c}, 2)) = left({c}, 2) AND lower(left({c}, 2)) <> left({c}, 2) THEN {c} ELSE lower(left({c}, 1)) || substring({c}, 2) END"


_UNTAG = "regexp_replace('Tip: ' || text, '^(Formula|Eg|Watch-out|Tip|Def): ', '')"


@registry.query(
    f"WITH {SQL_DOCUMENT_CAPTIONS} SELECT video_id, pos, {sql_lower_first('text')} AS lowered, trim('“' || text || '” ', '“”\" ') AS plain, {_UNTAG} AS untagged, "
    f"array_to_string({WORDS.format('text')}[1:5], ' ') AS short, CASE WHEN \"end\" > start THEN {sql_clock('start')} || '–' || {sql_clock(chr(34) + 'end' + chr(34))} ELSE {sql_clock('start')} END AS span, "
    "'watch?v=' || video_id || '&t=' || CAST(floor(start) AS BIGINT) || 's' AS link FROM captions"
)
def label_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return document_captions(spark, sf_dir).select(
        "video_id",
        "pos",
        X.lower_first(t).alias("lowered"),
        X.plain(F.concat(F.lit("“"), t, F.lit("” "))).alias("plain"),
        X.untagged(F.concat(F.lit("Tip: "), t)).alias("untagged"),
        X.first_words(t, 5).alias("short"),
        X.time_range(F.col("start"), F.col("end")).alias("span"),
        F.concat(F.lit("watch?v="), F.col("video_id").cast("string"), F.lit("&t="), F.floor("start").cast("string"), F.lit("s")).alias("link"),
    )


_UNMARKED = "trim(regexp_replace(regexp_replace(replace(replace(x, '**', ''), '`', ''), '[[]?[(]?\\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\\b[)]?[]]?', ' ', 'g'), '\\s+', ' ', 'g'))"
_LABEL = "CASE pos % 4 WHEN 0 THEN '**' || left(text, 40) || '** [1:23]' WHEN 1 THEN '\"' || left(text, 50) || '.\"' WHEN 2 THEN 'the speaker says ' || text ELSE text END"


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS}, s AS (SELECT video_id, pos, {_LABEL} AS x FROM captions),
a AS (SELECT *, {_UNMARKED} AS t0 FROM s),
b AS (SELECT *, regexp_replace(trim(rtrim(trim(t0, '"''“”‘’'), '.;,')), '\\s+:', ':', 'g') AS t FROM a)
SELECT video_id, pos, CASE WHEN t = '' OR regexp_matches(t, '{sql_pattern(L.ABOUT_VIDEO)[0]}', 'i') OR NOT regexp_matches(t, '[A-Za-z0-9]')
  OR len({WORDS.format('t')}) > 8 OR length(t) > 60 THEN NULL ELSE t END AS label FROM b"""
)
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("video_id", "pos", X.clean_label(F.expr(_LABEL), 60, 8).alias("label"))


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS}, s AS (SELECT video_id, pos, lower(trim(left(text, 12))) AS q, lower(CASE WHEN pos % 2 = 0 THEN text ELSE reverse(text) END) AS t FROM captions)
SELECT video_id, pos, round(CASE WHEN q = '' OR t = '' THEN 0 WHEN q = t THEN 1 WHEN contains(t, q) THEN 0.85 - least(0.3, (length(t) - length(q)) / 400.0)
  ELSE 0.7 * (len(list_filter({WORDS.format('q')}, lambda w: length(w) > 1 AND contains(t, w))) / greatest(len(list_filter({WORDS.format('q')}, lambda w: length(w) > 1)), 1)) END, 6) AS score FROM s"""
)
def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    other = F.when(F.col("pos") % 2 == 0, F.col("text")).otherwise(F.reverse("text"))
    return lines.select("video_id", "pos", F.round(X.fuzzy_score(F.left("text", F.lit(12)), other), 6).alias("score"))


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS} SELECT video_id, pos, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug,
  CAST(list_reduce(list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: CAST(unicode(x) AS BIGINT)),
    lambda h, x: (xor(h, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS BIGINT) AS hash FROM captions"""
)
def slugs_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("video_id", "pos", X.slug(F.col("text")).alias("slug"), X.fnv1a(F.col("text")).alias("hash"))


@registry.query(
    """SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 1), 6) AS ascii_share,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 1) > 0.6 AS latin FROM documents"""
)
def latin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = X.ascii_share(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(share, 6).alias("ascii_share"), (share > 0.6).alias("latin"))


_STOPS = L.sql_list(L.STOPS)


@registry.query(
    f"""WITH t AS (SELECT doc_id, list_distinct_in AS k FROM (SELECT doc_id, list_filter({SQL_TOKENS.format('text')}, lambda x: length(x) > 1) AS list_distinct_in FROM documents)),
p AS (SELECT doc_id, list_concat([k[1] || ' ' || k[2]], k) AS k FROM t WHERE len(k) >= 2)
SELECT doc_id, array_to_string(list_filter(k, lambda x: contains(x, ' ') OR NOT list_contains(string_split(k[1], ' '), x))[1:6], ', ') AS keywords,
  coalesce(len(string_split(k[1], ' ')) BETWEEN 1 AND 4 AND length(k[1]) >= 3 AND len(list_distinct(string_split(k[1], ' '))) = len(string_split(k[1], ' '))
    AND NOT list_contains({_STOPS}, string_split(k[1], ' ')[1]) AND NOT list_contains({_STOPS}, string_split(k[1], ' ')[-1]), false) AS usable FROM p"""
)
def preferred_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.filter(X.tokens(F.col("text")), lambda x: F.length(x) > 1)
    t = table(spark, sf_dir, "documents").select("doc_id", k.alias("k")).where(F.size("k") >= 2)
    t = t.withColumn("k", F.concat(F.array(F.concat(F.element_at("k", 1), F.lit(" "), F.element_at("k", 2))), "k"))
    return t.select("doc_id", F.array_join(X.prefer_phrases(F.col("k"), 6), ", ").alias("keywords"), X.usable_phrase(F.element_at("k", 1)).alias("usable"))


def _sql_tones() -> str:
    rows = []
    for k, (name, words) in enumerate(L.TONES.items()):
        bonus = " + 0.5 * (length(x) - length(replace(x, '!', '')))" if name == "enthusiastic" else ""
        rows.append(f"SELECT doc_id, {k} AS k, '{name}' AS tone, {L.TONE_LEVELS[name]} AS level, (len(list_filter(t, lambda w: list_contains({L.sql_list(words)}, w))){bonus}) * (1000.0 / greatest(len(t), 1)) AS s FROM t WHERE len(t) > 0")
    return " UNION ALL ".join(rows)


_TONED = "text || CASE doc_id % 6 WHEN 0 THEN ' amazing wow love!!!' WHEN 1 THEN ' wrong bad fail warning risk' WHEN 2 THEN ' debate myth claim' WHEN 3 THEN ' funny joke' ELSE '' END"


@registry.query(
    f"""WITH t AS (SELECT doc_id, {_TONED} AS x, {SQL_TOKENS.format('(' + _TONED + ')')} AS t FROM documents), s AS ({_sql_tones()}),
r AS (SELECT *, round(s / level, 2) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(s / level, 2) DESC, k) AS n FROM s WHERE s >= level)
SELECT doc_id, n AS rank, tone, CAST(score AS DOUBLE) AS score FROM r WHERE n <= 2"""
)
def tone_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.tones(F.expr(_TONED))).alias("rank", "f"))
    return t.select("doc_id", (F.col("rank") + 1).cast("bigint").alias("rank"), "f.tone", "f.score")


_TONE_KNOWN = L.sql_list([*L.TONES, *L.OTHER_TONES])


@registry.query(
    f"""SELECT conv_id, turn, array_to_string(list_filter(list_concat(list_filter(g, lambda t: list_contains({_TONE_KNOWN}, t)), f), lambda x, i:
  list_position(list_concat(list_filter(g, lambda t: list_contains({_TONE_KNOWN}, t)), f), x) = i)[1:3], ',') AS tones
FROM (SELECT conv_id, turn, [lower(role), 'optimistic', CASE WHEN turn % 2 = 0 THEN 'critical' ELSE 'neutral' END] AS g, ['critical', CASE WHEN turn % 3 = 0 THEN 'humorous' ELSE 'cautionary' END] AS f FROM conversations)"""
)
def merged_tone_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    given = F.array("role", F.lit("Optimistic"), F.when(F.col("turn") % 2 == 0, F.lit("critical")).otherwise(F.lit("neutral")))
    lexical = F.array(F.lit("critical"), F.when(F.col("turn") % 3 == 0, F.lit("humorous")).otherwise(F.lit("cautionary")))
    return c.select("conv_id", "turn", F.array_join(X.merged_tones(lexical, given), ",").alias("tones"))


_EN = L.sql_list(L.ENGLISH)
_EN_HITS = f"len(list_filter(regexp_extract_all(lower({{0}}), '[a-z'']+'), lambda w: list_contains({_EN}, w)))"
_EN_N = "len(regexp_extract_all(lower({0}), '[a-z'']+'))"
_EN_RATIO = f"(CASE WHEN {_EN_N} > 0 THEN {_EN_HITS} / {_EN_N} ELSE 0 END)"


@registry.query(
    f"SELECT doc_id, CAST({_EN_HITS.format('text')} AS INTEGER) AS hits, round({_EN_RATIO.format('text')}, 6) AS ratio, {_EN_RATIO.format('text')} >= 0.2 AS english FROM documents"
)
def english_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", G.english_hits(t).alias("hits"), F.round(G.english_ratio(t), 6).alias("ratio"), (G.english_ratio(t) >= 0.2).alias("english"))


_MIXED = "CASE doc_id % 5 WHEN 0 THEN text || repeat(' привет мир', 200) WHEN 1 THEN text || repeat(' こんにちは世界', 100) WHEN 2 THEN left(text, 20) || ' नमस्ते दुनिया नमस्ते दुनिया' ELSE text END"


def _sql_scripts(c: str) -> str:
    codes = list(dict.fromkeys(code for _, code, _ in L.SCRIPTS))
    count = lambda code: "length(regexp_replace(" + c + ", '[^" + "".join(rf"\p{{{n}}}" for n, k, _ in L.SCRIPTS if k == code) + "]', '', 'g'))"
    n = {k: count(k) for k in codes}
    kana, han = n["Jpan"], n["Hans"]
    n |= {"Jpan": f"CASE WHEN {kana} > 0 THEN {kana} + {han} ELSE 0 END", "Hans": f"CASE WHEN {kana} > 0 THEN 0 ELSE {han} END"}
    return "[" + ", ".join(f"{{'n': {n[k]}, 'script': '{k}'}}" for k in codes) + "]"


_SQL_SCRIPT = f"""m AS (SELECT doc_id, lang, {_MIXED} AS x FROM documents),
c AS (SELECT doc_id, lang, x, {_sql_scripts('x')} AS counts, length(regexp_replace(x, '[^A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]', '', 'g')) AS latin FROM m),
p AS (SELECT *, list_sum(list_transform(counts, lambda q: q.n)) AS other, list_sort(counts)[-1].script AS top FROM c),
q AS (SELECT *, CASE WHEN other > 0 THEN top END AS script, CASE WHEN other > 0 THEN other / (other + latin) ELSE 0 END AS share FROM p)"""


@registry.query(f"WITH {_SQL_SCRIPT} SELECT doc_id, script, round(share, 6) AS share, share > 0.2 AS foreign_script FROM q")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", G.main_script(F.expr(_MIXED)).alias("f"))
    return found.select("doc_id", "f.script", F.round("f.share", 6).alias("share"), (F.col("f.share") > 0.2).alias("foreign_script"))


_LANG_OF = "CASE script " + " ".join(f"WHEN '{code}' THEN '{lang}'" for code, lang in {c: lang for _, c, lang in L.SCRIPTS}.items()) + " END"
_SCRIPT_OF = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.LANGUAGES.items()) + " END"


@registry.query(
    f"""WITH {_SQL_SCRIPT} SELECT doc_id, CASE WHEN share >= 0.3 THEN CASE WHEN {_SCRIPT_OF} = script THEN lang ELSE {_LANG_OF} END WHEN {_EN_RATIO.format('x')} >= 0.2 THEN 'en'
  WHEN lang <> 'en' THEN lang ELSE 'en' END AS language FROM q"""
)
def detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", G.detected(F.expr(_MIXED), F.col("lang")).alias("language"))


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS}, u AS (SELECT video_id, pos, captions.text AS x, lang FROM captions JOIN documents ON doc_id = video_id)
SELECT video_id, pos, CASE WHEN {_EN_HITS.format('x')} >= 2 AND {_EN_HITS.format('x')} / greatest({_EN_N.format('x')}, 1) >= 0.15 THEN 'en' ELSE lang END AS language FROM u"""
)
def unit_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "lang")
    return document_captions(spark, sf_dir).join(docs, "video_id").select("video_id", "pos", G.unit_language(F.col("text"), F.col("lang")).alias("language"))


_CODE = "CASE doc_id % 4 WHEN 0 THEN 'a.' || upper(lang) WHEN 1 THEN lang || '_XX' WHEN 2 THEN ' ' || lang || ' ' ELSE 'qq' END"


@registry.query(
    f"""WITH c AS (SELECT doc_id, regexp_replace(replace(lower(trim({_CODE})), '_', '-'), '^a[.]', '') AS k FROM documents)
SELECT doc_id, CASE WHEN list_contains({L.sql_list(G.LANGUAGES)}, k) THEN k WHEN list_contains({L.sql_list(G.LANGUAGES)}, split_part(k, '-', 1)) THEN split_part(k, '-', 1) END AS code FROM c"""
)
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", G.normal_code(F.expr(_CODE)).alias("code"))


@registry.query(
    f"""WITH {SQL_DOCUMENT_CAPTIONS}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, sum(length(text)) OVER (PARTITION BY video_id) AS total FROM captions),
s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n
  WHERE total <= 4000 OR pos % greatest(1, n // 40) = 0)
SELECT video_id, string_agg(text, ' ' ORDER BY pos) AS sample FROM s WHERE total <= 4000 OR before < 4000 GROUP BY video_id"""
)
def language_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines spread over a video, about 4,000 characters."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id")
    lines = _lines(spark, sf_dir).withColumn("n", F.count("*").over(w)).withColumn("total", F.sum(F.length("text")).over(w))
    some = lines.where((F.col("total") <= 4000) | (F.col("pos") % F.greatest(F.lit(1), F.floor(F.col("n") / 40)) == 0))
    before = F.coalesce(F.sum(F.length("text")).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = some.withColumn("before", before).where((F.col("total") <= 4000) | (F.col("before") < 4000))
    return kept.groupBy("video_id").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY pos)").alias("sample"))
