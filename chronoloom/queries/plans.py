"""Queries of whole plans, and of models fitted with Spark's own library."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import timeline as T
from ..operators import topics
from ..plans import outline
from ..sources.tables import SQL_CONVERSATION_CAPTIONS, conversation_captions, document_captions, table
from . import Registry
from .timeline import SQL_ENTRIES, sql_blocks

registry = Registry()

_STOPS, _EDGES, _VERBS = L.sql_list(L.STOPS), L.sql_list(L.EDGE_ADJECTIVES), L.sql_list(L.VERBS)


@registry.query(
    f"""WITH RECURSIVE {SQL_CONVERSATION_CAPTIONS}, {SQL_ENTRIES}, {sql_blocks(T.BLOCK)},
clauses AS (SELECT video_id, block_no, unnest(regexp_split_to_array(lower(text), '{X.CLAUSE_BREAK}')) AS k FROM blocks),
ws AS (SELECT video_id, block_no, regexp_extract_all(k, '{X.PHRASE_WORD.replace("'", "''")}') AS w FROM clauses),
sized AS (SELECT *, unnest([1, 2]) AS n FROM ws),
grams AS (SELECT video_id, block_no, unnest([w[i:i + n - 1] FOR i IN range(1, len(w) - n + 2)]) AS g FROM sized WHERE len(w) >= n),
tf AS (SELECT video_id AS grp, block_no AS seg, array_to_string(g, ' ') AS term, count(*) AS tf FROM grams
  WHERE NOT list_contains({_STOPS}, g[1]) AND NOT list_contains({_STOPS}, g[-1]) AND NOT list_contains({_EDGES}, g[-1])
    AND len(list_filter(g, lambda x: list_contains({_VERBS}, x) OR ends_with(x, 'ly') OR length(x) < 2)) = 0 AND length(array_to_string(g, ' ')) > 2 GROUP BY ALL),
t AS (SELECT *, sum(tf) OVER (PARTITION BY grp, seg) AS st, sum(tf) OVER (PARTITION BY grp, term) AS tt, sum(tf) OVER (PARTITION BY grp) AS gt FROM tf),
n AS (SELECT grp, count(DISTINCT seg) AS n FROM tf GROUP BY grp), s AS (SELECT grp, seg, term, tf / st * ln(1 + (gt / n) / tt) AS score FROM t JOIN n USING (grp))
SELECT grp, seg, term, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY grp, seg ORDER BY round(score, 9) DESC, term) AS INTEGER) AS rank FROM s WHERE score > 0 QUALIFY rank <= 6"""
)
def block_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key phrases of each block of talk: captions, entries, blocks, phrases, class TF-IDF."""
    blocks = T.blocks(T.normalized(conversation_captions(spark, sf_dir)))
    return outline.keywords(blocks).withColumn("score", F.round("score", 6))


@registry.query()
def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of every document."""
    return outline.build(document_captions(spark, sf_dir), "revision")["nodes"]


@registry.query()
def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main topic of each document. All words and all documents count; the model, topics times words, is a table."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.filter(X.tokens(F.col("text")), lambda w: ~w.isin(L.STOPS)).alias("words"))
    return topics.dominant(words, "doc_id", "words", k=8, rounds=10)


@registry.query()
def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in four groups."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=4, seed=42).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("grp"))
