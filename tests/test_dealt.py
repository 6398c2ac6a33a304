"""Terms and mentions stay with the texts that they are of."""

import re

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.operators import lexical as C
from chronoloom.operators import tree as T
from chronoloom.plans import outline
from chronoloom.queries import concepts as Q

from .conftest import SMALL


def exchanges(df):
    return [e.group(1) for e in re.finditer(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())]


@pytest.mark.parametrize("name", ["ctfidf_keywords", "tfidf_max_terms"])
def test_terms_are_not_shuffled_by_segment(spark, name):
    dealt = exchanges(getattr(Q, name)(spark, SMALL))
    assert dealt and not any("seg#" in e for e in dealt), dealt


@pytest.mark.parametrize("name", ["concept_sentences", "mention_times", "mention_join"])
def test_texts_are_dealt_once_and_lines_are_not(spark, name):
    dealt = exchanges(getattr(Q, name)(spark, SMALL))
    assert dealt and all(e.startswith("doc_id#") and "," not in e.split(", ")[0] and len(e.split(", ")) == 2 for e in dealt), dealt


def test_dealt_as_counted(spark):
    """Texts of one segment are one; nulls, empty texts and segments of other groups make no difference."""
    texts = spark.createDataFrame(
        [("a", 1, "red red blue"), ("a", 1, "green"), ("a", 2, "blue"), ("a", 3, None), ("a", 4, "..."), ("b", 1, "red"), ("b", 9, "red blue sea"), (None, 5, "red")], "grp string, seg int, text string"
    )
    tf = C.counts(texts.where("grp IS NOT NULL").select("grp", "seg", F.explode(X.tokens(F.col("text"))).alias("term")))
    plain = lambda df: sorted((r.grp, r.seg, r.term, r.tf, round(r.score, 9)) for r in df.collect())
    d = C.dealt(texts, X.tokens)
    assert plain(C.class_tf_idf_of(d)) == plain(C.class_tf_idf(tf))
    assert {(r.grp, r.n, r["size"]) for r in d.groups.collect()} == {("a", 2, 5), ("b", 2, 4)}


def test_phrases_of_videos_are_not_shuffled(spark):
    """Keywords of blocks: texts are dealt by video, and the windows' totals are those of the joins."""
    texts = [("a", 0, "solar panels store power"), ("a", 1, "solar panels, wind farms"), ("a", 2, ""), ("b", 0, "wind farms"), ("b", 1, None)]
    blocks = spark.createDataFrame(texts, "video_id string, block_no int, text string")
    found = outline.keywords(blocks)
    assert all(e.startswith("grp#") and len(e.split(", ")) == 2 for e in exchanges(found)), exchanges(found)
    tf = C.counts(C.phrase_rows(blocks.selectExpr("video_id AS grp", "block_no AS seg", "text"), ["grp", "seg"], "text", 2).where("length(term) > 2"))
    plain = lambda df: sorted((r.grp, r.seg, r.term, round(r.score, 9)) for r in df.collect())
    assert plain(found) == plain(C.top_terms(C.class_tf_idf(tf), 6))


def test_levels_are_of_inner_nodes(spark, monkeypatch):
    """A leaf is written with its table, and not as a level's; repeated ids and nodes that no root reaches are as they were."""
    rows = [("m", "r", None, 0), ("m", "a", "r", 1), ("m", "b", "r", 2), ("m", "x", "y", 0)] + [("m", f"l{k // 2}", "ab"[k % 2], k) for k in range(60)]
    nodes = spark.createDataFrame(rows, "map_id string, node_id string, parent_id string, ord int")
    written = []
    monkeypatch.setattr(T, "cut", lambda df: written.append(df.count()) or df.checkpoint())
    walked = {(r.node_id, r.depth, r.path.replace("0" * 10, "")) for r in T.walk(nodes, written=False).collect()}
    assert walked == {("r", 0, "00")} | {("a", 1, "00/01"), ("b", 1, "00/02")} | {(f"l{k // 2}", 2, f"00/0{1 + k % 2}/{k:02d}") for k in range(60)}
    assert sum(written) == 64 + 3 + 1 + 2 + 0
