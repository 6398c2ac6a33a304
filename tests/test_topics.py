"""Topics are those of the words, wherever rows lie and however they are dealt in tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import topics
from chronoloom.queries import plans

from .conftest import SMALL


def planted(spark):
    """Three subjects of 30 words, and some words of all; no words, none at all, repeated and null keys."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        own = [f"s{k % 3}w{w}" for w in rng.integers(0, 30, 40)]
        rows.append((k, own + [f"common{w}" for w in rng.integers(0, 5, 6)]))
    return spark.createDataFrame([*rows, (200, []), (201, None), (None, rows[0][1]), (5, rows[5][1])], "doc_id long, words array<string>")


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.topic) for r in df.collect())


def test_digamma():
    x = np.array([1e-3, 0.125, 1.0, 2.5, 40.0])
    assert np.allclose(topics.digamma(x), [-1000.5755719318103, -8.388492663295854, -0.5772156649015329, 0.7031566406452432, 3.676327374703474], rtol=1e-8)


@pytest.mark.parametrize("tile, parts", [(1 << 22, 1), (300, 5)])
def test_planted_subjects(spark, tile, parts, monkeypatch):
    rows = rows_of(topics.dominant(planted(spark).coalesce(1), "doc_id", "words", k=3))
    assert len(rows) == 124
    of = {d: t for null, d, t in rows if not null}
    assert of[200] == of[201] == 0
    assert all(len({of[d] for d in range(k, 120, 3)}) == 1 for k in range(3)) and len({of[0], of[1], of[2]}) == 3
    assert [t for null, _, t in rows if null] == [of[0]] and sum(d == 5 for _, d, _ in rows) == 2
    monkeypatch.setattr(topics, "TILE", tile)
    assert rows_of(topics.dominant(planted(spark).repartition(parts), "doc_id", "words", k=3)) == rows


def test_topics_do_not_depend_on_where_rows_lie(spark, tmp_path):
    """The same topics from one file and from seven, sorted otherwise. (Spark's LDA draws its rows by partition.)"""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(7, F.xxhash64("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(plans.lda_topics(spark, SMALL)) == rows_of(plans.lda_topics(spark, str(tmp_path)))


def test_no_rows(spark):
    assert topics.dominant(planted(spark).limit(0), "doc_id", "words").count() == 0


def test_tiles_go_in_passes(spark, monkeypatch):
    """Small tiles, of which a pass takes few, give the topics of one pass; what a pass writes is let go before the next."""
    rows = rows_of(topics.dominant(planted(spark).coalesce(1), "doc_id", "words", k=3, rounds=2))
    tidied = []
    monkeypatch.setattr(topics, "TILE", 300)
    monkeypatch.setattr(topics, "SENT", 1000)
    monkeypatch.setattr(topics, "tidy", lambda s: tidied.append(s))
    assert rows_of(topics.dominant(planted(spark).coalesce(1), "doc_id", "words", k=3, rounds=2)) == rows
    assert len(tidied) >= 4  # two passes a round at least
