import numpy as np
from pyspark.sql import functions as F

from chronoloom.operators import vectors as V
from chronoloom.operators.components import components
from chronoloom.operators.ranks import ranked


def test_near_links_against_all_pairs(spark):
    """Chains of near vectors, equal ones, and strays; few pivots and small blocks."""
    rng = np.random.default_rng(5)
    rows, v = [], rng.standard_normal(8)
    for k in range(300):
        v = rng.standard_normal(8) if k % 40 == 0 else v + rng.standard_normal(8) * 0.15 * np.linalg.norm(v)
        rows.append((k, v.tolist()))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 60, 7)] + [(2000, None), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    m = np.array([r[1] for r in rows if r[0] is not None and r[1]])
    ids = [r[0] for r in rows if r[0] is not None and r[1]]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near, label = m @ m.T >= 0.9, list(range(len(ids)))
    for a, b in np.argwhere(near).tolist():
        x, y = label[a], label[b]
        label = [min(x, y) if c in (x, y) else c for c in label]
    want = {}
    for k, c in zip(ids, label, strict=True):
        want.setdefault(c, set()).add(k)
    for pivots, block in ((4, 16), (64, 1024), (1, 10)):
        links = V.near_links(table, 0.9, pivots=pivots, block=block)
        assert all(near[ids.index(r.a), ids.index(r.b)] for r in links.collect())
        found = {}
        for r in components(links).collect():
            found.setdefault(r.component, set()).add(r.v)
        assert sorted(map(sorted, found.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)
    assert V.near_links(table.where("vec_id < 0"), 0.9).count() == 0


def test_ranked(spark):
    rows = spark.range(500).select(((F.col("id") * 7919) % 500).alias("x"))
    assert all(r.x + 1 == r.n for r in ranked(rows, [F.asc("x")], "n").collect())
    assert ranked(rows.where("x < 0"), [F.asc("x")], "n").count() == 0


def test_similar_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, rng.standard_normal(6).tolist()) for k in range(200)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 4 = 0")
    a, b = (sorted((r.query, r.row, round(r.cosine, 9)) for r in V.similar(queries, rows, 0.3, block=n).collect()) for n in (1000, 7))
    assert a == b and len(a) > 100
    assert V.similar(queries.where("vec_id < 0"), rows, 0.3).count() == 0


def test_similar_in_slices(spark, monkeypatch):
    """A task holds so many products at a time, in both forms of the search; the pairs are those of all products."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((90, 6))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    v = v.astype(np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = sorted((q, r) for q in range(0, 90, 3) for r in range(90) if q != r and v[q] @ v[r] >= 0.3)
    monkeypatch.setattr(V, "CELLS", 64)
    for block in (1000, 7):
        assert sorted((r.query, r.row) for r in V.similar(rows.where("vec_id % 3 = 0"), rows, 0.3, block=block).collect()) == want


def test_copies_are_dealt_in_slices(spark, monkeypatch):
    """Vectors that are copied to all regions are dealt out some copies at a time; the components are the same."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((120, 16))
    v[60:] = v[:60] + rng.standard_normal((60, 16)) * 0.1
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(V, "COPIES", 5)
    found = {r.v: r.component for r in components(V.near_links(rows, 0.9, pivots=8, block=16)).collect()}
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    alone = [k for k in range(60) if m[k] @ m[k + 60] >= 0.9]
    assert len(alone) > 40 and all(found[k] == found[k + 60] == k for k in alone)


def test_copies_are_bounded(spark, monkeypatch):
    """However many blocks there are, no more than some copies of each vector are dealt out at once; the components are those of all pairs."""
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.standard_normal((100, 12)), rng.standard_normal(12) + rng.standard_normal((60, 12)) * 0.05])
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").cache()
    dealt, as_before = [], type(rows).repartition

    def counted(self, *how):
        dealt.append(self.count())
        return as_before(self, *how)

    monkeypatch.setattr(type(rows), "repartition", counted)
    links = V.near_links(rows, 0.9, pivots=2, block=20)
    assert dealt and max(dealt) <= 2 * len(v) + 40
    monkeypatch.undo()
    found = {r.v: r.component for r in components(links).collect()}
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = list(range(len(v)))
    for a, b in np.argwhere(m @ m.T >= 0.9).tolist():
        x, y = sorted((label[a], label[b]))
        label = [x if c == y else c for c in label]
    assert found == {k: c for k, c in enumerate(label) if label.count(c) > 1} and links.count() < 3 * len(v)
