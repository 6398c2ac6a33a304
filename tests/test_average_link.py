import numpy as np

from chronoloom.operators import average_link as A


def one_by_one(v, k):
    """Labels of average link, one merge at a time, by mean distances between members."""
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    d, groups = 1 - v @ v.T, [[i] for i in range(len(v))]
    while len(groups) > k:
        far = [(round(d[np.ix_(a, b)].mean(), 12), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        _, x, y = min(far)
        groups[x] += groups.pop(y)
    return {frozenset(g) for g in groups}


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.theme, set()).add(r.id)
    return {frozenset(s) for s in out.values()}


def test_against_one_merge_at_a_time(spark):
    """Keys in one task, and keys in blocks of five over many rounds; clustered, spread and repeated vectors."""
    rng = np.random.default_rng(8)
    sets = {
        "spread": rng.standard_normal((24, 4)),
        "clusters": np.repeat(rng.standard_normal((5, 6)), 5, axis=0) + rng.standard_normal((25, 6)) * 0.05,
        "line": np.array([[np.cos(t), np.sin(t)] for t in np.cumsum(np.linspace(0.01, 0.05, 7))]),
        "few": rng.standard_normal((3, 3)),
        "six": rng.standard_normal((6, 3)),
    }
    held = [(name, k, v.tolist()) for name, m in sets.items() for k, v in enumerate(m)] + [("few", 90, None), (None, 1, [1.0])]
    rows = spark.createDataFrame(held, "name string, id long, v array<double>").repartition(3)
    for block in (1024, 6):
        got = A.themes(rows, "name", "v", block=block).collect()
        assert len(got) == len(held)
        for name, m in sets.items():
            n = len(m)
            want = one_by_one(m, 1 if n < 4 else max(2, min(n // 2, 5)))
            own = [r for r in got if r.name == name and r.theme is not None]
            assert found(own) == want, (name, block)
            assert sorted({r.theme for r in own}) == list(range(len(want)))
        assert [r.theme for r in got if r.id == 90 or r.name is None] == [None, None]


def test_equal_vectors_and_zeros(spark):
    rows = spark.createDataFrame([(1, k, [1.0, 0.0] if k < 9 else [0.0, 1.0] if k < 14 else [0.0, 0.0]) for k in range(15)], "key int, id int, v array<double>")
    for block in (1024, 4):
        got = A.themes(rows, "key", "v", most=3, block=block).collect()
        assert found(got) == {frozenset(range(9)), frozenset(range(9, 14)), frozenset([14])}
    assert A.themes(rows.where("id < 0"), "key", "v").count() == 0


def test_vectors_are_merged_where_they_lie(spark):
    """Vectors count as short arrays in the planner's estimates: sums of clusters must not be broadcast."""
    from chronoloom.operators.average_link import _merged

    held = spark.range(4).selectExpr("int(id DIV 100) AS g", "id", "1L AS n", "array(double(id), 1.0D) AS s")  # of known, small size
    plan = _merged(held, spark.range(1).selectExpr("int(id) AS g", "id AS a", "id + 1 AS b", "0.1D AS height"), "g")
    assert plan._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2
    assert {(r.id, r.n, tuple(r.s)) for r in plan.collect()} == {(0, 2, (1.0, 2.0)), (2, 1, (2.0, 1.0)), (3, 1, (3.0, 1.0))}


def test_a_task_holds_slices_of_distances(spark, monkeypatch):
    """However few distances a task holds at a time, merges are those of one at a time; a key of thousands needs no round over tasks."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((40, 5))
    rows = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)], "key int, id long, v array<double>")
    monkeypatch.setattr(A, "CELLS", 50)
    for block in (1024, 12):
        assert found(A.themes(rows, "key", "v", block=block).collect()) == one_by_one(v, 5)
    monkeypatch.undo()
    rounds, pairs_of = [], A._pairs
    monkeypatch.setattr(A, "_pairs", lambda *how: rounds.append(1) or pairs_of(*how))
    many = rng.standard_normal((3000, 8))
    rows = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(many)], "key int, id long, v array<double>")
    assert A.merges(rows, "key", "v").count() == 2999 and not rounds
