from pyspark.sql import functions as F

from chronoloom.operators import graph as G
from chronoloom.operators import labels as B
from chronoloom.operators import retrieval as R
from chronoloom.operators import tree as T
from chronoloom.operators.components import components
from chronoloom.queries import trees as Q

from .conftest import SMALL

NODES = "map_id int, node_id string, parent_id string, ord long, type string, text string"


def tree(spark):
    rows = [(1, "r", None, 0, "root", "Root"), (1, "a", "r", 0, "section", "A"), (1, "b", "r", 1, "section", "B"), (1, "c", "a", 0, "concept", "C"), (1, "d", "c", 0, "detail", "D")]
    return spark.createDataFrame(rows, NODES)


def replay(spark, ops):
    log = spark.createDataFrame([(1, k, *o) for k, o in enumerate(ops)], "map_id int, seq long, type string, id string, parent_id string, index int, text string")
    return {r.node_id: (r.parent_id, r.ord, r.text) for r in T.apply_ops(tree(spark), log).collect()}


def test_ops_round_trip(spark):
    out = replay(spark, [("add", "x", "a", 0, "X"), ("update", "x", None, None, "Y"), ("move", "x", "b", 9, None), ("remove", "x", None, None, None)])
    assert set(out) == {"r", "a", "b", "c", "d"}


def test_ops_that_no_longer_apply(spark):
    out = replay(spark, [("move", "a", "d", 0, None), ("remove", "r", None, None, None), ("add", "c", "b", None, "again"), ("update", "zz", None, None, "?"), ("remove", "a", None, None, None), ("update", "d", None, None, "?")])
    assert set(out) == {"r", "b"} and out["b"] == ("r", 0, "B")


def test_insert_index_is_clamped(spark):
    out = replay(spark, [("add", "x", "r", 99, "X"), ("add", "y", "r", -5, "Y")])
    assert [k for k, v in sorted(out.items(), key=lambda kv: kv[1][1]) if v[0] == "r"] == ["y", "a", "b", "x"]


def test_walk_and_removal(spark):
    n = tree(spark)
    assert [r.node_id for r in T.walk(n).orderBy("path").collect()] == ["r", "a", "c", "d", "b"]
    gone = n.where("node_id = 'a'").select("map_id", "node_id")
    assert {r.node_id for r in T.without_subtrees(n, gone).collect()} == {"r", "b"}
    assert {r.node_id: r.leaves for r in T.leaf_counts(n).collect()} == {"r": 2, "a": 1, "b": 1, "c": 1, "d": 1}


def test_trees_of_any_depth(spark):
    """A chain of fifty levels and a bush; ids that go in circles are refused."""
    rows = [(1, f"n{k}", f"n{k - 1}" if k else None, 0, "concept", str(k)) for k in range(50)] + [(2, f"m{k}", f"m{(k - 1) // 2}" if k else None, (k - 1) % 2 if k else 0, "concept", str(k)) for k in range(31)]
    n = spark.createDataFrame(rows, NODES).repartition(3)
    walked = {(r.map_id, r.node_id): (r.depth, r.path) for r in T.walk(n).collect()}
    assert len(walked) == 81 and all(walked[1, f"n{k}"][0] == k for k in range(50))
    order = [k for (m, k), _ in sorted(walked.items(), key=lambda kv: (kv[0][0], kv[1][1])) if m == 2]

    def pre(k):
        return [f"m{k}"] + [x for c in (2 * k + 1, 2 * k + 2) if c < 31 for x in pre(c)]

    assert order == pre(0)
    assert T.ancestors(n).where("node_id = 'n49'").count() == 50
    leaves = {(r.map_id, r.node_id): r.leaves for r in T.leaf_counts(n).collect()}
    assert leaves[1, "n0"] == 1 and leaves[2, "m0"] == 16 and leaves[2, "m1"] == 8
    assert {r.node_id for r in T.without_subtrees(n, n.where("node_id IN ('n20', 'm1', 'm0')").select("map_id", "node_id")).collect()} == {f"n{k}" for k in range(20)} | {x for x in pre(0) if x not in pre(1)}
    assert T.outline(T.walk(n), 100).where("map_id = 1").count() == 50


def nested(rows):
    """The same log on nested dictionaries, as a tree is written down."""
    held = {r[1]: {"id": r[1], "type": r[4], "text": r[5], "children": []} for r in rows}
    for r in sorted(rows, key=lambda r: r[3]):
        if r[2] is not None:
            held[r[2]]["children"].append(held[r[1]])
    return next(held[r[1]] for r in rows if r[2] is None)


def find(node, key, parent=None):
    if node["id"] == key:
        return node, parent
    for c in node["children"]:
        if (hit := find(c, key, node))[0]:
            return hit
    return None, None


def ids_of(node):
    return [node["id"]] + [x for c in node["children"] for x in ids_of(c)]


def applied(root, edges, op):
    kind, key, parent_id, index, text, source, target = op
    node, parent = find(root, key)
    home = find(root, parent_id)[0]
    place = lambda row: len(row) if index is None else max(0, min(index, len(row)))
    if kind == "add" and home and not node:
        home["children"].insert(place(home["children"]), {"id": key, "type": "concept", "text": text, "children": []})
    elif kind == "update" and node:
        node["text"] = text
    elif kind == "remove" and parent:
        gone = set(ids_of(node))
        parent["children"].remove(node)
        for e in [e for e, ends in edges.items() if gone & set(ends)]:
            edges.pop(e)
    elif kind == "move" and parent and home and home["id"] not in ids_of(node):
        parent["children"].remove(node)
        home["children"].insert(place(home["children"]), node)
    elif kind == "edge:add" and key not in edges:
        edges[key] = (source, target)
    elif kind == "edge:remove":
        edges.pop(key, None)


OPS = "map_id int, seq long, type string, id string, parent_id string, index int, text string, source string, target string"


def flat(node, parent=None, ord_=0):
    return {(node["id"], parent, ord_, node["text"]) for _ in [0]}.union(*[flat(c, node["id"], k) for k, c in enumerate(node["children"])])


def test_random_logs_against_nested_trees(spark):
    """Nodes, edges, and the inverses, which taken backwards lead to where the log began."""
    import random

    rng = random.Random(3)
    start = [(m, "r", None, 0, "root", "R") for m in range(6)] + [(m, f"s{k}", "r", k, "section", f"S{k}") for m in range(6) for k in range(4)]
    ops, want_nodes, want_edges = [], {}, {}
    for m in range(6):
        root, edges = nested([r for r in start if r[0] == m]), {"e0": ("s0", "s1")}
        names = ["r", *(f"s{k}" for k in range(4)), *(f"x{k}" for k in range(14))]
        for seq in range(120):
            kind = rng.choice(["add", "add", "add", "update", "remove", "move", "move", "edge:add", "edge:add", "edge:remove"])
            key = f"e{rng.randrange(8)}" if kind.startswith("edge") else rng.choice(names)
            op = (kind, key, rng.choice(names), rng.choice([None, 0, 1, 9, -2]), f"t{seq}", rng.choice(names), rng.choice(names))
            ops.append((m, seq, *op))
            applied(root, edges, op)
        want_nodes[m], want_edges[m] = flat(root), set((e, *ends) for e, ends in edges.items())
    nodes_, log = spark.createDataFrame(start, NODES), spark.createDataFrame(ops, OPS)
    edges_ = spark.createDataFrame([(m, "e0", "s0", "s1") for m in range(6)], "map_id int, edge_id string, source string, target string")
    got = T.apply_ops(nodes_, log, edges_)
    for m in range(6):
        assert {(r.node_id, r.parent_id, r.ord, r.text) for r in got.where(f"map_id = {m}").collect()} == want_nodes[m]
        assert {(r.edge_id, r.source, r.target) for r in T.apply_edge_ops(nodes_, log, edges_).where(f"map_id = {m}").collect()} == want_edges[m]
    back = T.inverses(nodes_, log, edges_)
    take_back = back.selectExpr("map_id", "1000000 - seq * 1000 + part AS seq", "type", "id", "parent_id", "index", "text", "node_type", "source", "target")
    both = log.withColumn("node_type", F.lit(None).cast("string")).unionByName(take_back)
    assert {(r.map_id, r.node_id, r.parent_id, r.ord, r.text) for r in T.apply_ops(nodes_, both, edges_).collect()} == {(r[0], r[1], r[2], r[3], r[5]) for r in start}
    assert T.apply_edge_ops(nodes_, both, edges_).count() == 6


def test_undo_and_redo(spark):
    """Steps are undone the last first; a new edit ends what can be redone; what others did is not undone."""
    assert replay(spark, [("add", "x", "a", 0, "X"), ("undo", None, None, None, None)]).keys() == {"r", "a", "b", "c", "d"}
    out = replay(spark, [("add", "x", "a", 0, "X"), ("update", "b", None, None, "B2"), ("undo", None, None, None, None), ("undo", None, None, None, None), ("redo", None, None, None, None)])
    assert out["b"][2] == "B" and out["x"] == ("a", 0, "X")
    out = replay(spark, [("remove", "a", None, None, None), ("undo", None, None, None, None)])
    assert {k: v[:2] for k, v in out.items()} == {"r": (None, 0), "a": ("r", 0), "b": ("r", 1), "c": ("a", 0), "d": ("c", 0)}
    out = replay(spark, [("add", "x", "a", 0, "X"), ("undo", None, None, None, None), ("update", "b", None, None, "B2"), ("redo", None, None, None, None)])
    assert "x" not in out and out["b"][2] == "B2"
    assert "y" in replay(spark, [("add", f"x{k}", "a", 0, "X") for k in range(2)] + [("add", "y", "a", 0, "Y")] + [("undo", None, None, None, None)] * 1 + [("redo", None, None, None, None)])


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.v: r.component for r in components(edges).collect()}
    assert all(found[k] == 0 for k in range(41)) and found[101] == 100
    assert components(edges.where("a < 0")).count() == 0


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (2, 3, 0.5)], "a long, b long, weight double")
    ranks = G.pagerank(edges, 30)
    assert abs(ranks.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    two = spark.createDataFrame([(0, 1, 9.0), (1, 2, 9.0), (0, 2, 9.0), (2, 3, 0.1), (3, 4, 9.0), (4, 5, 9.0), (3, 5, 9.0)], "a long, b long, weight double")
    assert len({r.community for r in G.communities(two).collect()}) == 2


def test_label_lines(spark):
    answer = "R|Great talk\n- S|s1|First part|about it\n**C**|c1|Qubit|a two state bit\nD|c1|Def|is a unit\n[c2]|Bare label\nX|c1 -> c2|leads to\nnonsense\nS|s1|Second\n```\nC|c9"
    rows = B.parsed(spark.createDataFrame([(1, answer), (2, "")], "answer_id int, text string")).orderBy("line").collect()
    held = [(r.kind, r.target, r.tag, r.label) for r in rows if r.first]
    assert held == [("R", "R", None, "Great talk"), ("S", "s1", None, "First part"), ("C", "c1", None, "Qubit: a two state bit"), ("D", "c1", "Def", "is a unit"), ("C", "c2", None, "Bare label"), ("X", None, None, "leads to")]
    assert sum(not r.ok for r in rows) == 2


def test_budget(spark):
    rows = spark.createDataFrame([(1, k, float(k), 1.0 - k / 100, "word " * (400 if k < 6 else 2)) for k in range(20)], "v int, pos int, start double, score double, text string")
    assert 5 <= R.within_budget(rows, ["v"], [F.desc("score")]).count() <= 8


def test_components_of_edges_that_differ_between_runs(spark):
    """Each run ties a group's points in another order; the components are the same."""

    def chain(frames):
        import random

        import pandas as pd

        for f in frames:
            rows = []
            for _, own in f.groupby("g"):
                v = own["id"].tolist()
                random.SystemRandom().shuffle(v)
                rows += list(zip(v, v[1:], strict=False))
            yield pd.DataFrame(rows, columns=["a", "b"])

    points = spark.range(0, 400, 1, 1).withColumn("g", F.col("id") % 8)
    found = components(points.mapInPandas(chain, "a long, b long")).collect()
    assert len(found) == 400 and all(r.component == r.v % 8 for r in found)


def test_logs_are_read_in_slices(spark, monkeypatch):
    """A task reads a map's log some lines at a time, whatever the lines come in; several maps in one partition."""
    monkeypatch.setattr(T, "LINES", 3)
    start = spark.createDataFrame([(m, "r", None, 0, "root", "R") for m in range(3)], NODES)
    ops = spark.createDataFrame([(m, k, "add", f"x{k}", "r", 0, f"t{k}") for m in range(3) for k in range(40)], "map_id int, seq long, type string, id string, parent_id string, index int, text string")
    rows = T.apply_ops(start, ops.repartition(7)).collect()
    assert {(r.map_id, r.node_id, r.ord) for r in rows if r.node_id != "r"} == {(m, f"x{k}", 39 - k) for m in range(3) for k in range(40)} and len(rows) == 123
    assert {(r.map_id, r.seq, r.part, r.type, r.id) for r in T.inverses(start, ops).collect()} == {(m, k, 0, "remove", f"x{k}") for m in range(3) for k in range(40)}


def test_nodes_are_made_once_where_subtrees_go(spark):
    """The rest is told from what was written: no table is read again, and marks may be a column, null where nothing is said."""
    n = spark.createDataFrame([(1, "r", None, 0), (1, "a", "r", 3), (1, "b", "a", None), (1, "c", "b", 1), (1, "d", "r", 1), (2, "r", None, 3), (2, "a", "r", 1)], "map_id int, node_id string, parent_id string, v int")
    assert sorted((r.map_id, r.node_id) for r in T.without_subtrees(n, F.col("v") == 3).collect()) == [(1, "d"), (1, "r"), (2, "a"), (2, "r")]
    plan = Q.subtree_remove(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower(), plan
