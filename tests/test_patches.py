from chronoloom.operators import labels as B
from chronoloom.operators import patches as A
from chronoloom.operators import tree as T

NODE = "map_id int, node_id string, parent_id string, ord long, type string, text string, summary string, tag string, oneline boolean"
CAND = "map_id int, cid string, node_id string, place long, sid string, of string, fixed boolean, recall boolean"
EDGE = "map_id int, edge_id string, source string, target string, label string, ord long"
NODES = [
    (1, "r", None, 0, "root", "Old talk", None, None, None),
    (1, "s1", "r", 0, "section", "Start", None, None, None),
    (1, "s2", "r", 1, "section", "Middle", None, None, None),
    (1, "s3", "r", 2, "section", "Recall", None, None, None),
    (1, "one", "s3", 0, "concept", "line", None, None, True),
    (1, "a", "s1", 0, "concept", "Cats", None, None, None),
    (1, "b", "s1", 1, "concept", "Dogs", None, None, None),
    (1, "c", "s2", 0, "concept", "Birds", None, None, None),
    (1, "d", "s3", 1, "concept", "Fish", None, None, None),
    (1, "x", "a", 0, "detail", "Tip: feed", None, "Tip", None),
    (1, "y", "a", 1, "detail", "Def: fur", None, "Def", None),
    (1, "z", "b", 0, "detail", "barks", None, None, None),
]
CANDS = [
    (1, "s1", "s1", 0, None, None, False, False), (1, "s2", "s2", 1, None, None, True, False), (1, "s3", "s3", 2, None, None, False, True),
    (1, "c1", "a", 0, "s1", None, None, None), (1, "c2", "b", 1, "s1", None, None, None), (1, "c3", "c", 2, "s2", None, None, None), (1, "c4", "d", 3, "s3", None, None, None),
    (1, "d1", "x", 0, None, "c1", None, None), (1, "d2", "y", 1, None, "c1", None, None), (1, "d3", "z", 2, None, "c2", None, None),
]


def made(spark, answer, edges=()):
    tables = spark.createDataFrame(NODES, NODE), spark.createDataFrame(CANDS, CAND), spark.createDataFrame(list(edges), EDGE)
    lines = B.parsed(spark.createDataFrame([(1, answer)], "answer_id int, text string"))
    patched, linked = A.patches(tables[0], tables[1], lines), A.links(tables[1], lines, tables[2])
    return tables[0], patched, linked, {r.node_id: (r.text, r.summary, r.tag) for r in patched.collect()}


def test_titles_summaries_and_duplicates(spark):
    answer = "R|New talk\nS|s1|First part|how it starts\nS|s2|Not taken|in between\nC|c1|Cats\nC|c2|first  PART!\nC|c3|Old talk\nC|c9|Nobody"
    _, _, _, got = made(spark, answer)
    assert got == {
        "r": ("New talk", "First part · Not taken", None),
        "s1": ("First part", "how it starts", None),
        "s2": (None, "in between", None),  # its title is fixed
        "c": ("Old talk", None, None),  # the root has another now; c2 would repeat a section, c1 changes nothing
    }


def test_recall_and_details(spark):
    answer = "M|All of it in short\nS|s3|Look back|ignored\nD|d1|Eg|a bowl\nD|c1|Tip|feed them\nD|c1|Def|soft hair\nD|c1|Formula|nothing left\nD|c2|loud\nD|c9|Tip|nobody"
    _, _, _, got = made(spark, answer)
    assert got == {
        "r": (None, "All of it in short", None),
        "s3": ("Look back", "All of it in short", None),
        "one": ("In one line: All of it in short", None, None),
        "x": ("Eg: a bowl", None, "Eg"),  # a direct answer goes before those through the concept
        "y": ("Def: soft hair", None, None),
        "z": ("loud", None, None),
    }


def test_edges_are_replaced_and_the_log_replays(spark):
    edges = [(1, "e1", "c", "a", "related to", 0), (1, "e2", "b", "c", "part of", 1)]
    answer = "C|c1|Small cats\nX|c1->c3|leads to\nX|c2->c3|causes\nX|c1->c2|same section\nX|c1->c4|to recall"
    nodes, patched, linked, _ = made(spark, answer, edges)
    ops = [(r.type, r.source, r.target, r.label) if r.type == "edge:add" else (r.type, r.edge_id) for r in linked.orderBy("seq").collect()]
    assert ops == [("edge:remove", "e1"), ("edge:add", "a", "c", "leads to")]
    log = A.as_log(patched, linked)
    after = {r.node_id: r.text for r in T.apply_ops(nodes, log, spark.createDataFrame(edges, EDGE)).collect()}
    assert after == {n[1]: "Small cats" if n[1] == "a" else n[5] for n in NODES}
    left = {(r.source, r.target) for r in T.apply_edge_ops(nodes, log, spark.createDataFrame(edges, EDGE)).collect()}
    assert left == {("a", "c"), ("b", "c")}
    assert {r.node_id: r.text for r in A.patched_nodes(nodes, patched).collect()} == after
    assert A.patches(nodes, spark.createDataFrame(CANDS, CAND), B.parsed(spark.createDataFrame([], "answer_id int, text string"))).count() == 0
