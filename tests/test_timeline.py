import random

from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.operators import joins as J
from chronoloom.operators import timeline as T
from chronoloom.plans import outline

TOPICS = ["qubit superposition", "garden compost", "jazz harmony", "volcano magma", "router packet"]


def lecture(spark, repeats=4):
    lines, t = [], 0
    for topic in TOPICS:
        for k in range(4 * repeats):
            lines.append((1, t, t * 6.0, t * 6.0 + 6.0, f"The {topic} lesson {topic} has part {k % 4} about {topic}."))
            t += 1
    return spark.createDataFrame(lines, "video_id long, pos int, start double, end double, text string")


def test_blocks_against_a_loop(spark):
    rng = random.Random(3)
    rows, t = [], 0.0
    for k in range(300):
        d = rng.choice([1.0, 4.0, 9.0])
        rows.append((k % 3, k, t, t + d, rng.choice(["word.", "word", "said so!"]), rng.random() < 0.1))
        t += d
    entries = spark.createDataFrame(rows, "video_id long, idx int, start double, end double, text string, new_speaker boolean")
    found = {(r.video_id, r.idx): r.block_no for r in T.block_numbers(entries).collect()}
    for v in range(3):
        no, first, before = -1, None, ""
        for _, idx, start, end, text, speaker in (r for r in rows if r[0] == v):
            if first is None or speaker or end - first > 40 or (end - first > 25 and before.endswith((".", "!"))):
                no, first = no + 1, start
            before = text
            assert found[(v, idx)] == no


def test_chapters_need_a_first_at_zero(spark):
    rows = spark.createDataFrame([(1, "0:00 Intro\n1:36 Two\nnone\n6:24 - Last", 400.0), (2, "0:30 Late\n1:00 More", 90.0), (3, "0:00 Only", 9.0)], "video_id int, description string, duration double")
    found = [(r.video_id, r.title, r.start, r.end) for r in T.chapters(rows).orderBy("video_id", "chap_no").collect()]
    assert found == [(1, "Intro", 0.0, 96.0), (1, "Two", 96.0, 384.0), (1, "Last", 384.0, 400.0)]


def test_as_of(spark):
    nodes = spark.createDataFrame([(1, 10, 0.0, 1), (1, 11, 5.0, 1), (1, 12, 5.0, 2)], "video_id int, node int, start double, depth int")
    ticks = spark.createDataFrame([(1, 4.4), (1, 4.6), (1, 9.0)], "video_id int, t double")
    assert [(r.t, r.node) for r in J.as_of(ticks, nodes, 0.5).orderBy("t").collect()] == [(4.4, 10), (4.6, 12), (9.0, 12)]


def test_boundaries_keep_their_distance(spark):
    gaps = spark.createDataFrame([(1, k, k * 25.0, float(d), 500.0, 20) for k, d in enumerate([5, 1, 9, 8, 1, 2, 7, 1, 1, 6, 1, 1, 3, 1, 1, 1, 4, 1, 9], 1)], "v int, gap int, start double, depth double, duration double, n int")
    starts = sorted(r.start for r in T.boundaries(gaps, "v", "deep").collect())
    assert starts and all(b - a >= 45 for a, b in zip([0.0, *starts], [*starts, 500.0], strict=True)) and len(starts) <= 3


def test_outline_of_a_lecture(spark):
    made = outline.build(lecture(spark), "revision")
    nodes = made["nodes"].collect()
    kinds = {k: [n for n in nodes if n.type == k] for k in ("root", "section", "concept", "detail")}
    assert len(kinds["root"]) == 1 and 2 <= len(kinds["section"]) <= 6 and kinds["concept"] and kinds["detail"]
    assert all(n.start <= n.end for n in nodes)
    ids = {n.node_id for n in nodes}
    assert len(ids) == len(nodes) and all(n.parent_id in ids for n in nodes if n.parent_id)
    entries = made["entries"].agg(F.max("end")).first()[0]
    assert entries == 480.0


def test_concepts_that_were_not_used_before(spark):
    """Sections in order: fresh terms first, used ones only to fill up."""
    rows = [(1, 0, ["a b", "c", "d", "e"]), (1, 1, ["c", "x", "a b", "y", "z"]), (1, 2, ["c", "a b"]), (2, 0, ["c", "x"]), (3, 0, [])]
    heads = spark.createDataFrame([(v, s, float(s), float(s + 1), k) for v, s, k in rows], "video_id int, seg_no int, start double, end double, k array<string>")
    found = {}
    for r in outline.picks(heads, 2).orderBy("video_id", "seg_no", "i").collect():
        found.setdefault((r.video_id, r.seg_no), []).append(r.term)
    assert found == {(1, 0): ["a b", "c"], (1, 1): ["x", "y"], (1, 2): ["c", "a b"], (2, 0): ["c", "x"]}


def test_meanings(spark):
    lines = [
        ("A qubit is a unit of quantum information, which can be mixed", "qubit", "unit of quantum information, which can be mixed"), ("The qubit's colour means the sum of both", "qubit", None),
        ("Entanglement refers to linked states", "entanglement", None), ("Gates make qubits turn around twice", "gates", "make qubits turn around twice"), ("nothing here", "qubit", None), ("qubit", "qubit", None),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(lines)], "k int, text string, term string")
    found = {r.k: r.m for r in rows.select("k", X.meaning(F.col("text"), F.col("term")).alias("m")).collect()}
    assert [found[k] for k in range(len(lines))] == [m for _, _, m in lines]


def test_details_of_a_concept(spark):
    said = [(1, 0, 0, k, float(k), t, tag, m) for k, (t, tag, m) in enumerate([("first", None, None), ("is x", None, "a meaning of it"), ("eg one", "Eg", None), ("tip", "Tip", None), ("eg two", "Eg", None)])]
    said += [(1, 0, 1, 9, 9.0, "only", None, None)]
    rows = spark.createDataFrame(said, "video_id int, seg_no int, i int, idx int, at double, text string, tag string, meaning string")
    anchors = rows.groupBy("video_id", "seg_no", "i").agg(F.min_by(F.struct("idx", "text", "meaning"), F.struct(F.col("meaning").isNull(), F.col("idx"))).alias("a"))
    held = lambda n, more: sorted((r.i, r.ord, r.tag, r.text) for r in outline.details(rows, anchors, n, more).collect())
    assert {(i, tag, t) for i, _, tag, t in held(2, False)} == {(0, "Eg", "eg one"), (0, "Tip", "tip"), (1, "Def", "only")}
    assert {t for i, _, _, t in held(5, True) if i == 0} == {"first", "eg one", "tip", "eg two"}


def test_empty_captions(spark):
    empty = spark.createDataFrame([], "video_id long, pos int, start double, end double, text string")
    assert T.blocks(T.normalized(empty)).count() == 0
