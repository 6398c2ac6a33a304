from pyspark.sql import functions as F

from chronoloom.operators import merge as M
from chronoloom.operators import providers as V
from chronoloom.sources import payloads as P
from chronoloom.sources import sinks as K

NODE = "map_id int, node_id string, parent_id string, ord long, type string, text string"


def test_merge_twice_changes_nothing_more(spark):
    base = spark.createDataFrame([(1, "r", None, 0, "root", "Root"), (1, "a", "r", 0, "section", "Cats"), (1, "b", "r", 1, "section", "Dogs"), (1, "c", "a", 0, "concept", "Fur")], NODE)
    other = spark.createDataFrame([(1, "R", None, 0, "root", "Other"), (1, "x", "R", 0, "section", "cats!"), (1, "y", "R", 1, "section", "Birds"), (1, "z", "x", 0, "concept", "fur"), (1, "w", "x", 1, "concept", "Claws"), (1, "b", "R", 2, "section", "renamed")], NODE)
    out = {r.node_id: (r.parent_id, r.sources) for r in M.merge_maps(base, other).collect()}
    assert set(out) == {"r", "a", "b", "c", "y", "w"}
    assert out["w"] == ("a", ["other"]) and out["y"] == ("r", ["other"]) and out["b"][1] == ["base", "other"] and out["c"][1] == ["base", "other"]


def test_one_to_one(spark):
    base = spark.createDataFrame([(1, "r", None, 0, "root", "R"), (1, "a", "r", 0, "section", "Same")], NODE)
    other = spark.createDataFrame([(1, "R", None, 0, "root", "R"), (1, "x", "R", 0, "section", "same"), (1, "y", "R", 1, "section", "same")], NODE)
    assert {r.node_id for r in M.merge_maps(base, other).collect()} == {"r", "a", "y"}


def test_merge_of_deep_maps(spark):
    """Chains of thirty levels in two maps: the first fifteen are alike."""
    chain = lambda m, mark: [(m, f"{mark}{k}", f"{mark}{k - 1}" if k else None, 0, "concept", f"Same {k}" if k < 15 else f"{mark} {k}") for k in range(30)]
    base, other = (spark.createDataFrame(chain(1, mark) + chain(2, mark), NODE) for mark in "ab")
    out = {(r.map_id, r.node_id): (r.parent_id, r.sources) for r in M.merge_maps(base, other).collect()}
    assert len(out) == 90 and out[2, "b15"] == ("a14", ["other"]) and out[1, "b29"] == ("b28", ["other"]) and out[1, "a14"][1] == ["base", "other"]


def test_merge_by_vectors_and_what_nodes_carry(spark):
    wide = NODE + ", v array<double>"
    base = spark.createDataFrame([(1, "r", None, 0, "root", "R", [1.0, 0.0]), (1, "a", "r", 0, "section", "A", [1.0, 0.1]), (1, "b", "r", 1, "section", "B", [0.0, 1.0])], wide)
    other = spark.createDataFrame([(1, "R", None, 0, "root", "R", [0.0, 1.0]), (1, "x", "R", 0, "section", "X", [0.9, 0.2]), (1, "y", "R", 1, "section", "Y", [0.95, 0.1]), (1, "z", "R", 2, "concept", "Z", [0.0, 1.0])], wide)
    met = {r.node_id: r.sources for r in M.merge_maps(base, other, M.alike_vectors(base, other)).collect()}
    assert met == {"r": ["base", "other"], "a": ["base", "other"], "b": ["base"], "y": ["other"], "z": ["other"]}
    rows = spark.createDataFrame([("one", "two", ["a", "b"], ["b", "c", "d"]), ("one", "on", None, ["x"]), (None, "n", ["a"], None), ("m", None, None, None)], "n string, m string, t array<string>, u array<string>")
    held = rows.select(M.merged_notes(F.col("n"), F.col("m")).alias("n"), M.merged_tones(F.col("t"), F.col("u")).alias("t")).collect()
    assert [(r.n, r.t) for r in held] == [("one\n\ntwo", ["a", "b", "c"]), ("one", ["x"]), ("n", ["a"]), ("m", [])]
    links = "array<struct<url:string,title:string>>"
    pair = spark.createDataFrame([([("u", "1")], [("u", "2"), ("w", "3")]), (None, [("u", "2")]), ([("u", "1")], None)], f"a {links}, b {links}")
    assert [[x.title for x in r.l] for r in pair.select(M.merged_links(F.col("a"), F.col("b")).alias("l")).collect()] == [["1", "3"], ["2"], ["1"]]
    edge = "map_id int, edge_id string, source string"
    both = M.merged_edges(spark.createDataFrame([(1, "e", "a")], edge), spark.createDataFrame([(1, "e", "b"), (2, "e", "c"), (1, "f", "d")], edge))
    assert sorted((r.map_id, r.edge_id, r.source) for r in both.collect()) == [(1, "e", "a"), (1, "f", "d"), (2, "e", "c")]


def test_json_after_a_marker(spark):
    page = 'x = {"no": 1}; var data = {"a": "} \\" {", "b": {"n": [1, {"n": 2}]}}; more }'
    rows = spark.createDataFrame([(1, page), (2, "nothing"), (3, None)], "k int, html string").select("k", P.json_after("var data")("html").alias("j"))
    assert {r.k: r.j for r in rows.collect()} == {1: '{"a": "} \\" {", "b": {"n": [1, {"n": 2}]}}', 2: None, 3: None}
    assert [(r.k, r.value) for r in P.values_under(rows, "k", "j", "n").orderBy("place").collect()] == [(1, '[1, {"n": 2}]'), (1, "2")]


def test_event_captions(spark):
    text = '{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":"a "},{"utf8":"b"}]},{"tStartMs":2000},{"tStartMs":3000,"segs":[{"utf8":"\\n"}]}]}'
    rows = P.event_captions(spark.createDataFrame([(1, text)], "video_id int, payload string")).collect()
    assert [(r.start, r.end, r.text) for r in rows] == [(1.0, 1.5, "a b")]


def test_video_ids(spark):
    given = ["abcdefghijk", "https://youtu.be/abcdefghijk?t=1", "https://host/watch?x=1&v=abcdefghijk", "https://host/shorts/abcdefghijk", "nope"]
    rows = spark.createDataFrame([(x,) for x in given], "x string").select(P.video_id(F.col("x")).alias("v")).collect()
    assert [r.v for r in rows] == ["abcdefghijk"] * 4 + [None]


def test_provider_is_called_by_language(spark):
    rows = spark.createDataFrame([(1, "hola", "es"), (2, "hi", "en"), (3, "", "es"), (4, "oui", "fr")], "k int, text string, lang string")
    out = {r.k: r.translated for r in V.provided(rows, lambda texts, lang: [f"{lang}:{t}" if lang == "es" else None for t in texts]).collect()}
    assert out == {1: "es:hola", 2: "hi", 3: "", 4: "oui"}


def test_guard_looks_up_foreign_labels(spark):
    n = spark.createDataFrame([("a", "привет"), ("b", "hello")], "node_id string, text string")
    d = spark.createDataFrame([("привет", "hi")], "text string, translation string")
    assert {r.node_id: r.text for r in V.guarded(n, d).collect()} == {"a": "hi", "b": "hello"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "map_id int, text string")
    K.save_by_key(df, f"{tmp_path}/maps", "map_id")
    K.save_by_key(spark.createDataFrame([(2, "c")], "map_id int, text string"), f"{tmp_path}/maps", "map_id")
    assert {r.text for r in spark.read.parquet(f"{tmp_path}/maps").collect()} == {"a", "c"}
    assert K.read_key(spark, f"{tmp_path}/maps", "map_id", 2).first().text == "c"
    K.save_lines(spark.createDataFrame([("b", "2"), ("a", "1")], "path string, line string"), f"{tmp_path}/lines")
    assert [r.value for r in spark.read.text(f"{tmp_path}/lines").collect()] == ["1", "2"]
    K.save_ndjson(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
