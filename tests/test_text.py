import pytest
from pyspark.sql import functions as F

from chronoloom.functions import language as G
from chronoloom.functions import lexicon as L
from chronoloom.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("given", "said"),
    [
        ("[Music] Um, hello &amp;amp; welcome", "hello & welcome"),
        (">> So uh it  works (laughs)", "So it works"),
        ("&lt;b&gt; you know, fine", "<b> fine"),
        ("album", "album"),
        (None, ""),
    ],
)
def test_clean_caption(spark, given, said):
    assert one(spark, X.clean_caption(F.col("x")), given) == said


@pytest.mark.parametrize(("given", "is_new"), [(">> hi", True), ("- hi", True), ("Anna B: hi", True), ("&gt;&gt; hi", True), ("hi there", False), ("it is: so", False)])
def test_new_speaker(spark, given, is_new):
    assert one(spark, X.is_new_speaker(F.col("x")), given) is is_new


def test_sentences(spark):
    assert one(spark, X.sentences(F.col("x")), 'One is here. Two! "Three"? no split. 4 yes') == ["One is here.", "Two!", '"Three"? no split.', "4 yes"]
    assert one(spark, X.sentences(F.col("x")), "  ") == []


def test_truncated(spark):
    assert one(spark, X.truncated(F.col("x"), 11), "one two three four") == "one two…"
    assert one(spark, X.truncated(F.col("x"), 40), "short") == "short"


@pytest.mark.parametrize(("seconds", "shown"), [(83.2, "1:23"), (3723.0, "1:02:03"), (-4.0, "0:00"), (None, "")])
def test_clock(spark, seconds, shown):
    assert one(spark, X.clock(F.col("x")), seconds, "double") == shown


@pytest.mark.parametrize(("given", "seconds"), [("1:02:03", 3723.0), ("12:30", 750.0), ("1:x", None), (" 5 ", 5.0)])
def test_seconds(spark, given, seconds):
    assert one(spark, X.seconds_of(F.col("x")), given) == seconds


def test_titles(spark):
    assert one(spark, X.titled(F.col("x")), "the theory OF mind via DNA") == "The Theory OF Mind via DNA"
    assert one(spark, X.keyword_title(F.array(F.lit("neural net"), F.lit("net"), F.lit("loss"))), "") == "Neural Net & Loss"


def test_compressed(spark):
    assert one(spark, X.compressed(F.col("x"), 6), "So, basically the cat sat there, which nobody liked at all") == "The cat sat there"
    assert one(spark, X.compressed(F.col("x"), 4), "a b c d e f") == "A b c d…"
    assert one(spark, X.compressed(F.col("x"), 4), "so") == "So"


@pytest.mark.parametrize(
    ("given", "tag"),
    [("energy equals mass", "Formula"), ("for example a cat", "Eg"), ("never do that", "Watch-out"), ("remember this", "Tip"), ("a cat is a pet", "Def"), ("plain words", None)],
)
def test_tags(spark, given, tag):
    assert one(spark, X.line_tag(F.col("x")), given) == tag


def test_candidate_phrases(spark):
    found = one(spark, X.candidate_phrases(F.col("x")), "The theory of mind explains large neural networks quickly.")
    assert "theory of mind" in found and "neural networks" in found
    assert not any(p.startswith("the ") or "explains" in p or p.endswith("quickly") for p in found)


def test_phrase_rows_are_the_same(spark):
    from chronoloom.operators.lexical import phrase_rows

    rows = spark.createDataFrame([(1, "The theory of mind explains large neural networks, a model of the world; of course."), (2, "")], "k int, text string")
    a = sorted(r.y for r in rows.select(F.explode(X.candidate_phrases(F.col("text"))).alias("y")).collect())
    assert a == sorted(r.term for r in phrase_rows(rows, ["k"]).collect()) and a


def test_labels(spark):
    assert one(spark, X.clean_label(F.col("x"), 60, 8), "**Qubits** [1:23] are fun.") == "Qubits are fun"
    assert one(spark, X.clean_label(F.col("x"), 60, 8), "the speaker says hi") is None
    assert one(spark, X.clean_label(F.col("x"), 60, 2), "one two three") is None


def test_tones(spark):
    found = one(spark, X.tones(F.col("x")), "amazing wow! this is wrong")
    assert [r.tone for r in found] == ["enthusiastic", "critical"]


def test_verbs():
    assert {"relies", "relied", "relying", "being", "uses", "using"} <= set(L.VERBS) and "use" not in set(L.VERBS) - {"use"}


def test_language(spark):
    assert one(spark, G.detected(F.col("x"), F.lit(None).cast("string")), "привет мир как дела") == "ru"
    assert one(spark, G.detected(F.col("x"), F.lit("mr")), "नमस्ते दुनिया") == "mr"
    assert one(spark, G.detected(F.col("x"), F.lit("de")), "das ist ein haus") == "de"
    assert one(spark, G.detected(F.col("x"), F.lit("de")), "this is the house that we have") == "en"
    assert one(spark, G.unit_language(F.col("x"), F.lit("hi")), "kya baat hai") == "en"
    assert one(spark, G.normal_code(F.col("x")), "a.PT_br") == "pt"
    assert one(spark, G.main_script(F.col("x")), "こんにちは世界").script == "Jpan"


def test_scripts_are_looked_for_once(spark):
    """A text is searched once for each script, however often its counts are used."""
    rows = spark.createDataFrame([("abc привет",), ("",), (None,), ("漢字かな x",), ("漢字",), ("é 한글 العربية",)], "t string")
    found = rows.select(G.main_script(F.col("t")).alias("f"), G.detected(F.col("t"), F.lit("de")).alias("d"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("IsCyrillic") == 2 and plan.count("IsHan}") == 2  # one for each of the two columns
    assert [(r.f.script, round(r.f.share, 6), r.d) for r in found.collect()] == [
        ("Cyrl", round(6 / 9, 6), "ru"), (None, 0.0, "de"), (None, 0.0, "de"), ("Jpan", 0.8, "ja"), ("Hans", 1.0, "zh"), ("Arab", round(9 / 10, 6), "ar"),
    ]


def test_phrases_are_counted_where_their_text_lies(spark):
    """Only the texts are dealt by document, and not their phrases, which are many times as much."""
    from chronoloom.queries.text import candidate_phrases_topk

    plan = candidate_phrases_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_distinct_in_order_of_a_long_text(spark):
    """A text of 40,000 items: a sort's work is done in seconds, that of all pairs is not."""
    import time

    items = [f"{'W' if k % 3 else 'w'}{k * 7919 % 15000}{' ' * (k % 2)}" for k in range(40_000)] + ["", " "]
    kept = {}
    for x in items:
        if x.strip():
            kept.setdefault(x.strip().lower(), x)
    began = time.time()
    assert one(spark, X.distinct_in_order(F.col("x")), items, "array<string>") == list(kept.values())
    assert time.time() - began < 20
    assert one(spark, X.distinct_in_order(F.col("x")), ["b", None, "A", "B ", "a", "c"], "array<string>") == ["b", "A", "c"]
    assert one(spark, X.distinct_in_order(F.col("x")), None, "array<string>") is None
