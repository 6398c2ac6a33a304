import glob
import os
import tempfile
import uuid

import pytest

from chronoloom.operators.rounds import Rounds


def test_stopped_and_resumed(spark):
    """A provider that fails in the third round; then the rest is done, nothing of the first rounds again."""
    calls, folder = tempfile.mkdtemp(), tempfile.mkdtemp()

    def seen():
        return sorted(line for f in glob.glob(f"{calls}/*") for line in open(f).read().splitlines())

    def provider(fails):
        def run(texts, lang):
            if any(t in fails for t in texts):
                raise ValueError("down")
            with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(texts))
            return [t.upper() for t in texts]

        return run

    rows = [("a", k, f"a{k}", "de") for k in range(10)] + [("b", k, f"b{k}", "en" if k < 4 else "fr") for k in range(6)] + [("c", 0, " ", None), ("c", 1, "x", None), (None, 0, "n", "de")]
    task = Rounds(spark, f"{folder}/task")
    task.plan(spark.createDataFrame(rows, "video_id string, pos int, text string, lang string"), size=3)
    assert {(r.video_id, r.pos): r.round for r in task.planned().collect() if r.video_id == "a"} == {("a", p): k // 3 for k, p in enumerate([0, 8, 4, 2, 6, 1, 3, 5, 7, 9])}
    with pytest.raises(Exception, match="down"):
        task.advance(provider({"a3"}))
    assert seen().count("a0") == 1 and len(task.units().collect()) == 6 + 4 + 2 + 2  # two rounds of a, all of b and c
    assert {r.video_id: round(r.coverage, 2) for r in task.coverage().collect()} == {"a": 0.6, "b": 1.0, "c": 1.0}
    again = Rounds(spark, f"{folder}/task")
    again.plan(spark.createDataFrame(rows[:1], "video_id string, pos int, text string, lang string"))  # the plan is there
    assert again.advance(provider(set()), least=0.6) == 0
    assert again.advance(provider(set()), least=0.8) == 1 and again.advance(provider(set())) == 1 and again.advance(provider(set())) == 0
    assert seen() == sorted(t for v, k, t, lang in rows if v and lang != "en" and t.strip())
    assert {(r.video_id, r.pos): r.translated for r in again.units().collect()} == {(v, k): t.upper() if lang != "en" else t for v, k, t, lang in rows if v}


def test_nothing_to_do(spark):
    task = Rounds(spark, f"{tempfile.mkdtemp()}/task")
    task.plan(spark.createDataFrame([("a", 0, "x", "en")], "video_id string, pos int, text string, lang string"))
    assert task.advance(None) == 0 and [r.translated for r in task.units().collect()] == ["x"]
