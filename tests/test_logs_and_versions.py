"""The message log as a source, and versioned tables under racing writers."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from chronoloom.operators.merge import merge_maps
from chronoloom.sources.message_log import MessageLog
from chronoloom.sources.versioned import COMPACT, Versioned

MAP = "map_id long, node_id string, parent_id string, ord long, type string, text string"


def logs(folder, files, n):
    (folder / "in").mkdir(exist_ok=True)
    for k in range(files):
        with (folder / "in" / f"log-{k}.ndjson").open("a") as f:
            f.writelines(json.dumps({"file": k, "n": i, "pad": "é" * (i % 50)}, ensure_ascii=False) + "\n" for i in range(n))


@pytest.mark.parametrize("split", ["100", "1k", "64m"])
def test_batches(spark, tmp_path, split):
    spark.dataSource.register(MessageLog)
    logs(tmp_path, 2, 300)
    (tmp_path / "in" / "last").write_text("no line end")
    (tmp_path / "in" / "none").write_text("")
    (tmp_path / "in" / "_hidden").write_text("not read\n")
    rows = spark.read.format("message_log").option("splitBytes", split).load(str(tmp_path / "in"))
    want = [line for k in range(2) for line in (tmp_path / "in" / f"log-{k}.ndjson").read_text().splitlines()] + ["no line end"]
    assert sorted(r.value for r in rows.collect()) == sorted(want)
    assert rows.select("file", "at").distinct().count() == len(want)


def test_stream_is_stopped_and_goes_on(spark, tmp_path):
    """A batch fails in mid-stream, files grow meanwhile, half a line waits: every line is read once."""
    spark.dataSource.register(MessageLog)
    logs(tmp_path, 3, 200)
    sizes, failed = [], []

    def keep(batch, number):
        rows = batch.collect()
        sizes.append(len(rows))
        if number == 2 and not failed:
            failed.append([r.value for r in rows])
            raise RuntimeError("lost")
        if failed and number == 2:
            assert sorted(r.value for r in rows) == sorted(failed[0])  # the same lines again
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    def start():
        stream = spark.readStream.format("message_log").option("maxBytesPerTrigger", "4k").option("splitBytes", "1k").load(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").start()

    q = start()
    with pytest.raises(Exception, match="lost"):
        q.processAllAvailable()
    logs(tmp_path, 4, 50)
    with (tmp_path / "in" / "log-0.ndjson").open("a") as f:
        f.write('{"half":')
    q = start()
    q.processAllAvailable()
    with (tmp_path / "in" / "log-0.ndjson").open("a") as f:
        f.write(" 1}\n")
    q.processAllAvailable()
    q.stop()
    got = [r.value for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    want = [line for k in range(4) for line in (tmp_path / "in" / f"log-{k}.ndjson").read_text().splitlines()]
    assert sorted(got) == sorted(want) and '{"half": 1}' in got
    assert len(sizes) > 5 and max(sizes) < 120


def a_map(spark, rows):
    return spark.createDataFrame(rows, MAP)


def bases(spark, *rows):
    return spark.createDataFrame(list(rows), "map_id long, base long")


def test_replace_and_conflict(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "maps"), "map_id", MAP)
    assert t.read().count() == 0
    first = a_map(spark, [(1, "r", None, 0, "root", "one"), (2, "r", None, 0, "root", "two")])
    assert sorted(map(tuple, t.replace(first, bases(spark, (1, 0), (2, None))).collect())) == [(1, True, 1), (2, True, 1)]
    second = a_map(spark, [(1, "r", None, 0, "root", "one again"), (2, "r", None, 0, "root", "stale")])
    assert sorted(map(tuple, t.replace(second, bases(spark, (1, 1), (2, 0))).collect())) == [(1, True, 2), (2, False, 1)]
    assert {(r.map_id, r.text) for r in t.read().collect()} == {(1, "one again"), (2, "two")}
    forced = t.replace(a_map(spark, [(2, "r", None, 0, "root", "forced")]), bases(spark, (2, None))).first()
    assert (forced.accepted, forced.version) == (True, 2)


def test_racing_writers(spark, tmp_path):
    """Both judge the same manifest; the second one to put its own in place judges again and learns of the conflict."""
    place = str(tmp_path / "maps")
    Versioned(spark, place, "map_id", MAP).replace(a_map(spark, [(1, "r", None, 0, "root", "start"), (2, "r", None, 0, "root", "start")]), bases(spark, (1, 0), (2, 0)))
    both, results = threading.Barrier(2), {}

    class Racing(Versioned):
        def _put(self, made):
            if not getattr(self, "met", False):
                self.met = True
                both.wait(120)
            return super()._put(made)

    def write(name, keys):
        t = Racing(spark, place, "map_id", MAP)
        rows = a_map(spark, [(k, "r", None, 0, "root", name) for k in keys])
        results[name] = {r.map_id: (r.accepted, r.version) for r in t.replace(rows, bases(spark, *[(k, 1) for k in keys])).collect()}

    threads = [threading.Thread(target=write, args=a) for a in (("a", [1]), ("b", [1, 2]))]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted([results["a"][1], results["b"][1]]) == [(False, 2), (True, 2)] and results["b"][2] == (True, 2)
    winner = next(n for n in results if results[n][1][0])
    assert {(r.map_id, r.text) for r in Versioned(spark, place, "map_id", MAP).read().collect()} == {(1, winner), (2, "b")}


def test_merge_on_top_and_compaction(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "maps"), "map_id", MAP)
    t.replace(a_map(spark, [(1, "r", None, 0, "root", "Map"), (1, "a", "r", 0, "section", "Alpha")]), bases(spark, (1, 0)))
    other = a_map(spark, [(1, "q", None, 0, "root", "Map"), (1, "x", "q", 0, "section", "alpha!"), (1, "y", "q", 1, "section", "Beta")])
    done = t.merge(other, merge_maps).first()
    assert (done.accepted, done.version) == (True, 2)
    assert {(r.node_id, r.parent_id, r.text) for r in t.read().collect()} == {("r", None, "Map"), ("a", "r", "Alpha"), ("y", "r", "Beta")}
    for k in range(COMPACT):
        t.replace(a_map(spark, [(2, "r", None, 0, "root", f"v{k}")]), bases(spark, (2, k)))
    held = t.manifest()
    assert held.number == COMPACT + 2 and len(held.folders) < 5
    assert {(r.map_id, r.version) for r in t.versions().collect()} == {(1, 2), (2, COMPACT)}
    assert t.read().where(F.col("map_id") == 2).first().text == f"v{COMPACT - 1}" and t.read().where("map_id = 1").count() == 3
