"""Rooms as state against a replay of all messages in order."""

import random

from pyspark.sql import functions as F

from chronoloom.functions.lexicon import POINTS
from chronoloom.operators import tree
from chronoloom.sources.trees import nodes
from chronoloom.streaming import rooms as R

from .conftest import SMALL


def made(rng, count):
    """Messages of three rooms, numbered, with edits that apply and others that don't."""
    rows = []
    for room in range(3):
        known = [f"n{k}" for k in range(25)]
        for seq in range(1, count + 1):
            kind = rng.choice(["op", "op", "op", "presence", "event", "hello"])
            ops = []
            for k in range(rng.randint(1, 3) if kind == "op" else 0):
                op = rng.choice(["add", "update", "remove", "move"])
                node = f"x{room}.{seq}.{k}" if op == "add" else rng.choice(known)
                known += [node] if op == "add" else []
                ops.append((op, node, rng.choice(known), rng.randint(0, 4), f"text {seq}", "concept"))
            node = rng.choice(["node_explored:a", "node_explored:b", "quiz_correct:", "other:"]) if kind == "event" else rng.choice(["n1", "n2"]) if kind in ("presence", "hello") else None
            rows.append((room, seq, rng.randint(1, 4), 1_700_000_000 + 5 * seq, kind, node, ops))
        rows.append((room, count + 1, 1, 1_700_000_000 + 5 * count + 5, "sync", None, []))
    return rows


def frame(spark, rows):
    held = spark.createDataFrame(rows, R.MESSAGES.replace("ts timestamp", "ts long"))
    return held.withColumn("ts", F.timestamp_seconds("ts")).select("room", "seq", "user_id", "ts", "type", "node", "ops")


def run(spark, folder, batches, begin, name):
    """A batch of files at a time; the query is stopped and begun anew between them."""
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(R.MESSAGES).parquet(f"{folder}/in")
        found = R.rooms(stream, begin, idle=60, late="1000 seconds")
        q = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        assert q.exception() is None
    return spark.read.parquet(f"{folder}/out").collect()


def test_rooms_against_a_replay(spark, tmp_path):
    rng = random.Random(8)
    rows = made(rng, 40)
    begin = nodes(spark, SMALL, 2).withColumnRenamed("map_id", "room").withColumn("room", F.col("room").cast("long")).where("room < 3")
    ahead = rows[:]
    rng.shuffle(ahead)
    repeated = ahead[:10]
    batches = [ahead[:50], repeated + ahead[50:90], ahead[90:]]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = run(spark, str(tmp_path), batches, begin, "a")
        late = [(room, 42, 9, 1_700_002_000, "presence", "n1", []) for room in range(3)]
        later = [(room, 43, 9, 1_700_004_000, "presence", "n1", []) for room in range(3)]
        after = run(spark, str(tmp_path), [late, later], begin, "a")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    own = {r: tree.Document.of([x for x in begin.collect() if x.room == r], []) for r in range(3)}
    want_ops, points, explored, here = [], {}, {}, {}
    for room, seq, user, _, kind, node, ops in sorted(rows, key=lambda r: (r[0], r[1])):
        version = sum(1 for x in {(o[0], o[1]) for o in want_ops} if x[0] == room)
        done = [o for o in (dict(zip(("type", "id", "parent_id", "index", "text", "node_type"), op, strict=True)) for op in ops) if own[room].apply(o) is not None]
        want_ops += [(room, seq, version + 1, o["id"], k) for k, o in enumerate(done)]
        for o in done:
            points[room, user] = points.get((room, user), 0) + POINTS["node_added" if o["type"] == "add" else "node_edited"]
    assert sorted((r.room, r.seq, r.version, r.node, r.ord) for r in got if r.what == "op") == sorted(want_ops)
    for room in range(3):
        place = {k: j for ids in own[room].kids.values() for j, k in enumerate(ids)}
        want = sorted((k, n["parent"], n["text"], place.get(k, 0)) for k, n in own[room].nodes.items())
        assert sorted((r.node, r.parent_id, r.text, r.ord) for r in got if r.what == "node" and r.room == room) == want
    assert {(r.room, r.user_id) for r in got if r.what == "badge" and r.node == "first-steps"} >= set(points)
    left = {(r.room, r.user_id) for r in after if r.what == "presence" and r.text == "left"}
    been = {(r.room, r.user_id) for r in got if r.what == "presence"}
    assert left == been  # user 9 was heard of again in time
