"""Streams give what the batch operators give on the same rows."""

from pyspark.sql import functions as F

from chronoloom.operators import activity as A
from chronoloom.sources.tables import table
from chronoloom.streaming import activity as S

from .conftest import SMALL


def events_in_files(spark, folder, n=3):
    rows = table(spark, SMALL, "events")
    for k in range(n):
        rows.where(F.col("event_id") % n == k).coalesce(1).write.mode("append").parquet(folder)


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_counters(spark, tmp_path):
    events_in_files(spark, f"{tmp_path}/in")
    activity = A.from_events(S.read_events(spark, f"{tmp_path}/in"))
    drained(S.running_counters(activity), "counters", "update")
    last = spark.table("counters").groupBy("room", "user_id").agg(F.max_by("points", "version").alias("points"), F.max_by("explored", "version").alias("explored"))
    batch = A.user_counters(A.from_events(table(spark, SMALL, "events"))).where("points > 0")
    a = {(r.room, r.user_id): (r.points, r.explored) for r in last.collect()}
    assert a == {(r.room, r.user_id): (r.points, r.explored) for r in batch.collect()}


def test_first_visits(spark, tmp_path):
    events_in_files(spark, f"{tmp_path}/in", 1)
    batch = A.from_events(table(spark, SMALL, "events")).where("kind = 'node_explored'").select("room", "user_id", "node").distinct()
    for late in ("400 days", None):
        drained(S.first_visits(A.from_events(S.read_events(spark, f"{tmp_path}/in")), late), "visits", "append")
        assert spark.table("visits").count() == batch.count()


def test_windows_close(spark, tmp_path):
    events_in_files(spark, f"{tmp_path}/in", 1)
    drained(S.windowed(A.from_events(S.read_events(spark, f"{tmp_path}/in")), "1 day", "1 hour"), "days", "append")
    got = {(r.room, str(r.start)): r.events for r in spark.table("days").collect()}
    want = {(r.room, str(r.start)): r.events for r in A.windows(A.from_events(table(spark, SMALL, "events")), "1 day").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_upsert(spark, tmp_path):
    events_in_files(spark, f"{tmp_path}/in")
    stream = A.from_events(S.read_events(spark, f"{tmp_path}/in")).select("room", "user_id", "seq", "node")
    q = S.into_table(stream, f"{tmp_path}/table", f"{tmp_path}/check", ["room", "user_id"], "seq")
    q.awaitTermination()
    keys = ["room", "user_id"]
    held = {(r.room, r.user_id): r.node for r in S.current(spark, f"{tmp_path}/table", keys, "seq").collect()}
    S.compact(spark, f"{tmp_path}/table", f"{tmp_path}/small", keys, "seq")
    assert held == {(r.room, r.user_id): r.node for r in S.current(spark, f"{tmp_path}/small", keys, "seq").collect()}
    want = {(r.room, r.user_id): r.node for r in A.presence(A.from_events(table(spark, SMALL, "events"))).collect()}
    assert held == want
