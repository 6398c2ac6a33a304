"""Queries of the activity log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import activity as A
from ..sources.tables import table
from . import Registry

registry = Registry()
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.KINDS.items()) + " END"
_SQL = f"""a AS (SELECT user_id % 10 AS room, user_id, event_id AS seq, ts, {_CASE} AS kind, CAST(props::JSON->>'k' AS INTEGER) AS node FROM events),
counted AS (SELECT room, user_id, seq, kind, node FROM a WHERE kind NOT IN ('unknown', 'node_explored')
  UNION ALL SELECT room, user_id, min(seq), 'node_explored', node FROM a WHERE kind = 'node_explored' AND node IS NOT NULL GROUP BY room, user_id, node)"""
_POINTS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in L.POINTS.items()) + " ELSE 0 END"
_SQL_USERS = f"""{_SQL}, users AS (SELECT room, user_id, CAST(sum({_POINTS}) AS BIGINT) AS points,
  {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in L.POINTS if k != 'node_explored')}, count(*) FILTER (kind = 'node_explored') AS explored,
  CAST(max(CASE WHEN kind = 'team' THEN 1 ELSE 0 END) AS INTEGER) AS team FROM counted GROUP BY room, user_id), full_users AS (SELECT *, node_added + node_edited AS built FROM users)"""


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.from_events(table(spark, sf_dir, "events"))


@registry.query(f"WITH {_SQL_USERS} SELECT * FROM full_users")
def activity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.user_counters(_activity(spark, sf_dir))


@registry.query(f"WITH {_SQL_USERS} SELECT room, user_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} >= {max(1, n // 5)} THEN {chr(39)}{b}{chr(39)} END' for b, c, n in A.BADGES)}], lambda x: x IS NOT NULL), ',') AS badges FROM full_users")
def badges_earned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges at a fifth of what they take, so that this log earns some."""
    held = A.user_counters(_activity(spark, sf_dir))
    earned = F.array_compact(F.array(*[F.when(F.col(c) >= max(1, n // 5), F.lit(b)) for b, c, n in A.BADGES]))
    return held.select("room", "user_id", F.array_join(earned, ",").alias("badges"))


@registry.query(f"WITH {_SQL_USERS} SELECT room, CAST(row_number() OVER (PARTITION BY room ORDER BY points DESC, user_id) AS INTEGER) AS rank, user_id, points, explored FROM full_users")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.leaderboard(A.user_counters(_activity(spark, sf_dir)))


@registry.query(f"WITH {_SQL_USERS}, e AS (SELECT room, count(DISTINCT node) AS nodes FROM counted WHERE kind = 'node_explored' GROUP BY room), q AS (SELECT room, CAST(sum(quiz_correct) AS BIGINT) AS quiz FROM full_users GROUP BY room) SELECT room, nodes AS explored_nodes, greatest(1, CAST(floor(100 * 0.75) AS BIGINT)) AS explored_goal, least(quiz, 20) AS quiz, 20 AS quiz_goal FROM e JOIN q USING (room)")
def challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a room has reached together, of maps with a hundred nodes."""
    rows = A.counted(_activity(spark, sf_dir))
    nodes = rows.where("kind = 'node_explored'").groupBy("room").agg(F.countDistinct("node").alias("explored_nodes"))
    quiz = rows.groupBy("room").agg(F.least(F.count_if(F.col("kind") == "quiz_correct"), F.lit(20)).alias("quiz"))
    return nodes.join(quiz, "room").select("room", "explored_nodes", F.lit(75).cast("bigint").alias("explored_goal"), "quiz", F.lit(20).alias("quiz_goal"))


@registry.query(f"WITH {_SQL} SELECT room, user_id, count(DISTINCT node) AS nodes FROM a WHERE kind = 'node_explored' GROUP BY ALL")
def explored_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activity(spark, sf_dir).where("kind = 'node_explored'").groupBy("room", "user_id").agg(F.countDistinct("node").alias("nodes"))


@registry.query(f"WITH {_SQL} SELECT room, user_id, arg_max(node, seq) AS node, max(ts) AS ts FROM a GROUP BY ALL")
def presence_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.presence(_activity(spark, sf_dir))


@registry.query(f"WITH {_SQL} SELECT room, count(DISTINCT user_id) AS users, count(DISTINCT user_id) >= 2 AS team FROM a GROUP BY room")
def team_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _activity(spark, sf_dir).groupBy("room").agg(F.countDistinct("user_id").alias("users"))
    return held.withColumn("team", F.col("users") >= 2)


@registry.query(f"WITH {_SQL}, v AS (SELECT room, seq, row_number() OVER (PARTITION BY room ORDER BY seq) AS version FROM a), k AS (SELECT * FROM v WHERE version % 7 <> 3) SELECT room, seq, version, CAST(greatest(0, version - lag(version) OVER (PARTITION BY room ORDER BY seq) - 1) AS BIGINT) AS missed FROM k")
def version_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A room's log of which every seventh version got lost."""
    v = F.row_number().over(Window.partitionBy("room").orderBy("seq")).cast("bigint")
    log = _activity(spark, sf_dir).select("room", "seq", v.alias("version")).where("version % 7 <> 3")
    return A.version_gaps(log).withColumn("missed", F.coalesce(F.col("missed"), F.lit(0)).cast("bigint"))


@registry.query(f"WITH {_SQL_USERS} SELECT room, user_id, CAST(floor(sqrt(points / 10.0)) + 1 AS BIGINT) AS level, CAST(round((sqrt(points / 10.0) - floor(sqrt(points / 10.0))) * 100) AS BIGINT) AS percent FROM full_users")
def user_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.sqrt(F.col("points") / F.lit(10.0))
    return A.user_counters(_activity(spark, sf_dir)).select("room", "user_id", A.level(F.col("points")).alias("level"), F.round((p - F.floor(p)) * 100).cast("bigint").alias("percent"))


@registry.query(f"WITH {_SQL}, c AS (SELECT user_id, node, least(5, 1 + count(*)) AS box, max(seq) AS seen FROM a GROUP BY ALL), b AS (SELECT unnest([1, 2, 3, 4, 5]) AS box) SELECT CAST(b.box AS BIGINT) AS box, count(node) AS cards, count(*) FILTER (c.box >= 4) AS mastered FROM b LEFT JOIN c ON b.box = c.box GROUP BY b.box")
def leitner_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards in each box, empty boxes too."""
    cards = _activity(spark, sf_dir).groupBy("user_id", "node").agg(F.least(F.lit(5), F.count("*") + 1).cast("bigint").alias("box"))
    sizes = cards.groupBy("box").agg(F.count("node").alias("cards"), F.count_if(F.col("box") >= 4).alias("mastered"))
    return spark.range(1, 6).withColumnRenamed("id", "box").join(sizes, "box", "left").select("box", F.coalesce("cards", F.lit(0)).alias("cards"), F.coalesce("mastered", F.lit(0)).alias("mastered"))


@registry.query(f"WITH {_SQL}, c AS (SELECT user_id, node, least(5, 1 + count(*)) AS box, max(seq) AS seen FROM a WHERE node IS NOT NULL GROUP BY ALL) SELECT user_id, arg_min(node, (box, seen, node)) AS next_card FROM c WHERE box < 5 GROUP BY user_id")
def next_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _activity(spark, sf_dir).where("node IS NOT NULL").groupBy("user_id", "node").agg(F.least(F.lit(5), F.count("*") + 1).alias("box"), F.max("seq").alias("seen"))
    return cards.where("box < 5").groupBy("user_id").agg(F.min_by("node", F.struct("box", "seen", "node")).alias("next_card"))


@registry.query(f"WITH {_SQL} SELECT room, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS events, count(DISTINCT user_id) AS users FROM a GROUP BY ALL")
def activity_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.windows(_activity(spark, sf_dir), "1 day")


@registry.query(f"WITH {_SQL}, k AS (SELECT room, user_id, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM a) SELECT room, start, count(*) AS events, count(DISTINCT user_id) AS users FROM k GROUP BY ALL")
def activity_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.windows(_activity(spark, sf_dir), "1 day", "12 hours")


@registry.query(f"WITH {_SQL}, m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) >= INTERVAL 2 HOUR, true) AS opens FROM a), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS events FROM s GROUP BY user_id, n")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sessions(_activity(spark, sf_dir), "2 hours")


@registry.query(f"WITH {_SQL} SELECT seq, CASE WHEN kind = 'quiz_correct' THEN 'node_added' WHEN kind = 'node_edited' AND node % 3 = 0 THEN 'note_added' WHEN kind = 'node_edited' AND node % 3 = 1 THEN 'link_added' ELSE 'node_edited' END AS counts_as FROM a")
def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What edits count as; the log's kinds stand in for edits."""
    op = F.when(F.col("kind") == "quiz_correct", "add").when(F.col("kind") == "node_edited", "update").otherwise("move")
    keys = F.when(F.col("node") % 3 == 0, F.array(F.lit("notes"))).when(F.col("node") % 3 == 1, F.array(F.lit("links"))).otherwise(F.array(F.lit("text")))
    return _activity(spark, sf_dir).select("seq", A.edit_kind(op, keys).alias("counts_as"))


@registry.query(f"WITH {_SQL} SELECT room, seq, CAST(max(node % 100) OVER (PARTITION BY room ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS progress FROM a")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress as it is reported never goes back."""
    w = Window.partitionBy("room").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return _activity(spark, sf_dir).select("room", "seq", F.max(F.col("node") % 100).over(w).alias("progress"))


@registry.query(
    """WITH RECURSIVE p AS MATERIALIZED (SELECT user_id % 20 AS room, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5 END AS base, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events),
r AS (SELECT room, seq, k, base IS NULL OR base = 0 AS accepted, CASE WHEN base IS NULL OR base = 0 THEN 1 ELSE 0 END AS version FROM p WHERE k = 1
  UNION ALL SELECT p.room, p.seq, p.k, p.base IS NULL OR p.base = r.version, CASE WHEN p.base IS NULL OR p.base = r.version THEN r.version + 1 ELSE r.version END FROM r JOIN p ON p.room = r.room AND p.k = r.k + 1)
SELECT CAST(room AS BIGINT) AS room, CAST(seq AS BIGINT) AS seq, accepted, CAST(version AS INTEGER) AS version FROM r"""
)
def room_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole maps that are offered for a room on the base of a version: taken if nobody was quicker, or by force."""
    events = table(spark, sf_dir, "events")
    base = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5)
    offers = events.select((F.col("user_id") % 20).cast("bigint").alias("room"), F.col("event_id").cast("bigint").alias("seq"), base.cast("int").alias("base"))
    return A.replacements(offers).select("room", "seq", "accepted", "version")
