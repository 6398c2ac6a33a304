"""Queries of trees, their exports and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import tree as T
from ..sources.tables import table
from ..sources.trees import SQL_NODES, nodes
from . import Registry

registry = Registry()

_SQL_WALK = f"""{SQL_NODES}, walked AS (
  SELECT *, 0 AS depth, lpad(CAST(ord AS VARCHAR), 12, '0') AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.*, w.depth + 1, w.path || '/' || lpad(CAST(n.ord AS VARCHAR), 12, '0') FROM walked w JOIN nodes n ON n.map_id = w.map_id AND n.parent_id = w.node_id
)"""


@registry.query(f"WITH RECURSIVE {_SQL_WALK} SELECT map_id, node_id, parent_id, type, depth, path FROM walked")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = nodes(spark, sf_dir).select("map_id", "node_id", "parent_id", "ord", "type")
    return T.walk(kept, written=False).select("map_id", "node_id", "parent_id", "type", "depth", "path")


@registry.query("SELECT o_orderkey, r_name || ' > ' || n_name || ' > ' || c_name || ': ' || c_mktsegment || ' > Tip: ' || o_orderpriority AS trail FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names from the root to each order."""
    n = nodes(spark, sf_dir, 4)
    up = T.ancestors(n).where(F.col("node_id").startswith("o"))
    named = up.join(n.select("map_id", F.col("node_id").alias("ancestor_id"), "text"), ["map_id", "ancestor_id"])
    trail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), "text"))), lambda x: x["text"]), " > ")
    return named.groupBy("node_id").agg(trail.alias("trail")).select(F.substring("node_id", 2, 20).cast("bigint").alias("o_orderkey"), "trail")


@registry.query(f"WITH RECURSIVE {_SQL_WALK} SELECT map_id, path, repeat('  ', depth) || '- [' || node_id || '] ' || trim(text, '“”\" ') AS line FROM walked WHERE type <> 'transcript' AND depth <= 3")
def tree_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.outline(T.walk(nodes(spark, sf_dir, 4)), 3)


@registry.query(f"WITH {SQL_NODES} SELECT map_id, type, count(*) AS n FROM nodes GROUP BY ALL")
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("map_id", "type").agg(F.count("*").alias("n"))


_SQL_ORDERS = _SQL_WALK.replace("nodes AS (", "all_nodes AS (", 1).replace(", walked AS (", ", nodes AS (SELECT * FROM all_nodes WHERE type <> 'transcript'), walked AS (", 1)
_SQL_LEAVES = f"""{_SQL_ORDERS}, leaf AS (SELECT w.map_id, w.path FROM walked w ANTI JOIN (SELECT DISTINCT map_id, parent_id FROM nodes) p ON p.map_id = w.map_id AND p.parent_id = w.node_id),
prefixes AS (SELECT map_id, list_transform(range(1, len(string_split(path, '/')) + 1), lambda k: array_to_string(string_split(path, '/')[1:k], '/')) AS ps FROM leaf),
leaves AS (SELECT w.map_id, w.node_id, w.parent_id, w.ord, w.depth, count(*) AS leaves FROM (SELECT map_id, unnest(ps) AS path FROM prefixes) q JOIN walked w USING (map_id, path) GROUP BY ALL)"""


@registry.query(f"WITH RECURSIVE {_SQL_LEAVES} SELECT map_id, node_id, leaves FROM leaves")
def leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves below every node down to the orders (the ids of lines repeat in this table)."""
    return T.leaf_counts(nodes(spark, sf_dir, 4))


@registry.query(
    f"""WITH RECURSIVE {_SQL_LEAVES}, s AS (SELECT map_id, node_id, ord, abs(2 * sum(leaves) OVER (PARTITION BY map_id ORDER BY ord) - sum(leaves) OVER (PARTITION BY map_id)) AS off FROM leaves WHERE depth = 1)
SELECT map_id, node_id, CASE WHEN ord <= (SELECT arg_min(ord, (off, ord)) FROM s t WHERE t.map_id = s.map_id) THEN 'right' ELSE 'left' END AS side FROM s"""
)
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir, 4)
    sections = n.where("type = 'section'").select("map_id", "node_id", "ord")
    return T.balanced_split(sections.join(T.leaf_counts(n), ["map_id", "node_id"]))


_ACROSS, _DOWN = [0.0, 90.0, 60.0, 40.0], [0.0, 28.0, 14.0, 6.0]


def _sql_layout(deepest: int) -> str:
    """The same by recursion downwards for depths, a step a level upwards, and a step a level downwards."""
    steps = [f"""{SQL_NODES}, boxes AS (SELECT map_id, node_id, parent_id, ord, CAST(20 + 6 * least(length(text), 24) AS DOUBLE) AS w, CAST(CASE WHEN length(text) > 24 THEN 44 ELSE 24 END AS DOUBLE) AS h
  FROM nodes WHERE type <> 'transcript'), deep AS (SELECT *, 0 AS depth FROM boxes WHERE parent_id IS NULL
  UNION ALL SELECT b.*, d.depth + 1 FROM boxes b JOIN deep d ON b.map_id = d.map_id AND b.parent_id = d.node_id)"""]
    for k in range(deepest, -1, -1):
        stack = f"(SELECT map_id, parent_id, sum(extent) + {_DOWN[min(k + 1, 3)]} * (count(*) - 1) AS stack FROM e{k + 1} GROUP BY ALL)" if k < deepest else "(SELECT NULL::INT AS map_id, NULL AS parent_id, 0.0 AS stack)"
        steps.append(f"e{k} AS (SELECT d.*, coalesce(s.stack, 0)::DOUBLE AS stack, greatest(h, coalesce(s.stack, 0))::DOUBLE AS extent FROM deep d LEFT JOIN {stack} s ON s.map_id = d.map_id AND s.parent_id = d.node_id WHERE depth = {k})")
    steps.append("p0 AS (SELECT *, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM e0)")
    for k in range(1, deepest + 1):
        before = f"coalesce(sum(e.extent + {_DOWN[k]}) OVER (PARTITION BY e.map_id, e.parent_id ORDER BY e.ord, e.node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        steps.append(f"p{k} AS (SELECT e.*, (p.x + p.w / 2 + {_ACROSS[k]} + e.w / 2)::DOUBLE AS x, (p.y - p.stack / 2 + {before} + e.extent / 2)::DOUBLE AS y FROM e{k} e JOIN p{k - 1} p ON p.map_id = e.map_id AND p.node_id = e.parent_id)")
    return "WITH RECURSIVE " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT map_id, node_id, depth, extent, x, y FROM p{k}" for k in range(deepest + 1))


@registry.query(_sql_layout(3))
def layout_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every node's box stands, in a tree that grows to the right; a box is as large as its text asks for."""
    n = nodes(spark, sf_dir, 4)
    size = F.length("text")
    boxes = n.withColumn("w", 20 + 6 * F.least(size, F.lit(24))).withColumn("h", F.when(size > 24, 44).otherwise(24))
    return T.layout(boxes, _ACROSS, _DOWN)


_GONE = "type IN ('section', 'concept') AND ord % 7 = 3"


@registry.query(f"WITH RECURSIVE {SQL_NODES}, gone AS (SELECT map_id, node_id FROM nodes WHERE {_GONE} UNION SELECT n.map_id, n.node_id FROM nodes n JOIN gone g ON n.map_id = g.map_id AND n.parent_id = g.node_id) SELECT map_id, node_id, type FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.map_id = n.map_id AND g.node_id = n.node_id)")
def subtree_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = nodes(spark, sf_dir).withColumn("gone", F.expr(_GONE)).select("map_id", "node_id", "parent_id", "type", "gone")
    return T.without_subtrees(kept, F.col("gone")).select("map_id", "node_id", "type")


@registry.query(
    f"""WITH RECURSIVE {SQL_NODES}, seen AS (SELECT map_id, node_id, type, value < 0 AS folded FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.map_id, n.node_id, n.type, n.value < 0 FROM seen s JOIN nodes n ON n.map_id = s.map_id AND n.parent_id = s.node_id AND NOT s.folded AND n.type <> 'transcript')
SELECT map_id, node_id, type FROM seen"""
)
def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are not below a folded one, without transcripts."""
    n = nodes(spark, sf_dir, 4)
    folded = n.where("value < 0").select("map_id", F.col("node_id").alias("ancestor_id"))
    hidden = T.ancestors(n).where("up > 0").join(folded, ["map_id", "ancestor_id"], "left_semi").select("map_id", "node_id").distinct()
    return n.join(hidden, ["map_id", "node_id"], "left_anti").select("map_id", "node_id", "type")


@registry.query(f"WITH {SQL_NODES} SELECT map_id, node_id, CAST(row_number() OVER w AS INTEGER) AS number, coalesce(lead(node_id) OVER w, first_value(node_id) OVER w) AS next, coalesce(lag(node_id) OVER w, last_value(node_id) OVER (PARTITION BY map_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous FROM nodes WHERE type = 'section' WINDOW w AS (PARTITION BY map_id ORDER BY ord)")
def section_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers, and the sections before and after, going round at the ends."""
    w = Window.partitionBy("map_id").orderBy("ord")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes(spark, sf_dir, 2).where("type = 'section'").select(
        "map_id", "node_id", F.row_number().over(w).alias("number"),
        F.coalesce(F.lead("node_id").over(w), F.first("node_id").over(all_)).alias("next"), F.coalesce(F.lag("node_id").over(w), F.last("node_id").over(all_)).alias("previous"),
    )


_SQL_CUST = _SQL_WALK.replace("nodes AS (", "all_nodes AS (", 1).replace(", walked AS (", ", nodes AS (SELECT * FROM all_nodes WHERE type IN ('root', 'section', 'concept')), walked AS (", 1)


@registry.query(
    f"""WITH RECURSIVE {_SQL_CUST}, s AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY ord) AS n FROM walked WHERE type = 'section'),
t AS (SELECT map_id, parent_id, trim(split_part(text, ':', 1)) AS term, row_number() OVER (PARTITION BY map_id, parent_id ORDER BY ord) AS r FROM walked WHERE type = 'concept')
SELECT map_id, path, 0 AS line_no, '# ' || text AS line FROM walked WHERE type = 'root' UNION ALL SELECT map_id, path, 0, '## ' || n || '. ' || text FROM s
UNION ALL SELECT s.map_id, path, 1, 'Key terms: ' || string_agg(term, ' · ' ORDER BY r) FROM s JOIN t ON s.map_id = t.map_id AND s.node_id = t.parent_id AND r <= 5 GROUP BY s.map_id, path
UNION ALL SELECT map_id, path, 0, '- **' || trim(split_part(text, ':', 1)) || '**: ' || trim(substring(text, instr(text, ':') + 1)) FROM walked WHERE type = 'concept'"""
)
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.markdown(T.walk(nodes(spark, sf_dir, 3)))


@registry.query(
    f"""WITH RECURSIVE {_SQL_CUST} SELECT map_id, path || '!' AS place, repeat(' ', depth) || '<outline text="' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' AS line FROM walked
UNION ALL SELECT map_id, path || '~', repeat(' ', depth) || '</outline>' FROM walked"""
)
def opml_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.opml(T.walk(nodes(spark, sf_dir, 3)))


@registry.query(f"WITH {SQL_NODES} SELECT r.map_id, r.text AS title, count(*) AS children, string_agg('[[' || n.text || ']]', ', ' ORDER BY n.ord) AS strings FROM nodes r JOIN nodes n ON n.parent_id = r.node_id AND n.map_id = r.map_id WHERE r.type = 'root' GROUP BY r.map_id, r.text")
def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each map with its sections as references."""
    n = nodes(spark, sf_dir, 2)
    kids = n.where("type = 'section'").groupBy("map_id").agg(F.count("*").alias("children"), F.expr("listagg('[[' || text || ']]', ', ') WITHIN GROUP (ORDER BY ord)").alias("strings"))
    return n.where("type = 'root'").select("map_id", F.col("text").alias("title")).join(kids, "map_id")


@registry.query(
    f"""WITH {SQL_NODES}, k AS (SELECT map_id, string_agg('{{"string":"[[' || text || ']]"}}', ',' ORDER BY ord) AS kids FROM nodes WHERE type = 'section' GROUP BY map_id)
SELECT map_id, '{{"title":"' || text || '","children":[' || kids || ']}}' AS json FROM nodes JOIN k USING (map_id) WHERE type = 'root'"""
)
def nested_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as nested JSON, gathered from the sections up."""
    n = nodes(spark, sf_dir, 2)
    kids = n.where("type = 'section'").groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("[["), "text", F.lit("]]")).alias("string")))), lambda x: F.struct(x["string"].alias("string"))).alias("children"))
    return n.where("type = 'root'").join(kids, "map_id").select("map_id", F.to_json(F.struct(F.col("text").alias("title"), "children")).alias("json"))


@registry.query(f"WITH RECURSIVE {_SQL_CUST}, f AS (SELECT *, CASE WHEN depth >= 2 THEN repeat('→ ', depth - 1) ELSE '' END || text AS line FROM walked), n AS (SELECT map_id, parent_id, node_id, line, row_number() OVER (PARTITION BY map_id, coalesce(parent_id, '') ORDER BY ord) - 1 AS r FROM f) SELECT map_id, node_id, line, CAST(r // 100 AS BIGINT) AS batch FROM n")
def flattened_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children in batches of a hundred, deeper levels behind arrows."""
    walked = T.walk(nodes(spark, sf_dir, 3))
    line = F.concat(F.when(F.col("depth") >= 2, F.repeat(F.lit("→ "), F.col("depth") - 1)).otherwise(F.lit("")), "text")
    r = F.row_number().over(Window.partitionBy("map_id", F.coalesce("parent_id", F.lit(""))).orderBy("ord")) - 1
    return walked.select("map_id", "node_id", line.alias("line"), F.floor(r / 100).alias("batch"))


@registry.query(f"WITH {SQL_NODES} SELECT map_id, '{{\"id\":\"' || node_id || '\",\"type\":\"' || type || '\"}}' AS json FROM nodes")
def ndjson_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("map_id", F.to_json(F.struct(F.col("node_id").alias("id"), "type")).alias("json"))


@registry.query()
def op_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and customers after a log of edits made from the events."""
    kind = F.element_at(F.array(*map(F.lit, ["add", "update", "remove", "move"])), (F.col("event_id") % 4 + 1).cast("int"))
    ops = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("int").alias("map_id"), F.col("event_id").alias("seq"), kind.alias("type"),
        F.when(kind == "add", F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("c"), (F.col("event_id") % 1500).cast("string"))).alias("id"),
        F.concat(F.lit("n"), (F.col("event_id") % 25).cast("string")).alias("parent_id"), (F.col("event_id") % 9).cast("int").alias("index"), F.col("event_type").alias("text"),
    )
    return T.apply_ops(nodes(spark, sf_dir, 3), ops)


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["add", "update", "remove", "undo", "move", "redo"])), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("int").alias("map_id"), F.col("event_id").alias("seq"), kind.alias("type"),
        F.when(kind == "add", F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("c"), (F.col("event_id") % 1500).cast("string"))).alias("id"),
        F.concat(F.lit("n"), (F.col("event_id") % 25).cast("string")).alias("parent_id"), (F.col("event_id") % 9).cast("int").alias("index"), F.col("event_type").alias("text"),
    )


@registry.query()
def op_log_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What takes back each edit of a log, with undo and redo among them."""
    return T.inverses(nodes(spark, sf_dir, 3), _edits(spark, sf_dir))


@registry.query(f"WITH {SQL_NODES} SELECT map_id, node_id, coalesce(CASE WHEN ord % 3 = 0 THEN NULL ELSE text END, '') AS text, coalesce(CASE WHEN ord % 4 = 0 THEN NULL ELSE type END, 'concept') AS type, '' AS notes, false AS collapsed FROM nodes")
def normalized_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in which some texts and types are missing, with defaults."""
    n = nodes(spark, sf_dir).withColumn("text", F.when(F.col("ord") % 3 != 0, F.col("text"))).withColumn("type", F.when(F.col("ord") % 4 != 0, F.col("type")))
    return T.normalized(n).select("map_id", "node_id", "text", "type", "notes", "collapsed")


@registry.query(f"WITH {SQL_NODES} SELECT map_id, node_id, parent_id, type, text FROM nodes WHERE type <> 'transcript'")
def slim_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.slim(nodes(spark, sf_dir).withColumn("notes", F.lit("long"))).select("map_id", "node_id", "parent_id", "type", "text")


_SQL_TRADE = """trade AS (SELECT least(cn.n_nationkey, s_nationkey) AS a, greatest(cn.n_nationkey, s_nationkey) AS b, CAST(count(*) AS DOUBLE) AS weight FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count("*").cast("double").alias("weight"))


def _sql_rank(rounds: int) -> str:
    steps = [f"WITH {_SQL_TRADE}, ends AS (SELECT a, b, weight FROM trade UNION ALL SELECT b, a, weight FROM trade WHERE a <> b), shares AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS share FROM ends), n AS (SELECT count(DISTINCT a) AS n FROM ends), r0 AS (SELECT DISTINCT a AS v, 1.0 / n AS rank FROM ends, n)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS (SELECT b AS v, 0.15 / any_value(n) + 0.85 * sum(share * rank) AS rank FROM shares JOIN r{k - 1} ON a = v, n GROUP BY b)")
    return ", ".join(steps) + f" SELECT v, round(rank, 6) AS rank FROM r{rounds}"


@registry.query(_sql_rank(20))
def pagerank_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(_trade(spark, sf_dir), 20).select("v", F.round("rank", 6).alias("rank"))


@registry.query()
def nation_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.modular_communities(_trade(spark, sf_dir))
