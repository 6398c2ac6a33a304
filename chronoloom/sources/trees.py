"""A forest from the star schema: region, nation, customer, order, line. Every region is a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

TYPES = ["root", "section", "concept", "detail", "transcript"]


def nodes(spark: SparkSession, sf_dir: str, levels: int = 5) -> DataFrame:
    """nodes(map_id, node_id, parent_id, ord, type, text, value) of the first levels."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

    def level(rows, k, node, parent, order, text, value):
        return rows.select(
            F.col("n_regionkey" if k else "r_regionkey").alias("map_id"), node.alias("node_id"), parent.alias("parent_id"), F.col(order).cast("bigint").alias("ord"),
            F.lit(TYPES[k]).alias("type"), text.alias("text"), value.cast("double").alias("value"),
        )

    nation = t("nation")
    home = nation.select("n_nationkey", "n_regionkey")
    customer = t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    out = [
        level(t("region"), 0, key("r", "r_regionkey"), F.lit(None).cast("string"), "r_regionkey", F.col("r_name"), F.lit(0.0)),
        level(nation, 1, key("n", "n_nationkey"), key("r", "n_regionkey"), "n_nationkey", F.col("n_name"), F.lit(0.0)),
        level(customer, 2, key("c", "c_custkey"), key("n", "c_nationkey"), "c_custkey", F.concat("c_name", F.lit(": "), "c_mktsegment"), F.col("c_acctbal")),
    ]
    if levels > 3:
        orders = t("orders").join(customer.select("c_custkey", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey"))
        out.append(level(orders, 3, key("o", "o_orderkey"), key("c", "o_custkey"), "o_orderkey", F.concat(F.lit("Tip: "), "o_orderpriority"), F.col("o_totalprice")))
    if levels > 4:
        lines = t("lineitem").join(orders.select("o_orderkey", "n_regionkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        node = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
        out.append(level(lines, 4, node, key("o", "l_orderkey"), "l_linenumber", F.concat("l_returnflag", "l_linestatus"), F.col("l_extendedprice")))
    result = out[0]
    for part in out[1:levels]:
        result = result.unionByName(part)
    return result


SQL_NODES = """
nodes AS (
  SELECT r_regionkey AS map_id, 'r' || r_regionkey AS node_id, NULL AS parent_id, CAST(r_regionkey AS BIGINT) AS ord, 'root' AS type, r_name AS text, 0.0::DOUBLE AS value FROM region
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, 'section', n_name, 0.0 FROM nation
  UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || c_nationkey, c_custkey, 'concept', c_name || ': ' || c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, 'detail', 'Tip: ' || o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'l' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey, l_linenumber, 'transcript', l_returnflag || l_linestatus, l_extendedprice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
