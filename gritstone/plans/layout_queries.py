"""Queries on orders and drawings of small graphs: a customer's parts, each order's lines a path through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gritstone.operators import layout as L
from gritstone.sources.tables import table

from .catalogue import query

_BASE = """WITH i AS (SELECT DISTINCT o_custkey AS request_id, l_orderkey, l_partkey % 90 AS part, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'),
 n AS (SELECT request_id, 'n' || part AS node, min((l_orderkey * 31 + l_linenumber * 7) % 1009) AS place FROM i GROUP BY 1, 2), w AS (SELECT request_id, part, lead(part) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, part) AS next, l_orderkey FROM i)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, steps(request_id, part, next, l_orderkey)) of each customer's settled orders."""
    own = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, d, "lineitem").join(own, "l_orderkey").select("request_id", "l_orderkey", (F.col("l_partkey") % 90).alias("part"), "l_linenumber").distinct()
    nodes = items.groupBy("request_id", F.concat(F.lit("n"), "part").alias("node")).agg(F.min((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 1009).alias("place"))
    return nodes, items.withColumn("next", F.lead("part").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "part")))


@query(f"""{_BASE}, p AS (SELECT DISTINCT request_id, 'n' || part AS a, 'n' || next AS b FROM w WHERE next IS NOT NULL AND (part < next OR l_orderkey % 5 = 0)), s AS (SELECT request_id, node, row_number() OVER (PARTITION BY request_id ORDER BY place, node) AS k FROM n)""".replace("WITH i", "WITH RECURSIVE i") + """,
 st(request_id, done, node) AS (SELECT DISTINCT request_id, []::VARCHAR[], NULL::VARCHAR FROM n UNION ALL SELECT request_id, list_append(any_value(done), arg_min(node, k)), arg_min(node, k) FROM (SELECT st.request_id, st.done, s.node, s.k FROM st JOIN s ON s.request_id = st.request_id AND NOT list_contains(st.done, s.node) LEFT JOIN p ON p.request_id = s.request_id AND p.b = s.node AND NOT list_contains(st.done, p.a) GROUP BY ALL HAVING count(p.a) = 0) GROUP BY request_id),
 o AS (SELECT request_id, node, len(done) AS ord FROM st WHERE node IS NOT NULL), u AS (SELECT s.request_id, s.node, s.k FROM s ANTI JOIN o USING (request_id, node)), c AS (SELECT request_id, count(*) AS n FROM o GROUP BY 1)
 SELECT request_id, node, ord::INT AS ord, FALSE AS unordered FROM o UNION ALL SELECT u.request_id, u.node, (coalesce(c.n, 0) + row_number() OVER (PARTITION BY u.request_id ORDER BY u.k))::INT, TRUE FROM u LEFT JOIN c USING (request_id)""")
def q_topological_order(spark: SparkSession, d: str) -> DataFrame:
    nodes, steps = _graph(spark, d)
    pairs = steps.filter("next is not null and (part < next or l_orderkey % 5 = 0)").select("request_id", F.concat(F.lit("n"), "part").alias("before"), F.concat(F.lit("n"), "next").alias("after"))
    return L.topological(nodes, pairs)


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    nodes, steps = _graph(spark, d)
    edges = steps.filter("part < next").select("request_id", F.concat(F.lit("n"), "part").alias("src"), F.concat(F.lit("n"), "next").alias("dst"))
    return L.laid_out(nodes, edges, nodes.select("request_id").distinct().withColumn("root", F.lit("n0")))


@query(f"""{_BASE}, e AS (SELECT DISTINCT request_id, 'n' || part AS src, 'n' || next AS dst FROM w WHERE part < next)""".replace("WITH i", "WITH RECURSIVE i") + """, r(request_id, node, col) AS (SELECT request_id, node, 0 FROM n UNION SELECT r.request_id, e.dst, r.col + 1 FROM r JOIN e ON e.request_id = r.request_id AND e.src = r.node)
 SELECT request_id, node, max(col)::INT AS col FROM r GROUP BY 1, 2""")
def q_layout_columns(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d).select("request_id", "node", "col")


@query()
def q_layout(spark: SparkSession, d: str) -> DataFrame:
    """Rows after four turns; held against drawings by hand and a count of crossings in the tests."""
    return _drawn(spark, d)
