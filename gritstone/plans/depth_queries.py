"""Reports on the graph of orders as services and parts as what they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritstone.operators import reports as R
from gritstone.sources.tables import table

from .catalogue import query

_TYPES = ("DOCUMENT", "DOCUMENT_GROUP", "ACTION", "VERIFICATION", "PAYMENT", "ELIGIBILITY", "PORTAL", "MOBILE_APP", "OFFICE", "DEPARTMENT", "HELPLINE", "GRIEVANCE_CHANNEL", "ACTION")
_EDGES = ("REQUIRES", "APPLY_AT", "AVAILABLE_VIA", "TRACK_AT", "ESCALATE_TO", "PRODUCES", "ISSUED_BY", "VERIFIED_BY", "REQUIRES", "REQUIRES", "REQUIRES", "VISIT_AT")
_TYPE = "CASE p_size % 13 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"
_EDGE = "CASE (l_orderkey + l_linenumber) % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_EDGES)) + " END"
_STATUS = "CASE l_returnflag WHEN 'A' THEN 'VERIFIED' WHEN 'N' THEN 'DISCOVERED' ELSE CASE WHEN l_tax = 0 THEN 'CONFLICTING' END END"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part").select(F.expr("'p' || p_partkey").alias("id"), F.expr(_TYPE).alias("type"), F.lit(1).alias("sources"), F.lit(0).alias("eligibility"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_size END").alias("step"), F.expr("CASE WHEN p_partkey % 9 = 0 THEN array('CONFLICTING', 'VERIFIED') WHEN p_partkey % 2 = 0 THEN array('VERIFIED') END").alias("statuses"))
    own = table(spark, d, "orders").select(F.expr("'s' || o_orderkey"), F.lit("SERVICE"), F.expr("CAST(o_totalprice > 100000 AS INT)"), F.expr("CAST(o_orderkey % 3 AS INT)"), F.lit(None).cast("int"), F.lit(None).cast("array<string>"))
    edges = table(spark, d, "lineitem").select(F.expr("'s' || l_orderkey").alias("src"), F.expr("'p' || l_partkey").alias("dst"), F.expr(_EDGE).alias("type"), F.expr(_STATUS).alias("status"), F.lit(None).cast("array<string>").alias("statuses"))
    return part.union(own), edges


@query(f"""WITH n AS (SELECT {_TYPE} AS type, p_partkey % 9 = 0 AS clash FROM part UNION ALL SELECT 'SERVICE', FALSE FROM orders), e AS (SELECT {_STATUS} AS status FROM lineitem)
 SELECT {', '.join(f"(SELECT count(*) FROM n WHERE type IN ({', '.join(map(repr, types))})) AS {name}" for name, types in R.NODE_ROWS.items())}, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE status = 'VERIFIED') AS verified_edges, (SELECT count(*) FROM n WHERE clash) + (SELECT count(*) FROM e WHERE status = 'CONFLICTING') AS conflicts,
 (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS jurisdictions, (SELECT count(*) FROM orders) AS requirement_groups, (SELECT count(*) FROM pages) AS sources, (SELECT count(*) FROM benchmark) AS questions""".replace("(SELECT count(*) FROM n WHERE type IN ('SERVICE',))", "(SELECT count(*) FROM orders)").replace(",))", "))"))
def q_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    places = table(spark, d, "region").select(F.lit(1)).union(table(spark, d, "nation").select(F.lit(1)))
    return R.statistics(nodes, edges, {"jurisdictions": places, "requirement_groups": table(spark, d, "orders"), "sources": table(spark, d, "pages"), "questions": table(spark, d, "benchmark")})


def _answer(q: str) -> str:
    edges, types, _ = R.QUESTIONS[q]
    if q == "SOURCE":
        return "o_totalprice > 100000"
    if q == "ACTIONS":
        return "coalesce(n_act, 0) >= 2"
    some = " OR ".join(f"{c} IN ({', '.join(map(repr, v))})" for c, v in (("e.type", edges), ("t.type", types)) if v)
    return f"coalesce(bool_or({some}), FALSE)" + (" OR o_orderkey % 3 > 0" if q == "ELIGIBILITY" else "")


_ANSWERS = f"""WITH t AS (SELECT p_partkey, {_TYPE} AS type, p_partkey % 2 = 0 AS step FROM part), e AS (SELECT l_orderkey, l_partkey, {_EDGE} AS type FROM lineitem),
 c AS (SELECT l_orderkey, count(*) FILTER (t.type = 'ACTION') AS n_act, count(*) FILTER (t.type = 'ACTION' AND step) AS numbered FROM e JOIN t ON p_partkey = l_partkey GROUP BY 1),
 a AS (SELECT 's' || o_orderkey AS id, {', '.join(f'{_answer(q)} AS "{q}"' for q in R.QUESTIONS)}, coalesce(any_value(n_act), 0) AS n_act, coalesce(any_value(numbered), 0) AS numbered FROM orders LEFT JOIN c USING (l_orderkey) LEFT JOIN e USING (l_orderkey) LEFT JOIN t ON p_partkey = l_partkey GROUP BY o_orderkey, o_totalprice, n_act)""".replace("FROM orders LEFT JOIN", "FROM (SELECT *, o_orderkey AS l_orderkey FROM orders) LEFT JOIN")
_MISSING = "list_filter([" + ", ".join(f"CASE WHEN NOT \"{q}\" THEN '{q}' END" for q in R.QUESTIONS) + "], lambda x: x IS NOT NULL)"
_SEARCH = "list_filter([" + ", ".join(f"CASE WHEN NOT \"{q}\" THEN '{s}' END" for q, (_, _, s) in R.QUESTIONS.items() if s) + "], lambda x: x IS NOT NULL)"


@query(f"""{_ANSWERS}, m AS (SELECT id, {_MISSING} AS missing, {_SEARCH} AS search FROM a)
 SELECT id, array_to_string(missing, ',') AS missing, array_to_string(list_filter(search, lambda x, i: list_position(search, x) = i), ',') AS retrievable, 13 - len(missing) AS answered, row_number() OVER (ORDER BY 13 - len(missing), id) AS place FROM m""")
def q_service_gaps(spark: SparkSession, d: str) -> DataFrame:
    told = R.measured(R.answers(*_graph(spark, d)))
    return told.select("id", F.array_join("missing", ",").alias("missing"), F.array_join("retrievable", ",").alias("retrievable"), F.col("answered").cast("bigint").alias("answered"), "place")


@query(f"""{_ANSWERS}, n AS (SELECT *, {' + '.join(f'"{q}"::INT' for q in R.DEPTH)} AS n FROM a) SELECT count(*) AS services, {', '.join(f'count(*) FILTER ("{q}") AS {q.lower()}' for q in R.DEPTH)}, count(*) FILTER (n_act <= 1) AS steps_one, count(*) FILTER (n_act BETWEEN 2 AND 3) AS steps_two_to_three, count(*) FILTER (n_act BETWEEN 4 AND 6) AS steps_four_to_six, count(*) FILTER (n_act >= 7) AS steps_seven_plus,
 count(*) FILTER (numbered >= 2) AS ordered, count(*) FILTER (n <= 3) AS thin, count(*) FILTER (n BETWEEN 4 AND 6) AS middling, count(*) FILTER (n >= 7) AS deep, round(avg(n), 6) AS mean FROM n""")
def q_depth_report(spark: SparkSession, d: str) -> DataFrame:
    return R.depth_report(R.answers(*_graph(spark, d)))
