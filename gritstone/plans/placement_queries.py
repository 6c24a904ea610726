"""Queries on facts becoming nodes and edges, offices, channels, and plans of several goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gritstone.operators import journeys as J, placement as P
from gritstone.sources.tables import table

from .catalogue import query

_KINDS = ("DOCUMENT_REQUIREMENT", "OUTPUT", "HELPLINE", "OFFICE", "CHANNEL", "TRACKING", "GRIEVANCE", "ACTION", "FEE", "BLOCKER", "DEPENDENCY", "RUMOUR")
_TRUSTED = r"(^|\.)(gov\.example|nic\.example)$"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 12 + 1).cast("int"))
    own = lambda n, c: F.when(k % n == 0, c)
    detail = F.map_filter(F.create_map(F.lit("phone"), own(2, F.lit("100")), F.lit("address"), own(3, F.lit("1 Road")), F.lit("url"), own(5, F.lit("http://x")), F.lit("name"), own(7, F.lit("N"))), lambda _, v: v.isNotNull())
    thing = F.when(k % 19 == 0, "Full-Name").otherwise(F.concat(F.lit("Thing "), F.col("l_partkey") % 40))
    return table(spark, d, "lineitem").select(k.alias("fact_id"), F.concat(F.lit("s"), "l_suppkey").alias("service"), kind.alias("kind"), thing.alias("object"), detail.alias("detail"), F.concat(F.lit("u"), F.col("l_orderkey") % 30).alias("url"), F.col("l_orderkey").alias("page_id"))


_FACT_SQL = f"""WITH k AS (SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem), f AS (SELECT k AS fact_id, 's' || l_suppkey AS service, [{', '.join(f"'{x}'" for x in _KINDS)}][1 + k % 12] AS kind, CASE WHEN k % 19 = 0 THEN 'Full-Name' ELSE 'Thing ' || (l_partkey % 40) END AS object, CASE WHEN k % 19 = 0 THEN 'full_name' ELSE 'thing_' || (l_partkey % 40) END AS thing, 'u' || (l_orderkey % 30) AS url, l_orderkey AS page_id, k FROM k),
 p AS (SELECT *, CASE WHEN kind IN ('DOCUMENT_REQUIREMENT', 'FEE', 'ACTION') THEN TRUE WHEN kind = 'HELPLINE' THEN k % 2 = 0 WHEN kind = 'OFFICE' THEN k % 3 = 0 WHEN kind IN ('CHANNEL', 'TRACKING') THEN k % 5 = 0 ELSE kind = 'GRIEVANCE' END AS placeable, kind = 'DOCUMENT_REQUIREMENT' AND thing = 'full_name' AS field FROM f),
 g AS (SELECT *, (placeable OR kind = 'OUTPUT') AND NOT field AS ok, CASE kind WHEN 'DOCUMENT_REQUIREMENT' THEN 'DOCUMENT' WHEN 'OUTPUT' THEN 'DOCUMENT' WHEN 'HELPLINE' THEN 'HELPLINE' WHEN 'OFFICE' THEN 'OFFICE' WHEN 'CHANNEL' THEN 'PORTAL' WHEN 'TRACKING' THEN 'PORTAL' WHEN 'GRIEVANCE' THEN 'GRIEVANCE_CHANNEL' WHEN 'ACTION' THEN 'ACTION' WHEN 'FEE' THEN 'PAYMENT' END AS type,
  CASE kind WHEN 'OUTPUT' THEN 'PRODUCES' WHEN 'CHANNEL' THEN 'APPLY_AT' WHEN 'TRACKING' THEN 'TRACK_AT' WHEN 'OFFICE' THEN 'VISIT_AT' WHEN 'HELPLINE' THEN 'CALL_IF' WHEN 'GRIEVANCE' THEN 'ESCALATE_TO' ELSE 'REQUIRES' END AS edge FROM p)
"""


@query(_FACT_SQL + "SELECT lower(type) || ':' || thing AS id, any_value(type) AS type, arg_min(object, fact_id) AS name FROM g WHERE ok GROUP BY 1")
def q_place_nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.placed(_facts(spark, d))[0].select("id", "type", "name")


@query(_FACT_SQL + """, e AS (SELECT service, edge, lower(type) || ':' || thing AS node, url, min(fact_id) AS fact_id FROM g WHERE ok GROUP BY ALL), k2 AS (SELECT e.* FROM e WHERE NOT (edge = 'REQUIRES' AND (service, node) IN (SELECT (service, node) FROM e WHERE edge = 'PRODUCES')) QUALIFY row_number() OVER (PARTITION BY service, edge, node ORDER BY fact_id) <= 12)
 SELECT service || '|' || edge || '|' || node AS id, service AS src, node AS dst, edge AS type, array_to_string(list(url ORDER BY fact_id), ',') AS urls FROM k2 GROUP BY service, edge, node""")
def q_place_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.placed(_facts(spark, d))[1].select("id", "src", "dst", "type", F.array_join("urls", ",").alias("urls"))


@query(_FACT_SQL + """SELECT CASE WHEN field THEN 'FORM_FIELD' WHEN kind = 'OFFICE' THEN CASE WHEN k % 7 = 0 THEN 'NO_LOCATION' ELSE 'UNKNOWN_CANONICAL_ENTITY' END WHEN kind = 'HELPLINE' THEN 'NO_CONTACT_VALUE' WHEN kind = 'TRACKING' THEN CASE WHEN k % 5 = 0 THEN 'UNTRUSTED_HOST' ELSE 'FAILED_NORMALIZATION' END WHEN kind = 'BLOCKER' THEN 'NO_REASON' WHEN kind = 'DEPENDENCY' THEN 'AMBIGUOUS_RELATION' ELSE 'UNSUPPORTED_KIND' END AS reason, count(*) AS n, min(fact_id) AS first_fact FROM g WHERE NOT ok GROUP BY 1""")
def q_unplaceable(spark: SparkSession, d: str) -> DataFrame:
    return P.placed(_facts(spark, d))[2].groupBy("reason").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_fact"))


@query(_FACT_SQL + "SELECT page_id, count(*) AS n FROM g JOIN orders ON o_orderkey = page_id WHERE placeable AND o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) >= 2")
def q_page_admission(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), "o_orderstatus")
    return P.admissible(pages, _facts(spark, d), pages.filter("o_orderstatus = 'P'"), 2)


@query("""SELECT r_name AS journey, count(DISTINCT s_suppkey) AS services, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS aliases FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0) GROUP BY 1 HAVING count(DISTINCT s_suppkey) >= 3""")
def q_service_groups(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations, five regions
    taken = table(spark, d, "lineitem").filter("l_quantity = 50 and l_discount = 0").select(F.col("l_suppkey").alias("id"))
    return P.journeys_of(own.select(F.col("r_name").alias("journey"), F.col("s_suppkey").alias("id"), F.col("n_name").alias("alias")), taken)


def _raw(k: Column) -> Column:
    return F.when(k % 5 == 0, F.concat(F.lit("http://www.D"), k % 9, F.lit(".Gov.example/a/"), k, F.lit("?q=1#f"))).when(k % 5 == 1, F.concat(F.lit("d"), k % 9, F.lit(".nic.example"))).when(k % 5 == 2, "Sanman Portal").when(k % 5 == 3, "https://face.example/x").otherwise(F.concat(F.lit("https://u@d"), k % 9, F.lit(".gov.example:8443/")))


@query("""WITH r AS (SELECT c_custkey AS k, c_mktsegment FROM customer) SELECT k AS c_custkey, CASE k % 5 WHEN 0 THEN 'd' || (k % 9) || '.gov.example' WHEN 1 THEN 'd' || (k % 9) || '.nic.example' WHEN 4 THEN 'd' || (k % 9) || '.gov.example' END AS host, CASE k % 5 WHEN 0 THEN 'https://www.d' || (k % 9) || '.gov.example/a/' || k || '?q=1' WHEN 1 THEN 'https://d' || (k % 9) || '.nic.example/' WHEN 4 THEN 'https://d' || (k % 9) || '.gov.example/' END AS url, CASE WHEN k % 5 IN (1, 4) THEN TRUE WHEN k % 5 = 0 THEN FALSE END AS root,
 CASE WHEN k % 4 = 0 THEN 'KIOSK' WHEN c_mktsegment = 'BUILDING' THEN 'PHYSICAL_OFFICE' WHEN c_mktsegment = 'MACHINERY' THEN 'PHONE' ELSE 'WEB' END AS channel, CASE WHEN k % 3 = 0 THEN 'Office ' || k || ' (address not verified yet)' WHEN k % 3 = 1 THEN 'Office ' || k || ', 1 Road' ELSE 'at Office ' || k || ', 2 Road' END AS line FROM r""")
def q_destinations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("Office "), k)
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "OFFICE").when(F.col("c_mktsegment") == "MACHINERY", "HELPLINE").otherwise("PORTAL")
    line = P.office_line(name, F.when(k % 3 == 1, "1 Road").when(k % 3 == 2, F.concat(F.lit("at "), name, F.lit(", 2 Road"))))
    return table(spark, d, "customer").select(k, P.destination(_raw(k), _TRUSTED).alias("x"), P.channel_type(kind, F.when(k % 4 == 0, "KIOSK")).alias("channel"), line.alias("line")).select(k, "x.host", "x.url", "x.root", "channel", "line")


@query("""WITH o AS (SELECT 'o' || s_suppkey AS id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'n' || s_nationkey ELSE 'r' || n_regionkey END AS scope FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0),
 r AS (SELECT n_nationkey, id, name, CASE WHEN scope = 'n' || n_nationkey THEN 0 WHEN scope = 'r' || n_regionkey THEN 1 ELSE 3 END AS far FROM nation CROSS JOIN o)
 SELECT n_nationkey, id, row_number() OVER (PARTITION BY n_nationkey ORDER BY far, name, id) AS place FROM r QUALIFY place <= 3""")
def q_offices_by_scope(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    s = F.col("s_suppkey")
    offices = table(spark, d, "supplier").filter("s_acctbal > 0").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("o"), s).alias("id"), F.col("s_name").alias("name"), F.when(s % 3 == 1, F.concat(F.lit("n"), "s_nationkey")).when(s % 3 == 2, F.concat(F.lit("r"), "n_regionkey")).alias("scope"))
    chains = nation.select(F.col("n_nationkey").alias("request_id"), F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")).alias("chain"))
    return P.nearest_scope(offices, chains, 3).select(F.col("request_id").alias("n_nationkey"), "id", "place")


@query("""WITH g AS (SELECT DISTINCT o_custkey, l_suppkey AS goal FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'), p AS (SELECT a.o_custkey, b.goal AS before, a.goal AS after FROM g a JOIN g b ON b.o_custkey = a.o_custkey AND b.goal = a.goal // 2 AND a.goal > 0),
 w AS (SELECT o_custkey, goal, 0 AS layer FROM g WHERE (o_custkey, goal) NOT IN (SELECT (o_custkey, after) FROM p))
 SELECT o_custkey, goal, layer, row_number() OVER (PARTITION BY o_custkey ORDER BY layer, goal) AS place FROM (WITH RECURSIVE t AS (SELECT o_custkey, goal, 0 AS layer FROM w UNION ALL SELECT t.o_custkey, p.after, t.layer + 1 FROM t JOIN p ON p.o_custkey = t.o_custkey AND p.before = t.goal) SELECT * FROM t)""")
def q_goal_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    goals = rows.select(F.col("o_custkey").alias("plan_id"), F.col("l_suppkey").alias("goal")).distinct()
    needs = table(spark, d, "supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("goal"), F.floor(F.col("s_suppkey") / 2).alias("other"))
    told = J.layered(goals.select(F.col("plan_id").alias("request_id"), F.col("goal").alias("node"), F.col("goal").alias("ord")), P.goal_order(goals, needs))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("layer").asc_nulls_last(), "ord"))
    return told.select(F.col("request_id").alias("o_custkey"), F.col("node").alias("goal"), "layer", place.cast("bigint").alias("place"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS step, CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank, l_returnflag <> 'N' AS verified FROM lineitem), v AS (SELECT l_orderkey, step, coalesce(lag(step) OVER (PARTITION BY l_orderkey ORDER BY rank, step) < step, TRUE) AS rises FROM s WHERE verified)
 SELECT l_orderkey, coalesce(bool_and(rises), TRUE) AS grouped, any_value(n) AS steps FROM (SELECT l_orderkey, count(*) AS n FROM s GROUP BY 1) LEFT JOIN v USING (l_orderkey) GROUP BY 1""")
def q_stage_groups(spark: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, ("PREPARE", "APPLY", "TRACK"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("journey"), F.col("l_linenumber").alias("step"), stage.alias("stage"), (F.col("l_returnflag") != "N").alias("verified"))
    told = P.grouped_by_stage(steps, ["PREPARE", "APPLY", "TRACK"])
    return told.groupBy(F.col("journey").alias("l_orderkey")).agg(F.bool_and("grouped").alias("grouped"), F.count("*").alias("steps"))
