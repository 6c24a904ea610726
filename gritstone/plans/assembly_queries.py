"""Queries on the graph that facts of all kinds make; orders are services, their lines facts whose sentences have a known reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritstone.operators import assembly as A
from gritstone.sources.tables import table

from .catalogue import query

_KIND = "CASE k % 12 WHEN 0 THEN 'DOCUMENT_REQUIREMENT' WHEN 1 THEN 'OFFICE' WHEN 2 THEN 'HELPLINE' WHEN 3 THEN 'CHANNEL' WHEN 4 THEN 'TRACKING' WHEN 5 THEN 'CHANNEL' WHEN 6 THEN 'GRIEVANCE' WHEN 7 THEN 'ACTION' WHEN 8 THEN 'FEE' WHEN 9 THEN 'TIMELINE' WHEN 10 THEN 'ELIGIBILITY' ELSE 'ELIGIBILITY' END"
_OBJECT = "CASE WHEN k % 12 = 0 THEN CASE WHEN p % 20 = 7 THEN 'full_name' ELSE 'licence_' || (p % 20) END WHEN k % 12 = 1 THEN 'office_address' WHEN k % 12 = 11 THEN 'licence_' || (p % 20) END"
_URL = "CASE p % 5 WHEN 0 THEN 'http://www.D' || (p % 9) || '.gov.in/a?x=1#f' WHEN 1 THEN 'https://d' || (p % 9) || '.nic.in' WHEN 2 THEN 'Sanman Portal' WHEN 3 THEN 'https://face.example/x' ELSE '' END"
_CLAIM = """CASE k % 12 WHEN 1 THEN 'The Ward ' || (p % 30) || ' Board office is located at Block ' || p WHEN 7 THEN CASE WHEN p % 3 = 0 THEN 'Click go' ELSE 'Submit form ' || (p % 7) || ';' END WHEN 8 THEN CASE WHEN p % 3 = 0 THEN 'The total cost of one unit is ' || p ELSE 'The fee is ' || (p % 50) || ' rupees' END
 WHEN 9 THEN CASE WHEN p % 3 = 0 THEN 'An appeal takes ' || p || ' days' ELSE 'The permit is issued within ' || p || ' days' END WHEN 10 THEN CASE WHEN p % 3 = 0 THEN 'It aims to help' ELSE 'The applicant must be of class ' || (p % 9) END WHEN 11 THEN 'Licence ' || (p % 20) || ' will be issued by the Ward ' || (p % 30) || ' Board' ELSE 'Nothing' END"""
#: A fact's number is its line's and its part's; parts below a thousand million keep it one fact's own.
_FACTS = f"SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey AS fact_id, l_orderkey * 10 + l_linenumber AS k, l_partkey AS p, 's' || l_orderkey AS service, l_orderkey AS own FROM lineitem"
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_BASE = f"""WITH f AS (SELECT *, {_KIND} AS kind, {_OBJECT} AS object, {_CLAIM} AS claim, {_URL} AS url, own % 2 = 0 AS promoted, own % 10 = 4 AS authored FROM (SELECT DISTINCT * FROM ({_FACTS}))),
 doc AS (SELECT DISTINCT 'document:' || object AS id FROM f WHERE k % 12 = 0 AND p % 20 <> 7 AND p % 20 % 3 > 0 AND p % 20 <> 19),
 m AS (SELECT fact_id, service, claim, CASE WHEN k % 12 = 0 AND p % 20 <> 7 AND p % 20 % 3 > 0 AND p % 20 <> 19 THEN ['document:' || object, 'DOCUMENT', upper(object[1]) || replace(object[2:], '_', ' '), 'REQUIRES', ''] WHEN k % 12 = 1 AND p % 4 > 0 THEN ['office:ward_' || (p % 30) || '_board_office', 'OFFICE', 'Ward ' || (p % 30) || ' Board office', 'VISIT_AT', '']
  WHEN k % 12 = 2 AND p % 5 > 0 THEN ['helpline:1800_' || (p % 40), 'HELPLINE', 'Order ' || own || ' helpline', 'CALL_IF', ''] WHEN k % 12 IN (3, 4) AND p % 5 = 0 THEN ['portal:d' || (p % 9) || '_gov_in_' || sha1('https://www.d' || (p % 9) || '.gov.in/a?x=1')[:6], 'PORTAL', 'd' || (p % 9) || '.gov.in/a', CASE WHEN k % 12 = 4 THEN 'TRACK_AT' ELSE 'APPLY_AT' END, 'c']
  WHEN k % 12 IN (3, 4) AND p % 5 = 1 THEN ['portal:d' || (p % 9) || '_nic_in', 'PORTAL', 'd' || (p % 9) || '.nic.in', CASE WHEN k % 12 = 4 THEN 'TRACK_AT' ELSE 'APPLY_AT' END, 'c'] WHEN k % 12 = 5 AND p % 2 = 0 THEN ['helpline:desk' || (p % 9) || '_lake_gov_in', 'HELPLINE', 'Order ' || own || ' by email', 'CALL_IF', 'c']
  WHEN k % 12 = 6 THEN ['grievance:' || service, 'GRIEVANCE_CHANNEL', 'Grievances about order ' || own, 'ESCALATE_TO', ''] WHEN k % 12 = 7 AND promoted AND p % 3 > 0 AND NOT authored THEN ['action:' || service || '_submit_form_' || (p % 7), 'ACTION', 'Submit form ' || (p % 7), 'REQUIRES', 'c'] END AS x FROM f),
 a AS (SELECT fact_id, service, claim, ['department:ward_' || (p % 30) || '_board', 'DEPARTMENT', 'Ward ' || (p % 30) || ' Board', 'ISSUED_BY', 'c'] AS x, CASE WHEN 'document:' || object IN (SELECT id FROM doc) THEN 'document:' || object END AS d FROM f WHERE k % 12 = 11),
 o AS (SELECT fact_id, service, claim, CASE WHEN 'document:' || object IN (SELECT id FROM doc) THEN ['document:' || object, 'DOCUMENT', 'Licence ' || (p % 20), 'PRODUCES', 'c'] ELSE ['output:' || object, 'OUTPUT', 'Licence ' || (p % 20), 'PRODUCES', 'c'] END AS x FROM f WHERE k % 12 = 11 AND promoted),
 s AS (SELECT 'service:' || service AS id, 'Order ' || any_value(own) AS name, arg_min('h' || (p % 6) || '.gov.in', fact_id) AS host, arg_min(claim, fact_id) FILTER (k % 12 = 8 AND p % 3 > 0) AS fee, arg_min(claim, fact_id) FILTER (k % 12 = 9 AND p % 3 > 0) AS timeline FROM f GROUP BY service
  HAVING bool_or(k % 12 IN (8, 9, 10, 11) OR (k % 12 = 5) OR (k % 12 IN (3) AND p % 5 IN (0, 1, 4)) OR (k % 12 = 4 AND p % 5 IN (0, 1)) OR (k % 12 = 7 AND (NOT promoted OR (p % 3 > 0 AND NOT authored))))),
 links AS (SELECT fact_id, 'service:' || service AS src, x, claim FROM m WHERE x IS NOT NULL UNION ALL SELECT fact_id, coalesce(d, 'service:' || service), x, claim FROM a UNION ALL SELECT fact_id, 'service:' || service, x, claim FROM o
  UNION ALL SELECT 9223372036854775807, id, ['payment:' || id[9:] || '_fee', 'PAYMENT', 'Pay the fee for ' || name, 'REQUIRES', ''], fee FROM s WHERE fee IS NOT NULL UNION ALL SELECT 9223372036854775807, id, ['portal:' || {_SLUG.format('host')}, 'PORTAL', host, 'APPLY_AT', ''], 'Published on ' || host || '.' FROM s),
 n AS (SELECT x[1] AS id, arg_min(x[2], fact_id) AS type, arg_min(x[3], (fact_id, x[3])) AS name FROM links WHERE x[1] NOT IN ('document:licence_1', 'office:ward_3_board_office') GROUP BY 1 UNION ALL SELECT id, 'SERVICE', name FROM s)"""


def _assembled(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k, p = F.col("k"), F.col("p")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("own"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_partkey").alias("p")).distinct()
    own = lines.select((k * 1_000_000_000 + p).alias("fact_id"), "k", "p", F.concat(F.lit("s"), "own").alias("service"), "own")
    detail = F.create_map(
        F.lit("url"), F.when(k % 12 != 5, F.expr(_URL)), F.lit("address"), F.when((k % 12 == 1) & (p % 4 > 0), "1 Road"), F.lit("phone"), F.when((k % 12 == 2) & (p % 5 > 0), F.concat(F.lit("1800 "), p % 40)),
        F.lit("email"), F.when((k % 12 == 5) & (p % 2 == 0), F.concat(F.lit(" Desk"), p % 9, F.lit("@Lake.gov.in"))).when(k % 12 == 5, "x@mail.example"), F.lit("amount"), F.lit("5"), F.lit("days"), F.lit("7"),
    )
    facts = own.select("fact_id", "service", F.concat(F.lit("Order "), "own").alias("service_name"), F.concat(F.lit("h"), p % 6, F.lit(".gov.in")).alias("host"), F.lit("u").alias("url"), F.expr(_KIND).alias("kind"), F.expr(_OBJECT).alias("object"), detail.alias("detail"), F.expr(_CLAIM).alias("claim"), (F.col("own") % 2 == 0).alias("promoted"))
    papers = spark.range(20).filter("id not in (7, 19)").select(F.concat(F.lit("Licence "), "id").alias("phrase"), (F.col("id") % 3 > 0).alias("document"))  # the twenty objects there are
    taken = spark.createDataFrame([("document:licence_1",), ("office:ward_3_board_office",)], "id string")
    authored = table(spark, d, "orders").filter("o_orderkey % 10 = 4").select(F.concat(F.lit("service:s"), "o_orderkey").alias("id"))
    return A.assembled(facts, papers, taken, authored)


@query(f"{_BASE} SELECT id, type, name FROM n")
def q_assembled_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d)["nodes"]


@query(f"""{_BASE}, e AS (SELECT src, x[1] AS dst, x[4] AS type, arg_min(claim, (fact_id, claim)) AS note FROM links GROUP BY 1, 2, 3), live AS (SELECT id FROM n UNION SELECT 'document:licence_1' UNION SELECT 'office:ward_3_board_office')
 SELECT 'e:' || {_SLUG.format('src')} || '__' || lower(type) || '__' || {_SLUG.format('dst')} AS id, src, dst, type, note FROM e WHERE NOT (type = 'REQUIRES' AND (src, dst) IN (SELECT (src, dst) FROM e WHERE type = 'PRODUCES')) AND src IN (SELECT id FROM live) AND dst IN (SELECT id FROM live)""")
def q_assembled_edges(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d)["edges"]


@query(f"""{_BASE}, r AS (SELECT service, claim, min(fact_id) AS fact_id FROM f WHERE k % 12 = 10 AND p % 3 > 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY service ORDER BY min(fact_id)) <= 6), g AS (SELECT 'service:' || service AS id, string_agg(claim, '|' ORDER BY fact_id) AS rules FROM r GROUP BY 1)
 SELECT id, name, host, fee, timeline, coalesce(rules, '') AS eligibility FROM s LEFT JOIN g USING (id)""")
def q_assembled_services(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d)["services"].withColumn("eligibility", F.array_join("eligibility", "|"))


@query(f"""{_BASE}, w AS (SELECT CASE WHEN k % 12 = 0 THEN CASE WHEN p % 20 = 7 OR p % 20 % 3 = 0 THEN 'NOT_A_DOCUMENT' WHEN p % 20 = 19 THEN 'UNKNOWN_CANONICAL_ENTITY' END WHEN k % 12 = 1 THEN CASE WHEN p % 4 = 0 THEN 'UNKNOWN_CANONICAL_ENTITY' END WHEN k % 12 = 2 THEN CASE WHEN p % 5 = 0 THEN 'NO_CONTACT_VALUE' END
  WHEN k % 12 IN (3, 4) AND p % 5 = 2 THEN 'FAILED_NORMALIZATION' WHEN k % 12 IN (3, 4) AND p % 5 = 3 THEN 'UNTRUSTED_HOST' WHEN k % 12 = 4 AND p % 5 = 4 THEN 'FAILED_NORMALIZATION' WHEN k % 12 = 7 AND promoted THEN CASE WHEN p % 3 = 0 THEN 'NOT_A_CITIZEN_STEP' WHEN authored THEN 'ALREADY_OWNED' END
  WHEN k % 12 = 8 AND p % 3 = 0 THEN 'NOT_A_CITIZEN_FEE' WHEN k % 12 = 9 AND p % 3 = 0 THEN 'NOT_A_PROCESSING_TIME' WHEN k % 12 = 10 AND p % 3 = 0 THEN 'NOT_A_CRITERION' WHEN k % 12 = 11 THEN 'NOT_A_CRITERION' END AS reason FROM f
  UNION ALL SELECT 'NO_QUOTABLE_EVIDENCE' FROM (SELECT DISTINCT 'service:' || service AS id FROM f) WHERE id NOT IN (SELECT id FROM s)) SELECT reason, count(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY 1""")
def q_assembled_refusals(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d)["refused"].groupBy("reason").agg(F.count("*").alias("n"))
