"""Queries on offices out of facts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritstone.functions import names as N
from gritstone.operators import offices as O
from gritstone.sources.tables import table

from .catalogue import query
from .naming_queries import _DICTIONARY, _TYPE, _dictionary

_NAME = "CASE o_orderkey % 7 WHEN 0 THEN 'mamlatdar office ' || (o_custkey % 12) WHEN 1 THEN 'Shri Vale' WHEN 2 THEN 'address' WHEN 3 THEN 'Lake Board ' || (o_custkey % 5) WHEN 4 THEN 'RTO Surat' END"
_ADDRESS = "CASE o_orderkey % 5 WHEN 0 THEN 'Plot ' || (o_custkey % 3) || ',  Long Lake Road, Anand' WHEN 1 THEN 'too short' WHEN 2 THEN 'House ' || (o_custkey % 4) || ', Far Away Street Number Two' END"
_PHONE = "CASE o_orderkey % 4 WHEN 0 THEN '079 2345  67' || (10 + o_custkey % 9) WHEN 1 THEN 'N/A' END"
_EMAIL = "CASE WHEN o_orderkey % 6 = 0 THEN ' Desk' || (o_custkey % 6) || '@Lake.gov.example' END"
_URL = "'https://' || CASE o_custkey % 4 WHEN 0 THEN 'collectorkheda' WHEN 1 THEN 'bhuj-city' ELSE 'lake' END || '.example/p' || (o_custkey % 9)"
_TITLE = "CASE WHEN page % 3 = 0 THEN 'Forms | Jan Seva Kendra' ELSE 'News' END"
_BASE = f"""WITH {_DICTIONARY}, f AS (SELECT o_orderkey AS fact_id, {_URL} AS url, trim(regexp_replace({_NAME}, '\\s+', ' ', 'g')) AS printed, CASE WHEN o_orderkey % 9 = 0 THEN 'Gram panchayat' END AS thing, trim(regexp_replace({_ADDRESS}, '\\s+', ' ', 'g')) AS a, regexp_replace(trim({_PHONE}), '\\s+', ' ', 'g') AS p, lower(trim({_EMAIL})) AS email, o_custkey % 9 AS page FROM orders),
 g AS (SELECT *, CASE WHEN length(a) BETWEEN 20 AND 300 THEN a END AS address, CASE WHEN length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 THEN p END AS phone, CASE WHEN length(printed) > 3 AND printed NOT IN ('Shri Vale', 'address') THEN printed WHEN thing IS NOT NULL THEN thing WHEN page % 3 = 0 THEN 'Jan Seva Kendra' END AS name, CASE WHEN (length(printed) > 3 AND printed NOT IN ('Shri Vale', 'address')) OR thing IS NOT NULL THEN 'EXTRACTED' ELSE 'NORMALIZED' END AS status FROM f),
 k AS (SELECT *, name || ' ' || coalesce(address, '') AS said, regexp_extract(url, '//([^/]+)', 1) AS host, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS slug, {_TYPE.format(c='name')} AS type FROM g WHERE coalesce(address, phone, email) IS NOT NULL AND name IS NOT NULL),
 t AS (SELECT said, code FROM (SELECT DISTINCT said FROM k) JOIN dictionary ON contains(' ' || regexp_replace(lower(said), '[^a-z]+', ' ', 'g') || ' ', ' ' || pattern || ' ') QUALIFY row_number() OVER (PARTITION BY said ORDER BY length(pattern) DESC, place) = 1),
 h AS (SELECT host, code FROM (SELECT DISTINCT host FROM k) JOIN dictionary ON contains(regexp_replace(lower(host), '[^a-z]', '', 'g'), pattern) QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(pattern) DESC, place) = 1),
 s AS (SELECT k.*, coalesce(t.code, h.code, 'IN-GJ') AS scope FROM k LEFT JOIN t USING (said) LEFT JOIN h USING (host)), o AS (SELECT *, 'office:' || slug || '_' || sha1(coalesce(type, '') || '|' || slug || '|' || scope)[:6] AS id FROM s)"""


def _lists(c: str, n: int) -> str:
    return f"l_{c} AS (SELECT id, string_agg(v, '|' ORDER BY m, v) AS {c}s, max(total) AS n_{c} FROM (SELECT id, {c} AS v, min(fact_id) AS m, count(*) OVER (PARTITION BY id) AS total FROM o WHERE {c} IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(fact_id), {c}) <= {n}) GROUP BY 1)"


@query(f"""{_BASE}, {_lists('address', 4)}, {_lists('phone', 6)}, {_lists('email', 4)}, {_lists('url', 6)}, b AS (SELECT id, arg_min(name, (status = 'NORMALIZED', fact_id)) AS name, min(status) AS status, any_value(type) AS type, any_value(scope) AS scope, count(*) AS facts FROM o GROUP BY 1)
 SELECT id, CASE WHEN regexp_matches(name, '[A-Z]') THEN name ELSE array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS name, type, scope, status, facts, coalesce(addresss, '') AS addresses, coalesce(phones, '') AS phones, coalesce(emails, '') AS emails, urls, coalesce(n_address, 0) > 1 AS conflicting FROM b LEFT JOIN l_address USING (id) LEFT JOIN l_phone USING (id) LEFT JOIN l_email USING (id) LEFT JOIN l_url USING (id)""")
def q_offices(spark: SparkSession, d: str) -> DataFrame:
    found = _offices(spark, d)[0]
    text = lambda c, name: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(name)
    return found.select("id", "name", "type", "scope", "status", "facts", text("address", "addresses"), text("phone", "phones"), text("email", "emails"), text("url", "urls"), "conflicting")


@query(f"{_BASE} SELECT CASE WHEN coalesce(address, phone, email) IS NULL THEN 'UNREACHABLE' ELSE 'UNNAMED' END AS reason, count(*) AS n FROM g WHERE coalesce(address, phone, email) IS NULL OR name IS NULL GROUP BY 1")
def q_refused_offices(spark: SparkSession, d: str) -> DataFrame:
    return _offices(spark, d)[1].groupBy("reason").agg(F.count("*").alias("n"))


def _offices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders")
    detail = F.map_filter(F.create_map(*(x for k, e in (("name", _NAME), ("address", _ADDRESS), ("phone", _PHONE), ("email_id", _EMAIL)) for x in (F.lit(k), F.expr(e)))), lambda _, v: v.isNotNull())
    facts = orders.select(F.col("o_orderkey").alias("fact_id"), F.expr(_URL).alias("url"), F.when(F.col("o_orderkey") % 9 == 0, "gram_panchayat").alias("object"), detail.alias("detail"))
    pages = orders.select(F.expr(_URL).alias("url"), (F.col("o_custkey") % 9).alias("page")).distinct().select("url", F.expr(_TITLE).alias("title"))
    return O.offices(facts, pages, _dictionary(spark), N.ROOT)
