"""Queries on what pages are worth and whose they are, on kinds of facts, and on cases looked up in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritstone.functions import sites as S
from gritstone.operators import research as R
from gritstone.sources.tables import table

from .catalogue import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sum(c: str, rules: tuple[tuple[int, str], ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({c}, {_q(p)}) THEN {w} ELSE 0 END" for w, p in rules) + ")"


_HOSTS = "CASE o_orderkey % 14 WHEN 0 THEN 'lake.gujarat.gov.in' WHEN 1 THEN 'www.fssai.gov.in' WHEN 2 THEN 'excise.wb.gov.in' WHEN 3 THEN 'hrylabour.gov.in' WHEN 4 THEN 'GHMC.gov.in' WHEN 5 THEN 'portal.nic.in' WHEN 6 THEN 'shop' || (o_orderkey % 5) || '.example' WHEN 7 THEN 'bihar.gov.in' WHEN 8 THEN 'gov.in.example' WHEN 9 THEN 'labour.gov.in' ELSE 'd' || (o_orderkey % 40) || '.gov.in' END"
_PATHS = "CASE o_custkey % 12 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/Home.aspx' WHEN 3 THEN '/How-To%20Apply/form.pdf' WHEN 4 THEN '/news/tender?id=' || o_orderkey WHEN 5 THEN '/draft_rules/x' WHEN 6 THEN '/karnataka/rules' WHEN 7 THEN '/seva/certificate?no=' || (o_orderkey % 7) WHEN 8 THEN '/login' WHEN 9 THEN '/archive/photo-gallery' WHEN 10 THEN '/fees/eligibility' ELSE '/p/' || (o_orderkey % 50) END"
_URL = f"'https://' || {_HOSTS} || {_PATHS}"
_TITLE = "CASE o_orderkey % 6 WHEN 0 THEN 'Apply for a Licence' WHEN 1 THEN 'Annual Report' WHEN 2 THEN NULL WHEN 3 THEN 'Service Status' ELSE 'Page ' || o_orderkey END"


@query(f"""WITH p AS (SELECT o_orderkey, lower(url_decode(regexp_replace({_URL}, '(?i)^https?://[^/]+', ''))) AS path, lower(coalesce({_TITLE}, '') || ' ' || o_orderpriority) AS text FROM orders)
 SELECT o_orderkey, 2 * ({_sum('path', S.URL_FOR)} - {_sum('path', S.URL_AGAINST)}) + {_sum('text', S.URL_FOR)} - {_sum('text', S.URL_AGAINST)} + CASE WHEN path IN ('', '/') OR regexp_matches(path, '^/(index|home|default)\\.\\w+$') THEN 8 ELSE 0 END + CASE WHEN path LIKE '%.pdf' THEN 1 ELSE 0 END - CASE WHEN regexp_matches(path, '[?&](id|no|num|srno)=\\d+') THEN 6 ELSE 0 END AS score FROM p""")
def q_link_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", S.url_score(F.expr(_URL), F.expr(_TITLE), F.col("o_orderpriority")).alias("score"))


_TEXT = "text || CASE doc_id % 9 WHEN 0 THEN ' Documents required: proof. Fee Rs. 20. Eligibility: adults.' WHEN 1 THEN ' Tender notice and merit list of the board of directors' WHEN 2 THEN ' Step 1 how to apply, helpline, certificate, office' ELSE '' END"


@query(f"SELECT doc_id, CASE WHEN length(t) < {S.LEAST_PAGE} THEN 0 ELSE {_sum('t', S.PAGE_FOR)} - {_sum('t', S.PAGE_AGAINST)} END AS score FROM (SELECT doc_id, {_TEXT} AS t FROM documents)")
def q_page_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.page_score(F.expr(_TEXT)).alias("score"))


_HOST_OF = "regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"
_WRONG = f"NOT contains(lower(url), 'gujarat') AND (regexp_matches(lower(url), {_q(S.STATE_IN_URL)}) OR regexp_matches(host, {_q(S.STATE_CODE)}) OR (regexp_matches(host, '\\.gov\\.in$') AND (regexp_matches(split_part(host, '.', 1), {_q(S.STATE_DEPARTMENT)}) OR regexp_matches(split_part(host, '.', 1), {_q(S.OTHER_CITY)}))))"
_RULES = f"NOT regexp_matches(url, {_q(S.NO_RULE_PAGE)}) AND NOT regexp_matches(url, {_q(S.NOT_IN_FORCE)})"
_RANK = f"CASE WHEN contains(host, 'gujarat') THEN 0 WHEN regexp_matches(host, {_q(S.REGULATOR)}) THEN 1 WHEN host LIKE '%.gov.in' THEN 2 ELSE 3 END"
_SITES = f"WITH u AS (SELECT o_orderkey, o_custkey, {_URL} AS url FROM orders), s AS (SELECT *, {_HOST_OF.format(u='url')} AS host FROM u)"


@query(f"{_SITES} SELECT host, regexp_matches(host, {_q(S.OFFICIAL)}) AS official, {_WRONG} AS wrong_state, {_RULES} AS rules, {_RANK} AS rank, count(*) AS n FROM s GROUP BY ALL")
def q_source_sites(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr(_URL)
    told = table(spark, d, "orders").select(S.host(url).alias("host"), S.official(url).alias("official"), S.wrong_state(url).alias("wrong_state"), S.states_a_rule(url).alias("rules"), S.source_rank(url).alias("rank"))
    return told.groupBy(*told.columns).agg(F.count("*").alias("n"))


_SAID = """CASE (l_orderkey + l_linenumber) % 15 WHEN 0 THEN 'The fee is ' || l_partkey || ' rupees and must be paid by the applicant at the desk' WHEN 1 THEN 'The total cost of one unit is Rs. ' || l_partkey WHEN 2 THEN 'The mentor receives the fee of ' || l_partkey
 WHEN 3 THEN 'The certificate is issued within ' || l_suppkey || ' days' WHEN 4 THEN 'An appeal is disposed of within ' || l_suppkey || ' days' WHEN 5 THEN 'The applicant must be a resident of Bihar and hold a card' WHEN 6 THEN 'The scheme aims to help and the poor are eligible for it'
 WHEN 7 THEN 'Form No. II See rule ' || l_suppkey || ' Certificate of Registration of boats and nets' WHEN 8 THEN 'Registration Application License Application License Renew Application Application Registration License' WHEN 9 THEN 'Permits | Licences | every boat that is longer than ten metres must obtain a permit'
 WHEN 10 THEN 'Every boat longer than ten metres must obtain a permit of the board' WHEN 11 THEN 'Boats of Kerala and Tamil Nadu may apply here for the yearly permit' WHEN 12 THEN 'Gujarat and Kerala share it' WHEN 13 THEN 'West Bengal' ELSE 'Charges for the work are grants' END"""
_KINDS = "CASE (l_orderkey + l_linenumber) % 15 WHEN 0 THEN 'FEE' WHEN 1 THEN 'FEE' WHEN 2 THEN 'FEE' WHEN 14 THEN 'FEE' WHEN 3 THEN 'TIMELINE' WHEN 4 THEN 'TIMELINE' ELSE 'ELIGIBILITY' END"
_NAMED = "[" + ", ".join(f"CASE WHEN regexp_matches(t, {_q(rf'(?i)\b{s}\b')}) THEN {_q(s)} END" for s in S.STATES) + "]"


@query(f"""WITH f AS (SELECT {_SAID} AS t, {_KINDS} AS kind, l_linenumber % 4 > 0 AS given FROM lineitem), w AS (SELECT *, list_filter({_NAMED}, lambda x: x IS NOT NULL) AS states, regexp_extract_all(lower(t), '[a-z]{{4,}}') AS long FROM f)
 SELECT kind, kind = 'FEE' AND given AND regexp_matches(t, {_q(S.PAYS)}) AND {' AND '.join(f'NOT regexp_matches(t, {_q(p)})' for p in S.NO_FEE)} AS fee, kind = 'TIMELINE' AND given AND regexp_matches(t, {_q(S.TAKES)}) AND NOT regexp_matches(t, {_q(S.NO_WAIT)}) AS wait, kind = 'ELIGIBILITY' AND regexp_matches(t, {_q(S.QUALIFIES)}) AND NOT regexp_matches(t, {_q(S.NO_CRITERION)}) AS criterion,
 CASE WHEN NOT regexp_matches(t, {_q(S.HOME)}) AND len(states) = 1 THEN states[1] END AS other_state, length(t) >= 40 AND len(string_split_regex(t, '\\s+')) >= 8 AND regexp_matches(t, {_q(S.RULE_MARKER)}) AND NOT regexp_matches(t, {_q(S.FORM_ROW)}) AND NOT contains(t, '|') AND NOT (len(long) >= 8 AND len(list_distinct(long)) / len(long) < 0.65) AS sentence, count(*) AS n FROM w GROUP BY ALL""")
def q_fact_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind, claim = F.col("kind"), F.col("t")
    own = table(spark, d, "lineitem").select(F.expr(_SAID).alias("t"), F.expr(_KINDS).alias("kind"), F.when(F.col("l_linenumber") % 4 > 0, F.create_map(F.lit("amount"), F.lit("5"), F.lit("days"), F.lit("7"))).otherwise(F.create_map(F.lit("amount"), F.lit(""))).alias("detail"))
    told = own.select("kind", S.is_fee(kind, F.col("detail"), claim).alias("fee"), S.is_wait(kind, F.col("detail"), claim).alias("wait"), S.is_criterion(kind, claim).alias("criterion"), S.other_state(claim).alias("other_state"), S.is_sentence(claim).alias("sentence"))
    return told.groupBy(*told.columns).agg(F.count("*").alias("n"))


_CASES = f"""{_SITES}, g AS (SELECT o_custkey AS case_id, url, any_value(host) AS host, min(o_orderkey) AS pos FROM s WHERE regexp_matches(host, {_q(S.OFFICIAL)}) AND NOT ({_WRONG}) AND {_RULES} GROUP BY 1, 2),
 c AS (SELECT case_id, url, row_number() OVER (PARTITION BY case_id ORDER BY {_RANK}, pos, url) AS place, length(url) % 3 > 0 AS readable FROM g), r AS (SELECT *, count(*) FILTER (place <= 8 AND readable) OVER (PARTITION BY case_id) AS first FROM c WHERE place <= 16)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.expr(_URL).alias("url"), F.col("o_orderkey").alias("at"))


@query(f"{_CASES} SELECT case_id, url, place, readable FROM r WHERE place <= 8 OR first < 6")
def q_case_pages(spark: SparkSession, d: str) -> DataFrame:
    listed = R.candidates(_found(spark, d))
    pages = table(spark, d, "orders").select(F.expr(_URL).alias("url"), F.when(F.length(F.expr(_URL)) % 3 > 0, "text").otherwise("").alias("text"))
    return R.read(listed, pages)


_JUDGED = f"""WITH l AS (SELECT l_suppkey AS case_id, {_SAID} AS t, 'Permit ' || (l_partkey % 4) AS permission, CASE WHEN l_partkey % 3 = 0 THEN 'p' || (l_partkey % 4) END AS pid, 'h' || (l_orderkey % 3) AS host, CASE WHEN l_suppkey % 5 = 0 THEN '' WHEN l_suppkey % 5 = 1 THEN 'Over 5' WHEN l_linenumber % 2 = 0 THEN 'over  10 t' ELSE 'Over 10 T' END AS trigger, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
 k AS (SELECT * FROM l WHERE length(t) >= 40 AND len(string_split_regex(t, '\\s+')) >= 8 AND regexp_matches(t, {_q(S.RULE_MARKER)}) AND NOT regexp_matches(t, {_q(S.FORM_ROW)}) AND NOT contains(t, '|') AND NOT (len(regexp_extract_all(lower(t), '[a-z]{{4,}}')) >= 8 AND len(list_distinct(regexp_extract_all(lower(t), '[a-z]{{4,}}'))) / len(regexp_extract_all(lower(t), '[a-z]{{4,}}')) < 0.65)),
 e AS (SELECT case_id, coalesce(pid, lower(permission)) AS key, count(DISTINCT host) >= 2 AND count(DISTINCT nullif(trim(regexp_replace(lower(trigger), '\\s+', ' ', 'g')), '')) > 1 AS bad FROM k GROUP BY 1, 2), b AS (SELECT case_id, count(*) FILTER (bad) AS conflicts FROM e GROUP BY 1),
 a AS (SELECT case_id, count(*) AS claims, bool_or(trigger <> '') AS conditional FROM k GROUP BY 1), p AS (SELECT case_id, string_agg(permission, '|' ORDER BY mp, permission) AS permissions FROM (SELECT case_id, permission, min(pos) AS mp FROM k GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY min(pos), permission) <= 12) GROUP BY 1),
 j AS (SELECT c_custkey AS case_id, CASE WHEN claims IS NULL THEN 'UNVERIFIED' WHEN conflicts > 0 THEN 'CONFLICTING' WHEN conditional THEN 'VERIFIED' ELSE 'EXTRACTED_PENDING_REVIEW' END AS status, coalesce(claims, 0) AS claims, coalesce(conflicts, 0) AS conflicts, coalesce(permissions, '') AS permissions FROM customer LEFT JOIN a ON a.case_id = c_custkey LEFT JOIN b ON b.case_id = c_custkey LEFT JOIN p ON p.case_id = c_custkey)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey")
    trigger = F.when(k % 5 == 0, "").when(k % 5 == 1, "Over 5").when(F.col("l_linenumber") % 2 == 0, "over  10 t").otherwise("Over 10 T")
    claims = table(spark, d, "lineitem").select(
        k.alias("case_id"), F.expr(_SAID).alias("evidence"), F.concat(F.lit("Permit "), F.col("l_partkey") % 4).alias("permission"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("p"), F.col("l_partkey") % 4)).alias("permission_id"),
        F.concat(F.lit("h"), F.col("l_orderkey") % 3).alias("host"), F.lit("https://lake.gujarat.gov.in/r").alias("source_url"), trigger.alias("trigger"), F.lit("").alias("exemption"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
    )
    return R.judged(table(spark, d, "customer").select(F.col("c_custkey").alias("case_id")), R.standing(claims))


@query(f"{_JUDGED} SELECT * FROM j")
def q_case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).withColumn("permissions", F.array_join("permissions", "|"))


@query(f"{_JUDGED} SELECT count(*) AS cases, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status = 'CONFLICTING') AS conflicting, count(*) FILTER (status = 'EXTRACTED_PENDING_REVIEW') AS pending_review, count(*) FILTER (status = 'UNVERIFIED') AS unverified, sum(claims)::BIGINT AS claims FROM j")
def q_case_report(spark: SparkSession, d: str) -> DataFrame:
    return R.reported(_judged(spark, d))
