"""Queries on sentences and lines of pages: named offices, authorities and outputs, stages, grouped lists, procedures, kinds of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gritstone.functions import blocks as B, claims as C
from gritstone.sources.tables import table

from .catalogue import query


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_K = "l_orderkey * 10 + l_linenumber"
#: A sentence for each line item, in SQL that both engines read.
_CLAIM = """CASE (l_orderkey * 10 + l_linenumber) % 21
 WHEN 0 THEN 'The Ward ' || l_suppkey || ' Board office is located at Block ' || l_partkey WHEN 1 THEN 'Forms must be submitted at the Jan Seva Kendra ' || l_suppkey || ', first floor'
 WHEN 2 THEN 'The permit will be issued by the Ward ' || l_suppkey || ' Inspector within ' || l_partkey || ' days' WHEN 3 THEN 'The plan is verified by the Zone ' || l_suppkey || ' Committee or the Council'
 WHEN 4 THEN 'It must be obtained from a prescribed officer' WHEN 5 THEN 'The Ward ' || l_suppkey || ' Board issues the trade licence' WHEN 6 THEN 'Mr. Vale Officer verifies all papers'
 WHEN 7 THEN 'The applicant receives a ''Sanction Letter ' || l_suppkey || ''' and can claim assistance' WHEN 8 THEN 'A trade licence ' || l_partkey || ' will be issued online after approval'
 WHEN 9 THEN 'On successful approval of form ' || l_partkey || ' a passbook is generated' WHEN 10 THEN 'The applicant will receive assistance' WHEN 11 THEN 'The contact information for the site ' || l_suppkey || ' is at the door'
 WHEN 12 THEN 'Visit the counter with original papers' WHEN 13 THEN 'Click continue' WHEN 14 THEN 'Track the status of form ' || l_partkey WHEN 15 THEN 'Verification by the Registrar ' || l_suppkey || ' / Talati is needed'
 WHEN 16 THEN 'Keep ready your papers' WHEN 17 THEN 'Main office of the Ward ' || l_suppkey || ' Council at Room ' || l_partkey || ' is based in town' WHEN 18 THEN 'The seal is approved by the Ward ' || l_suppkey || ' Council'
 WHEN 19 THEN 'The applicant gets either the card or a letter' ELSE 'Ward ' || l_suppkey || ' Directorate''s address is not told' END"""
_CLAIMS = f"WITH c AS (SELECT {_K} AS k, l_suppkey % 2 = 0 AS active, {_CLAIM} AS claim FROM lineitem)"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.expr(_K).alias("k"), F.expr("l_suppkey % 2 = 0").alias("active"), F.expr(_CLAIM).alias("claim"))


def _read(claims: DataFrame, reading: Column) -> DataFrame:
    """k, told of the claims that a rule reads. The reading is made into rows, so that the filter takes what was read instead of reading again."""
    return claims.select("k", F.inline(F.array(reading))).filter("read").select("k", "told")


def _sql_cut(column: str, tails: tuple) -> str:
    for pattern, _ in tails:
        column = f"regexp_replace({column}, {_q(pattern)}, '')" if not pattern.startswith("^['") else f"regexp_replace({column}, {_q(pattern)}, '', 'g')"
    return f"trim(regexp_replace({column}, '\\s{{2,}}', ' ', 'g'))"


def _sql_person(c: str) -> str:
    return f"(regexp_matches({c}, {_q(C.HONORIFIC)}) OR regexp_matches({c}, {_q(C.CADRE)}))"


@query(f"""{_CLAIMS}, r AS (SELECT k, CASE WHEN regexp_matches(claim, {_q(C._LOCATED)}) THEN coalesce(nullif(regexp_extract(claim, {_q(C._LOCATED)}, 1), ''), nullif(regexp_extract(claim, {_q(C._LOCATED)}, 2), ''), regexp_extract(claim, {_q(C._LOCATED)}, 3)) ELSE regexp_extract(claim, {_q(C._SUBMIT)}, 1) END AS raw FROM c),
 n AS (SELECT k, raw, {_sql_cut('raw', C._OFFICE_TAILS)} AS office FROM r WHERE regexp_matches(raw, {_q(C.PLACE_WORD)})) SELECT k, office FROM n WHERE length(office) > 3""")
def q_claim_offices(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).select("k", C.office_of(F.col("claim")).alias("office")).filter("office is not null")


_RULES = " ".join(f"WHEN {'TRUE' if rules is C.PASSIVE else 'active'} AND regexp_matches(claim, {_q(p)}) THEN {i}" for i, (rules, p) in enumerate((rs, p) for rs in (C.PASSIVE, C.ACTIVE) for _, p in rs))
_RAW = " ".join(f"WHEN {i} THEN regexp_extract(claim, {_q(p)}, 1)" for i, (_, p) in enumerate((*C.PASSIVE, *C.ACTIVE)))
_TYPE = " ".join(f"WHEN {i} THEN '{kind}'" for i, (kind, _) in enumerate((*C.PASSIVE, *C.ACTIVE)))


@query(f"""{_CLAIMS}, m AS (SELECT *, CASE {_RULES} END AS rule FROM c), r AS (SELECT *, trim(CASE rule {_RAW} END) AS raw FROM m WHERE rule IS NOT NULL), n AS (SELECT *, {_sql_cut('raw', ((C._CONDITION_TAIL, ''),))} AS name FROM r),
 g AS (SELECT *, NOT regexp_matches(raw, {_q(C.SEVERAL)}) AND NOT regexp_matches(raw, {_q(C.UNNAMED)}) AND length(name) >= 4 AND NOT {_sql_person('name')} AND (regexp_matches(name, {_q(C.PLACE_WORD)}) OR regexp_matches(name, {_q(C.OFFICER_WORD)})) AS good FROM n)
 SELECT k, CASE WHEN good THEN CASE rule {_TYPE} END END AS type, CASE WHEN good THEN name END AS authority, NOT good AS refused FROM g""")
def q_claim_authorities(spark: SparkSession, d: str) -> DataFrame:
    told = _read(_claims(spark, d), C.authority_read(F.col("claim"), F.col("active")))
    return told.select("k", "told.type", "told.authority", F.col("told").isNull().alias("refused"))


_OUT_STEPS = ", ".join(f"r{i} AS (SELECT *, trim(regexp_extract(claim, {_q(p)}, 1)) AS w{i} FROM {'c' if not i else f'n{i - 1}'}), n{i} AS (SELECT *, {_sql_cut(f'w{i}', C._OUTPUT_TAILS)} AS n{i} FROM r{i})" for i, (_, p) in enumerate(C.OUTPUT))
_OUT_GOOD = " ".join(f"WHEN NOT regexp_matches(w{i}, {_q(C.SEVERAL)}) AND length(n{i}) >= 4 AND NOT {_sql_person(f'n{i}')} AND regexp_matches(n{i}, {_q(C.OUTPUT_NOUN)}) AND NOT regexp_matches(n{i}, {_q(C.NO_OUTPUT)}) THEN n{i}" for i in range(len(C.OUTPUT)))
_OUT_READ = " OR ".join(f"regexp_matches(claim, {_q(p)})" for _, p in C.OUTPUT)


@query(f"""{_CLAIMS}, {_OUT_STEPS} SELECT k, CASE {_OUT_GOOD} END AS output, CASE {_OUT_GOOD} END IS NULL AS refused FROM n{len(C.OUTPUT) - 1} WHERE {_OUT_READ}""")
def q_claim_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _read(_claims(spark, d), C.output_read(F.col("claim"))).select("k", F.col("told").alias("output"), F.col("told").isNull().alias("refused"))


_DIMENSION = "CASE l_linenumber WHEN 1 THEN 'ELIGIBILITY' WHEN 2 THEN 'DOCUMENTS' WHEN 3 THEN 'OFFICE' WHEN 4 THEN 'ACTIONS' WHEN 5 THEN 'OUTPUT' WHEN 6 THEN 'HELPLINE' END"


@query(f"""WITH c AS (SELECT {_DIMENSION} AS dimension, {_CLAIM} AS claim FROM lineitem) SELECT CASE WHEN dimension IN ('ELIGIBILITY') THEN 'ELIGIBILITY' WHEN dimension = 'DOCUMENTS' THEN 'PREPARE' WHEN dimension = 'OFFICE' THEN 'IN_PERSON' WHEN dimension = 'OUTPUT' THEN 'AFTER_SUBMISSION' WHEN dimension = 'HELPLINE' THEN 'HELP'
 {' '.join(f"WHEN regexp_matches(claim, {_q(p)}) THEN '{s}'" for s, p in C.STAGE_VERBS)} ELSE 'APPLY' END AS stage, regexp_matches(claim, {_q(C._MICRO)}) AS micro, count(*) AS n FROM c GROUP BY 1, 2""")
def q_claim_stages(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "lineitem").select(F.expr(_DIMENSION).alias("dimension"), F.expr(_CLAIM).alias("claim"))
    return told.select(C.stage_of(F.col("dimension"), F.col("claim")).alias("stage"), C.is_micro(F.col("claim")).alias("micro")).groupBy("stage", "micro").agg(F.count("*").alias("n"))


_KIND = "CASE WHEN l_orderkey % 3 = 0 OR l_linenumber = 1 THEN CASE l_orderkey % 4 WHEN 0 THEN 'OFFICE' WHEN 1 THEN 'HELPLINE' WHEN 2 THEN 'TRACKING' ELSE 'APP' END ELSE 'ACTION' END"
_URL = "'https://h' || (o_orderkey % 7) || '.example' || CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/Home.html' WHEN 3 THEN '/a/b.PDF' WHEN 4 THEN '/faq/1' ELSE '/page/' || o_orderkey END"
_TITLE = "CASE o_orderkey % 11 WHEN 0 THEN 'Complaint desk' WHEN 1 THEN 'User Manual' WHEN 2 THEN 'Frequent Questions' ELSE 'Page ' || o_orderkey END"


@query(f"""WITH f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER ({_KIND} = 'OFFICE') AS o, count(*) FILTER ({_KIND} = 'HELPLINE') AS h, count(*) FILTER ({_KIND} = 'TRACKING') AS t, count(*) FILTER ({_KIND} = 'APP') AS a FROM lineitem GROUP BY 1),
 p AS (SELECT o_orderkey, lower(regexp_replace({_URL}, '^https?://[^/]+', '')) AS path, lower({_TITLE}) AS title, n, o, h, t, a FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
 SELECT o_orderkey AS page_id, CASE WHEN path LIKE '%.pdf' THEN 'PDF' WHEN regexp_matches(path || ' ' || title, 'faq|question') THEN 'FAQ' WHEN regexp_matches(path || ' ' || title, 'grievance|complaint') THEN 'GRIEVANCE_PAGE' WHEN regexp_matches(path || ' ' || title, 'guideline|instruction|manual|circular') THEN 'GUIDELINE'
  WHEN path IN ('', '/') OR regexp_matches(path, '^/(index|home|default)\\b') THEN 'PORTAL_HOME' WHEN o > 0.6 * n THEN 'OFFICE_DIRECTORY' WHEN h > 0.6 * n THEN 'HELPLINE' WHEN t > 0.6 * n THEN 'TRACKING_PAGE' WHEN a > 0.6 * n THEN 'MOBILE_APP_INFO' ELSE 'SERVICE_PAGE' END AS type FROM p""")
def q_source_types(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.expr(_KIND)).alias("kinds"))  # a page's facts
    pages = table(spark, d, "orders").select("o_orderkey", F.expr(_URL).alias("url"), F.expr(_TITLE).alias("title")).join(kinds, "o_orderkey", "left")
    return pages.select(F.col("o_orderkey").alias("page_id"), C.source_type(F.col("url"), F.col("title"), F.coalesce("kinds", F.array())).alias("type"))


#: Lines that a line item adds to its order's page, in SQL that both engines read.
_LINES = """CASE (l_orderkey + l_linenumber * 3) % 10 WHEN 0 THEN 'Submit any one of the following:' || chr(10) || '  - Proof ' || l_partkey || chr(10) || '(b) Card ' || l_suppkey WHEN 1 THEN '• Paper ' || l_partkey WHEN 2 THEN 'At least two of the following' || chr(10) || '1. Bill ' || l_suppkey
 WHEN 3 THEN '' WHEN 4 THEN 'Read more' WHEN 5 THEN '– Deed ' || l_partkey || chr(10) || '   c) Plan' WHEN 6 THEN 'All of the following are needed' WHEN 7 THEN 'Photo ' || l_suppkey || chr(10) || repeat('long ', 20 + l_suppkey % 8) WHEN 8 THEN 'one of the following cards' || chr(10) || 'Card A' ELSE '** Map ' || l_partkey END"""


def _texts(spark: SparkSession, d: str, lines: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", F.expr(lines).alias("s"), "l_partkey")))  # an order's items, a handful
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "\n").alias("text"))


_PAGE = "WITH t AS (SELECT l_orderkey AS page_id, string_agg({lines}, chr(10) ORDER BY l_linenumber, {lines}, l_partkey) AS text FROM lineitem GROUP BY 1), l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM t)"
_HEAD_CASE = "CASE " + " ".join(f"WHEN regexp_matches({{c}}, {_q(p)}) THEN {i}" for i, (p, _, _) in enumerate(B.HEADS)) + " END"
_HEAD_TOLD = " ".join(f"WHEN {i} THEN {{}}" for i in range(len(B.HEADS)))


@query(f"""{_PAGE.format(lines=_LINES)}, m AS (SELECT *, trim(regexp_replace(regexp_replace(line, '^[\\s•\\-*·–—o]+', ''), '(?i)^\\(?[a-z0-9]{{1,3}}[).]\\s*', '')) AS member FROM l),
 s AS (SELECT *, CASE WHEN length(line) <= 160 THEN {_HEAD_CASE.format(c='line')} END AS head, member = '' OR length(member) > 120 OR regexp_matches(member, {_q(B.NO_MEMBER)}) OR {_HEAD_CASE.format(c='member')} IS NOT NULL AS ends FROM m),
 e AS (SELECT h.page_id, h.line_no, h.head, h.line, least(coalesce(min(n.line_no) FILTER (n.ends), h.line_no + 16), h.line_no + 16, max(z.last) + 1) AS stop FROM s h JOIN (SELECT page_id, max(line_no) AS last FROM s GROUP BY 1) z ON z.page_id = h.page_id LEFT JOIN s n ON n.page_id = h.page_id AND n.line_no > h.line_no WHERE h.head IS NOT NULL GROUP BY h.page_id, h.line_no, h.head, h.line)
 SELECT e.page_id, e.line_no, trim(e.line) AS head, CASE e.head {_HEAD_TOLD.format(*(f"'{m}'" for _, m, _ in B.HEADS))} END AS mode, (CASE e.head {_HEAD_TOLD.format(*(n for _, _, n in B.HEADS))} END)::INT AS minimum, string_agg(s.member, '|' ORDER BY s.line_no) AS members, trim(e.line || chr(10) || string_agg(s.line, chr(10) ORDER BY s.line_no), chr(10) || ' ') AS evidence
 FROM e JOIN s ON s.page_id = e.page_id AND s.line_no > e.line_no AND s.line_no < e.stop GROUP BY e.page_id, e.line_no, e.line, e.head HAVING count(*) >= 2""")
def q_requirement_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = _texts(spark, d, _LINES).select("page_id", F.explode(B.requirement_blocks(F.col("text"))).alias("b"))
    return found.select("page_id", "b.line_no", "b.head", "b.mode", "b.minimum", F.array_join("b.members", "|").alias("members"), "b.evidence")


_STEPS = """CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN 'How to apply' || chr(10) || '1. Fill the form ' || l_partkey WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 3 = 1 THEN 'Step 1: Submit form ' ELSE '(1) Rules of plot ' END || l_partkey
 WHEN l_orderkey % 11 = 0 AND l_linenumber = 3 THEN '7. Pay late' WHEN l_orderkey % 13 = 0 AND l_linenumber = 2 THEN '2. Is it open on day ' || l_partkey || '?' WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN 'Some note' || chr(10) || l_linenumber || ') Pay the fee ' || l_suppkey || ';' WHEN l_linenumber = 4 AND l_orderkey % 2 = 0 THEN '4. The rule applies' || chr(10) || '1.2 Outline' ELSE l_linenumber || '. Visit the desk ' || l_suppkey END"""
_NUM = f"coalesce(nullif(regexp_extract(line, {_q(B._NAMED_STEP)}, 1), ''), nullif(regexp_extract(line, '^\\s*(?:\\*\\*)?\\(?(\\d{{1,2}})\\)?\\s*[).:\\-]\\s*[^\\d.\\s]', 1), ''))::INT"
_BODY = f"trim(regexp_replace(regexp_replace(line, {_q(B._NAMED_STEP)}, ''), '^\\s*(?:\\*\\*)?\\(?(\\d{{1,2}})\\)?\\s*[).:\\-]\\s*([^\\d.\\s])', '\\2'))"


@query(f"""{_PAGE.format(lines=_STEPS)}, m AS (SELECT *, {_NUM} AS n, {_BODY} AS label FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS k FROM m WHERE n IS NOT NULL),
 j AS (SELECT a.page_id, a.line_no AS first, b.k, b.line_no, b.n, b.label, b.line, bool_and(b.n = b.k - a.k + 1 AND b.line_no < a.line_no + 200) OVER (PARTITION BY a.page_id, a.line_no ORDER BY b.k) AS fits FROM r a JOIN r b ON b.page_id = a.page_id AND b.k >= a.k WHERE a.n = 1),
 g AS (SELECT page_id, first, count(*) AS steps, bool_and(length(label) BETWEEN 8 AND 240 AND NOT regexp_matches(label, {_q(B._QUESTION)})) AS fair, avg(regexp_matches(label, {_q(B.INSTRUCTION)})::INT) AS share FROM j WHERE fits GROUP BY 1, 2),
 h AS (SELECT g.*, (SELECT coalesce(bool_or(regexp_matches(line, {_q(B.PROCESS)})), FALSE) FROM l WHERE l.page_id = g.page_id AND l.line_no < g.first AND l.line_no >= g.first - 8) AS headed FROM g),
 w AS (SELECT page_id, min(first) AS first FROM h WHERE steps >= 3 AND fair AND CASE WHEN headed THEN share >= 0.6 ELSE share = 1 END GROUP BY 1)
 SELECT j.page_id, j.n, regexp_matches(j.line, {_q(B._NAMED_STEP)}) AS explicit, left(regexp_replace(regexp_replace(j.label, '\\s+', ' ', 'g'), '[.;:,]\\s*$', ''), 90) AS label, trim(j.line) AS evidence FROM j JOIN w USING (page_id, first) WHERE fits""")
def q_page_steps(spark: SparkSession, d: str) -> DataFrame:
    found = _texts(spark, d, _STEPS).select("page_id", F.explode(B.page_steps(F.col("text"))).alias("s"))
    return found.select("page_id", "s.n", "s.explicit", B.step_label(F.col("s.label")).alias("label"), "s.evidence")


_EVIDENCE = """CASE WHEN l_orderkey % 5 = 0 THEN 'Step ' || l_linenumber || ' - Submit form ' || l_partkey WHEN l_orderkey % 17 = 0 AND l_linenumber = 2 THEN '2) Which form?' WHEN l_orderkey % 19 = 0 THEN '1) Pay fee' WHEN l_orderkey % 23 = 0 AND l_linenumber = 3 THEN 'Step 3: Collect it' WHEN l_orderkey % 6 = 0 THEN '(' || l_linenumber || ') Clause ' || l_partkey ELSE l_linenumber || ') Visit desk ' || l_suppkey END"""


@query(f"""WITH f AS (SELECT l_orderkey AS page_id, l_orderkey * 10 + l_linenumber AS fact_id, l_partkey, l_suppkey, {_EVIDENCE} AS e FROM lineitem WHERE l_returnflag <> 'R'),
 m AS (SELECT page_id, fact_id, l_suppkey, l_partkey, starts_with(e, 'Step') AS named, regexp_extract(e, '(\\d+)', 1)::INT AS n, regexp_replace(e, '^(Step \\d+|\\(?\\d+\\))[\\s:.\\-)]*', '') AS label FROM f),
 w AS (SELECT page_id, count(*) AS k, bool_or(regexp_matches(label, {_q(B._QUESTION)})) AS asks, bool_and(named) AS a, bool_or(named) AS s FROM m GROUP BY 1), u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id, n ORDER BY fact_id, label) = 1),
 r AS (SELECT page_id, count(*) AS steps, min(n) AS lo, max(n) AS hi, avg(regexp_matches(label, {_q(B.INSTRUCTION)})::INT) AS share FROM u GROUP BY 1)
 SELECT u.page_id, u.n, u.label, count(*) AS facts FROM u JOIN r USING (page_id) JOIN w USING (page_id) WHERE k >= 3 AND NOT asks AND steps >= 3 AND lo = 1 AND hi = steps AND (a OR NOT s) AND share >= 0.6 GROUP BY ALL""")
def q_ordered_steps(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.expr(_K).alias("fact_id"), F.expr("CASE WHEN l_returnflag = 'R' THEN 'FEE' ELSE 'ACTION' END").alias("kind"), F.lit("").alias("claim"), F.expr(_EVIDENCE).alias("evidence"))
    return B.ordered_steps(facts).groupBy("page_id", "n", "label").agg(F.count("*").alias("facts"))
