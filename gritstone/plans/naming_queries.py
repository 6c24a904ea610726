"""Queries on names: districts by longest match, types and names of offices, absorption, headings, protection, cached classes, generated searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritstone.functions import names as N
from gritstone.operators import naming as O
from gritstone.sources.tables import table

from .catalogue import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PATTERNS = [(p, c, i) for i, (p, c) in enumerate(N.district_patterns())]
_DICTIONARY = f"dictionary(pattern, code, place) AS (VALUES {', '.join(f'({_q(p)}, {_q(c)}, {i})' for p, c, i in _PATTERNS)})"
_HOST = "CASE c_custkey % 11 WHEN 0 THEN 'collectorkheda.gujarat.gov.example' WHEN 1 THEN 'gir-somnath.dept.example' WHEN 2 THEN 'devbhoomi-dwarka.example' WHEN 3 THEN 'ward' || c_custkey || 'dwarka.example' WHEN 4 THEN 'panchmahals' || (c_custkey % 5) || '.example' WHEN 5 THEN 'surat-anand.example' ELSE 'desk' || c_custkey || '.example' END"
_NAME = "CASE c_custkey % 8 WHEN 0 THEN 'Kheda Varsai Certificate ' || c_custkey WHEN 1 THEN 'Suratgarh Permit' WHEN 2 THEN 'Permit, Bhuj or Anand' WHEN 3 THEN 'Office ' || c_custkey || ': DANG' WHEN 4 THEN '' ELSE 'Permit ' || c_custkey END"


def _dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PATTERNS, "pattern string, code string, place int")


@query(f"""WITH {_DICTIONARY}, c AS (SELECT c_custkey, {_HOST} AS host, {_NAME} AS name FROM customer),
 h AS (SELECT c_custkey, code FROM c JOIN dictionary ON contains(regexp_replace(lower(host), '[^a-z]', '', 'g'), pattern) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(pattern) DESC, place) = 1),
 n AS (SELECT c_custkey, code FROM c JOIN dictionary ON contains(' ' || regexp_replace(lower(name), '[^a-z]+', ' ', 'g') || ' ', ' ' || pattern || ' ') QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(pattern) DESC, place) = 1)
 SELECT c_custkey, coalesce(h.code, 'IN-GJ') AS by_host, n.code AS by_name, CASE WHEN h.code IS NULL THEN 'Gujarat' ELSE array_to_string(list_transform(string_split(lower(replace(substr(h.code, 7), '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' district, Gujarat' END AS label FROM c LEFT JOIN h USING (c_custkey) LEFT JOIN n USING (c_custkey)""")
def q_districts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select("c_custkey", F.expr(_HOST).alias("host"), F.expr(_NAME).alias("name"))
    words = _dictionary(spark)
    host = O.longest_match(own.select(F.col("host").alias("text")), words, whole_words=False).toDF("host", "by_host")
    name = O.longest_match(own.select(F.col("name").alias("text")), words, whole_words=True).toDF("name", "by_name")
    told = own.join(host, "host", "left").join(name, "name", "left").withColumn("by_host", F.coalesce("by_host", F.lit(N.ROOT)))
    return told.select("c_custkey", "by_host", "by_name", N.scope_label(F.col("by_host")).alias("label"))


_TITLE = "CASE o_orderkey % 9 WHEN 0 THEN 'Home | Taluka Panchayat ' || o_custkey WHEN 1 THEN 'Mamlatdar Office' WHEN 2 THEN 'Lake News' WHEN 3 THEN 'Official Website of Lake Board :: Home' WHEN 4 THEN '' WHEN 5 THEN 'Police Station and Court' WHEN 6 THEN 'ab' ELSE 'Desk ' || o_custkey END"
_HEADING = "CASE o_orderkey % 7 WHEN 0 THEN 'Banner' WHEN 1 THEN 'Website Visits ' || o_custkey WHEN 2 THEN 'Lake  Board' WHEN 3 THEN '1234' WHEN 4 THEN 'Welcome to Lake' ELSE NULL END"
_PRINTED = "CASE o_orderkey % 6 WHEN 0 THEN 'Dr. Vale' WHEN 1 THEN 'Office Address' WHEN 2 THEN 'Lake  House ' || o_custkey WHEN 3 THEN 'abc' END"
_OBJECT = "CASE o_orderkey % 5 WHEN 0 THEN 'jan_seva_kendra_lake' WHEN 1 THEN 'phone' WHEN 2 THEN 'lake_house' END"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches({{c}}, {_q('(?i)' + p)}) THEN {_q(t)}" for p, t in N.OFFICE_TYPES) + " END"


def _bare(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), {_q(N.NAME_NOISE)}, '', 'g'), '\\s+', ' ', 'g'))"


_GOOD = f"length({{c}}) BETWEEN 4 AND 120 AND regexp_matches({{c}}, '\\p{{{{L}}}}') AND NOT regexp_matches({{c}}, {_q(N.NO_NAME).replace('{', '{{').replace('}', '}}')})"
_SCORE = f"(CASE WHEN regexp_matches({{c}}, {_q(N.BODY_WORD)}) THEN 2 ELSE 0 END - CASE WHEN regexp_matches({{c}}, '\\d{{{{2,}}}}') THEN 3 ELSE 0 END)"


@query(f"""WITH p AS (SELECT o_orderkey, {_TITLE} AS title, {_HEADING} AS heading, trim(regexp_replace({_PRINTED}, '\\s+', ' ', 'g')) AS printed, {_OBJECT} AS object FROM orders), b AS (SELECT *, {_bare('heading')} AS h, {_bare('title')} AS t, upper(object[1]) || replace(object[2:], '_', ' ') AS thing FROM p),
 s AS (SELECT *, {_GOOD.format(c='h')} AS hg, {_GOOD.format(c='t')} AS tg, {_SCORE.format(c='h')} AS hs, {_SCORE.format(c='t')} AS ts, length(printed) > 3 AND length(printed) < 120 AND NOT regexp_matches(printed, {_q(N.FIELD_LABEL)}) AND NOT printed LIKE 'Dr. %' AS pg, {_TYPE.format(c='thing')} AS ot, CASE WHEN length(title) > 4 THEN {_TYPE.format(c='title')} END AS tt FROM b)
 SELECT o_orderkey AS page_id, CASE WHEN hg AND (NOT tg OR hs >= ts) THEN h WHEN tg THEN t END AS body, CASE WHEN coalesce(pg, FALSE) THEN printed WHEN ot IS NOT NULL THEN thing ELSE tt END AS office, CASE WHEN coalesce(pg, FALSE) OR ot IS NOT NULL THEN 'EXTRACTED' WHEN tt IS NOT NULL THEN 'NORMALIZED' END AS status FROM s""")
def q_office_names(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), *(F.expr(e).alias(n) for n, e in (("title", _TITLE), ("heading", _HEADING), ("printed", _PRINTED), ("object", _OBJECT))))
    detail = F.map_filter(F.create_map(F.lit("name"), F.col("printed")), lambda _, v: v.isNotNull())
    told = own.select("page_id", N.read_name(F.col("heading"), F.col("title")).alias("body"), N.name_of(detail, F.col("object"), F.col("title")).alias("o"))
    return told.select("page_id", "body", F.col("o.name").alias("office"), F.col("o.status").alias("status"))


_ID = "replace(p_name, ' ', '_') || CASE p_partkey % 8 WHEN 0 THEN '_system' WHEN 1 THEN '_online_portal' WHEN 2 THEN '_scheme_form' WHEN 3 THEN '_for_rivers' WHEN 4 THEN '_for_rivers_online' ELSE '' END"
_FOUND = f"p_brand AS journey, CASE WHEN p_partkey % 17 = 0 THEN string_split(p_name, ' ')[2] ELSE {_ID} END AS id, 'alias ' || (p_size % 5) AS alias, p_partkey % 40 AS page, p_partkey AS place"
_SAME = ", ".join(map(_q, sorted(O.SAME_SERVICE)))
_GROUPS = f"""WITH f AS (SELECT {_FOUND} FROM part), i AS (SELECT journey, id, min(place) AS place FROM f GROUP BY 1, 2),
 a AS (SELECT s.journey, s.id, l.id AS into_id FROM i s JOIN i l ON l.journey = s.journey AND starts_with(l.id, s.id || '_') AND len(list_filter(string_split(substr(l.id, length(s.id) + 2), '_'), lambda w: w NOT IN ({_SAME}))) = 0 QUALIFY row_number() OVER (PARTITION BY s.journey, s.id ORDER BY length(l.id) DESC, l.place) = 1),
 y AS (SELECT journey, id FROM i WHERE (journey, id) NOT IN (SELECT (journey, id) FROM a)), w AS (SELECT journey, list_filter(string_split(id, '_'), lambda w: w NOT IN ({_SAME})) AS w FROM y),
 h AS (SELECT y.journey, y.id, count(*) AS under FROM y JOIN w ON w.journey = y.journey AND len(w.w) > 1 AND list_contains(w.w, y.id) WHERE NOT contains(y.id, '_') GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.when(F.col("p_partkey") % 17 == 0, F.get(F.split("p_name", " "), F.lit(1))).otherwise(F.expr(_ID))
    return table(spark, d, "part").select(F.col("p_brand").alias("journey"), id_.alias("id"), F.replace(id_, F.lit("_"), F.lit(" ")).alias("name"), F.expr("'alias ' || (p_size % 5)").alias("alias"), F.expr("p_partkey % 40").alias("page"), F.col("p_partkey").alias("place"))


@query(f"""{_GROUPS}, r AS (SELECT f.journey, coalesce(a.into_id, f.id) AS id, f.alias, f.page FROM f LEFT JOIN a USING (journey, id) UNION ALL SELECT journey, into_id, replace(id, '_', ' '), NULL FROM a)
 SELECT journey, id, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases, count(DISTINCT page) AS pages FROM r WHERE (journey, id) NOT IN (SELECT (journey, id) FROM h) GROUP BY 1, 2""")
def q_grouped_services(spark: SparkSession, d: str) -> DataFrame:
    return O.grouped_services(_found(spark, d))[0].select("journey", "id", F.array_join("aliases", ",").alias("aliases"), "pages")


@query(f"{_GROUPS} SELECT journey, id, under FROM h")
def q_headings(spark: SparkSession, d: str) -> DataFrame:
    return O.grouped_services(_found(spark, d))[1]


_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({c}), '''s\\b', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'SERVICE' ELSE 'OFFICE' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN 'node:' || s_suppkey ELSE 'service:part_' || s_suppkey END AS id, 'Part''s ' || (s_suppkey + 1) AS name, 'PART  ' || (s_suppkey + 2) AS official, 'part-' || (s_suppkey * 3) AS alias FROM supplier),
 t AS (SELECT id FROM n UNION SELECT 'service:' || {_SLUG.format(c='p')} FROM (SELECT unnest([name, official, alias]) AS p FROM n WHERE type = 'SERVICE')) SELECT p_partkey, 'part_' || p_partkey AS id FROM part WHERE 'service:part_' || p_partkey NOT IN (SELECT id FROM t)""")
def q_unprotected(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    nodes = table(spark, d, "supplier").select(F.when(k % 3 == 0, F.concat(F.lit("node:"), k)).otherwise(F.concat(F.lit("service:part_"), k)).alias("id"), F.when(k % 2 == 0, "SERVICE").otherwise("OFFICE").alias("type"), F.concat(F.lit("Part's "), k + 1).alias("name"), F.concat(F.lit("PART  "), k + 2).alias("official"), F.array(F.concat(F.lit("part-"), k * 3)).alias("aliases"))
    return O.unprotected(table(spark, d, "part").select("p_partkey", F.concat(F.lit("part_"), "p_partkey").alias("id")), nodes)


@query("""WITH p AS (SELECT DISTINCT p_name || ' ' || p_type AS phrase, length(p_name || p_type) AS n FROM part) SELECT phrase, CASE WHEN n % 3 = 0 THEN n % 2 = 0 WHEN n % 7 = 0 THEN NULL ELSE contains(phrase, 'ring') END AS document FROM p""")
def q_document_phrases(spark: SparkSession, d: str) -> DataFrame:
    phrases = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("phrase"))
    n = F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1  # one blank of a name stays
    cache = phrases.distinct().filter(n % 3 == 0).select("phrase", (n % 2 == 0).alias("document"), F.lit(1).alias("version"))
    ask = lambda asked: asked.select("phrase", F.when(n % 7 != 0, F.contains("phrase", F.lit("ring"))).alias("document"))
    return O.classified(phrases, cache, 1, ask, lambda fresh: fresh)


#: Words of dimensions for these queries, in two scripts.
_VOCABULARY = {"OFFICE": ["office", "address", "bureau"], "DOCUMENTS": ["अभिलेख", "documents", "papers"], "FEE": ["fee", "शुल्क"]}
_SCOPE = "CASE WHEN s_suppkey % 4 = 0 THEN 'IN-GJ-SURAT' WHEN s_suppkey % 4 = 1 THEN 'IN-GJ' END"
_SERVICE = "CASE s_suppkey % 5 WHEN 0 THEN 'income-tax_return  of the lake ' || s_suppkey WHEN 1 THEN 'Kheda Permit' WHEN 2 THEN 'Permit for Boats and Rafts on Lakes' ELSE 'Permit ' || s_suppkey END"
_FILL = "'for', 'of', 'the', 'and', 'or', 'in', 'to', 'a', 'an', 'on', 'at', 'by', 'from', 'with'"


@query(f"""WITH {_DICTIONARY}, v(dimension, head, other) AS (VALUES ('OFFICE', 'office', NULL), ('DOCUMENTS', 'documents', 'अभिलेख'), ('FEE', 'fee', 'शुल्क')),
 s AS (SELECT s_suppkey, trim(regexp_replace(regexp_replace({_SERVICE}, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name, {_SERVICE} AS raw, {_SCOPE} AS scope_id, s_nationkey FROM supplier),
 h AS (SELECT s_suppkey, code FROM s JOIN dictionary ON s_suppkey % 3 = 0 AND contains('collectorkhedaexample', pattern) QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY length(pattern) DESC, place) = 1),
 n AS (SELECT s_suppkey, code FROM s JOIN dictionary ON contains(' ' || regexp_replace(lower(raw), '[^a-z]+', ' ', 'g') || ' ', ' ' || pattern || ' ') QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY length(pattern) DESC, place) = 1),
 t AS (SELECT s.*, coalesce(CASE WHEN scope_id <> 'IN-GJ' THEN scope_id END, h.code, n.code) AS scope, array_to_string(list_slice(list_filter(string_split(name, ' '), lambda w: lower(w) NOT IN ({_FILL})), 1, 4), ' ') AS short, CASE WHEN s_suppkey % 2 = 0 THEN 'Desk ' || s_nationkey END AS near FROM s LEFT JOIN h USING (s_suppkey) LEFT JOIN n USING (s_suppkey)),
 q AS (SELECT s_suppkey, dimension, k, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS query, sc AS scope FROM (SELECT s_suppkey, dimension, unnest([1, 2, 3, 4, 5]) AS k, unnest([name || ' ' || head, CASE WHEN scope IS NOT NULL THEN name || ' ' || head END, name || ' ' || other, near || ' ' || short || ' ' || head, CASE WHEN lower(short) <> lower(name) THEN short || ' ' || head END]) AS q, unnest([scope, NULL, scope, scope, scope]) AS sc FROM t CROSS JOIN v) WHERE q IS NOT NULL)
 SELECT s_suppkey, dimension, row_number() OVER (PARTITION BY s_suppkey, dimension ORDER BY k) AS place, query, scope FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY s_suppkey, dimension, lower(query), scope ORDER BY k) = 1)""")
def q_search_queries(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("service_id"), F.expr(_SERVICE).alias("name"), F.expr(_SCOPE).alias("scope_id"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("https://desk.example/x"), F.lit("https://u@collectorkheda.example:8443/a"))).otherwise(F.array(F.lit("no url"))).alias("urls"), "s_nationkey")
    scopes = O.service_scopes(own, _dictionary(spark), N.ROOT)
    dst = F.concat(F.lit("o"), "s_nationkey")
    edges = own.filter("service_id % 2 = 0").select(F.col("service_id").alias("src"), F.explode(F.array(F.struct(F.lit("p").alias("dst"), F.lit(0).alias("place")), F.struct(dst.alias("dst"), F.lit(1).alias("place")))).alias("e")).select("src", "e.*")
    nodes = table(spark, d, "nation").select(F.concat(F.lit("o"), "n_nationkey").alias("id"), F.lit("OFFICE").alias("type"), F.concat(F.lit("desk_"), "n_nationkey").alias("name"), F.concat(F.lit("Desk "), "n_nationkey").alias("official")).union(table(spark, d, "nation").limit(1).select(F.lit("p"), F.lit("DOCUMENT"), F.lit("lake.gov.example"), F.lit("")))
    missing = own.select("service_id", "name", F.explode(F.array(*map(F.lit, _VOCABULARY))).alias("dimension"))
    return O.queries_for(missing, scopes, O.neighbours(edges, nodes), _VOCABULARY).withColumnRenamed("service_id", "s_suppkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'GIR SOMNATH' || chr(10) WHEN c_custkey % 3 = 1 THEN 'IN-GJ' || chr(10) ELSE '' END || CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment || chr(10) ELSE '' END || c_name AS text FROM customer""")
def q_index_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    scope = F.when(k % 3 == 0, "IN-GJ-GIR_SOMNATH").when(k % 3 == 1, "IN-GJ")
    return table(spark, d, "customer").select(k, N.index_text(scope, F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.col("c_name")).alias("text"))
