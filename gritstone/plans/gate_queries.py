"""Queries on gates, matching and upkeep: geocodes, intents, page text, probes, cycles and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gritstone.functions import fields as X, text as T
from gritstone.operators import geo, graphs, search
from gritstone.sources.tables import table, upserted

from .catalogue import SQL, query
from .text_queries import lines_sql

_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"""WITH p AS (SELECT l_orderkey, (l_suppkey * 37) % 120 - 60.0 AS lat, (l_suppkey * 91) % 300 - 150.0 AS lon FROM lineitem),
 far AS (SELECT a.l_orderkey, max({_KM}) AS km FROM p a JOIN p b USING (l_orderkey) GROUP BY 1)
 SELECT l_orderkey, round(km, 4) AS km, CASE WHEN km <= 2 THEN 'DERIVED_MEDIUM' ELSE 'NEEDS_REVIEW' END AS status FROM far JOIN (SELECT l_orderkey FROM p GROUP BY 1 HAVING count(*) >= 2) USING (l_orderkey)""")
def q_conflict_distance(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_suppkey")
    points = table(spark, d, "lineitem").select("l_orderkey", F.struct(((s * 37) % 120 - 60.0).alias("lat"), ((s * 91) % 300 - 150.0).alias("lon")).alias("point"))
    groups = points.groupBy("l_orderkey").agg(F.collect_list("point").alias("points")).filter("size(points) >= 2")  # an order has a few lines
    rows = groups.select("l_orderkey", geo.widest_km(F.col("points")).alias("km"))
    return rows.select("l_orderkey", F.round("km", 4).alias("km"), geo.reconciled(F.col("km")).alias("status"))


@query("""WITH c AS (SELECT c_custkey, 5 + (c_custkey * 37 % 340) / 10.0 AS lat, 66 + (c_custkey * 91 % 330) / 10.0 AS lon, CASE c_nationkey % 4 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS state_ok,
 CASE WHEN c_custkey % 11 = 0 THEN 'centroid' WHEN c_custkey % 3 = 0 THEN 'pinpoint' ELSE 'street' END AS kind, (c_custkey % 13) / 100.0 AS span, c_custkey % 7 <> 0 AS pin_ok, c_custkey % 5 <> 0 AS district_ok, c_acctbal < 0 AS backed_off FROM customer)
 SELECT c_custkey, CASE WHEN NOT (lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98) OR NOT state_ok THEN 'REJECTED' WHEN state_ok IS NULL THEN 'NEEDS_REVIEW' WHEN kind = 'centroid' OR span > 0.1 THEN 'REJECTED'
  WHEN NOT pin_ok OR NOT district_ok THEN 'NEEDS_REVIEW' WHEN backed_off THEN 'DERIVED_MEDIUM' WHEN kind = 'pinpoint' THEN 'DERIVED_HIGH' ELSE 'DERIVED_MEDIUM' END AS status FROM c""")
def q_geocode_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    state_ok = F.when(F.col("c_nationkey") % 4 == 0, False).when(F.col("c_nationkey") % 4 == 1, None).otherwise(True)
    kind = F.when(k % 11 == 0, "centroid").when(k % 3 == 0, "pinpoint").otherwise("street")
    status = geo.graded(5 + (k * 37 % 340) / 10.0, 66 + (k * 91 % 330) / 10.0, state_ok, kind, (k % 13) / 100.0, k % 7 != 0, k % 5 != 0, F.col("c_acctbal") < 0, box=(6, 38, 68, 98))
    return table(spark, d, "customer").select("c_custkey", status.alias("status"))


_PEEL = "SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 1"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_PEEL}), sup AS (SELECT DISTINCT a.src AS s, c.dst AS t FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.src LIKE 's%'),
 far AS (SELECT s, t FROM sup UNION SELECT f.s, h.t FROM far f JOIN sup h ON h.s = f.t), ring AS (SELECT DISTINCT s FROM far WHERE s = t),
 fore AS (SELECT s FROM ring UNION SELECT t FROM far WHERE s IN (SELECT s FROM ring)), aft AS (SELECT s FROM ring UNION SELECT s FROM far WHERE t IN (SELECT s FROM ring)),
 p1 AS (SELECT DISTINCT dst AS n FROM e WHERE src IN (SELECT s FROM fore)), o1 AS (SELECT DISTINCT dst AS n FROM e WHERE src IN (SELECT n FROM p1)),
 o2 AS (SELECT DISTINCT src AS n FROM e WHERE dst IN (SELECT s FROM aft)), p2 AS (SELECT DISTINCT src AS n FROM e WHERE dst IN (SELECT n FROM o2)),
 fed AS (SELECT s AS n FROM fore UNION SELECT n FROM p1 UNION SELECT n FROM o1), led AS (SELECT s AS n FROM aft UNION SELECT n FROM p2 UNION SELECT n FROM o2)
 SELECT src, dst FROM e WHERE src IN (SELECT n FROM fed) AND dst IN (SELECT n FROM led)""")
def q_cycle_peel(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("o"), "l_orderkey").alias("o"), "l_quantity")
    edges = li.select(F.col("s").alias("src"), F.col("p").alias("dst")).union(li.select("p", "o")).union(li.filter("l_quantity = 1").select("o", "s"))
    return graphs.cyclic(edges)


_ASKED = [(1, "i want the small ring"), (2, "red widgett and a bolt please"), (3, "economy"), (4, "purple widget gadget or cum ring"), (5, "help with nothing at all"), (6, "green gadgets promo"), (7, "standrd blue bolt bolt")]
_STOP = "', '".join(X.STOPWORDS)


def _words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}\\p{{M}}'']+'), lambda t: length(t) > 1 AND t NOT IN ('{_STOP}'))"


@query(f"""WITH svc AS (SELECT p_name AS id, p_name AS name, [p_name, lower(min(p_type)), split_part(p_name, ' ', 2) || ' for ' || lower(max(p_type))] AS phrases FROM part GROUP BY p_name),
 ph AS (SELECT id, unnest(phrases) AS phrase, unnest(range(3)) AS at_ FROM svc), wd AS (SELECT id, at_, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT id, at_, {_words_sql('phrase')} AS w FROM ph)),
 own AS (SELECT id, word, min(at_ * 1000 + pos) AS ord FROM wd GROUP BY ALL), st AS (SELECT CASE WHEN length(word) > 3 AND word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END AS stem, count(DISTINCT id) AS df FROM own GROUP BY 1), cat AS (SELECT stem, df, df > greatest(2, (SELECT count(*) FROM svc) * 0.1) AS common FROM st),
 qs AS (SELECT qid, unnest(w) AS token, unnest(range(len(w))) AS q, len(w) AS n FROM (SELECT qid, {_words_sql('t')} AS w FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in _ASKED)}) v(qid, t))), tk AS (SELECT * FROM qs WHERE token NOT IN ('and', 'or', 'amp', 'cum')),
 h AS (SELECT qid, q, n, id, 0 AS how, -1 AS ord, token AS word FROM tk JOIN (SELECT DISTINCT id, lower(phrase) AS phrase FROM ph) ON phrase = token UNION ALL SELECT qid, q, n, id, 1, ord, word FROM tk JOIN own ON word = token UNION ALL SELECT qid, q, n, id, 2, ord, word FROM tk JOIN own ON length(word) >= 6 AND length(token) >= 6 AND levenshtein(word, token) = 1),
 b AS (SELECT qid, q, id, n, min(how) AS how, arg_min(word, how * 100000 + ord) AS word FROM h GROUP BY qid, q, id, n),
 sc AS (SELECT qid, id, n, sum(CASE WHEN how = 0 THEN 2 ELSE 1 END) AS score, bool_or(NOT coalesce(common, FALSE)) AS telling, round(sum(1.0 / coalesce(df, 1)), 6) AS rarity FROM b LEFT JOIN cat ON stem = CASE WHEN length(word) > 3 AND word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END GROUP BY ALL),
 nm AS (SELECT qid, id, max(asked / words) AS named FROM (SELECT qid, wd.id, at_, count(*) AS asked FROM wd JOIN (SELECT DISTINCT qid, id, word FROM b) USING (id, word) GROUP BY ALL) JOIN (SELECT id, at_, count(*) AS words FROM wd GROUP BY ALL) USING (id, at_) GROUP BY ALL)
 SELECT qid, id, round(least(1.0, score / n), 6) AS confidence, rarity, row_number() OVER (PARTITION BY qid ORDER BY round(least(1.0, score / n), 6) DESC, rarity DESC, id) AS rank FROM sc JOIN nm USING (qid, id) WHERE telling AND named > 0.5 AND round(least(1.0, score / n), 6) >= 0.3 QUALIFY rank <= 5""")
def q_intent_match(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").groupBy("p_name").agg(F.lower(F.min("p_type")).alias("low"), F.lower(F.max("p_type")).alias("high"))
    services = parts.select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.array("p_name", "low", F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" for "), "high")).alias("phrases"))
    return search.matched(services, spark.createDataFrame(_ASKED, "qid int, text string"))


#: What each of the questions means, null for nothing.
_WANT = [(1, "small ring"), (2, "red widget"), (3, "small ring"), (5, None), (7, "blue bolt")]


@query(SQL["q_intent_match"].replace("WITH svc AS", "WITH want(qid, want) AS (VALUES (1, 'small ring'), (2, 'red widget'), (3, 'small ring'), (5, NULL), (7, 'blue bolt')), svc AS", 1).replace(" SELECT qid, id, round(least", ", told AS (SELECT qid, id, round(least", 1) + ") SELECT count(*) AS cases, count(*) FILTER (want IS NOT DISTINCT FROM id) AS hits FROM want LEFT JOIN (SELECT qid, id FROM told WHERE rank = 1) USING (qid)")
def q_intent_eval(spark: SparkSession, d: str) -> DataFrame:
    first = q_intent_match(spark, d).filter("rank = 1").select("qid", "id")
    return spark.createDataFrame(_WANT, "qid int, want string").join(first, "qid", "left").agg(F.count("*").alias("cases"), F.count_if(F.col("want").eqNullSafe(F.col("id"))).alias("hits"))


@query(f"SELECT page_id, len(kept) AS n_lines, md5(array_to_string(kept, chr(10))) AS digest FROM (SELECT page_id, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS kept FROM (SELECT page_id, {lines_sql('html')} AS l FROM pages))")
def q_html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.lines(F.col("html")).alias("l")).select("page_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query(r"SELECT probe, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM (SELECT conv_id, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')))[1:32] AS probe FROM conversations WHERE role = 'user') GROUP BY 1")
def q_input_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", T.input_hash(F.col("text")).alias("probe"))
    return rows.groupBy("probe").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


@query(r"SELECT host, count(DISTINCT section) AS sections, count(DISTINCT section) <= 5 AS identifying FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([^/?#]*)', 1) AS section FROM pages) GROUP BY 1")
def q_host_fanout(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(T.host(F.col("url")).alias("host"), F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+/([^/?#]*)", 1).alias("section"))
    return rows.groupBy("host").agg(F.count_distinct("section").alias("sections")).withColumn("identifying", F.col("sections") <= 5)


@query("""WITH seed AS (SELECT o_custkey AS id, 'seed' AS origin, count(*) AS n FROM orders GROUP BY 1) SELECT id, origin, n FROM seed UNION ALL SELECT c_custkey, 'stored', 0 FROM customer WHERE c_custkey NOT IN (SELECT id FROM seed)""")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    seed = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.lit("seed").alias("origin"), F.count("*").alias("n"))
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("stored").alias("origin"), F.lit(0).cast("bigint").alias("n"))
    return upserted(stored, seed, ["id"])


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS id, CASE WHEN o_custkey >= 4 THEN o_custkey // 4 END AS parent, o_orderstatus AS name FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
 r(id, level) AS (SELECT id, 0 FROM s WHERE parent IS NULL OR parent NOT IN (SELECT id FROM s) UNION ALL SELECT s.id, r.level + 1 FROM s JOIN r ON s.parent = r.id) SELECT id, parent, name, level::INT AS level FROM s JOIN r USING (id)""")
def q_seed_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    seed = table(spark, d, "orders").select(k.alias("id"), F.when(k >= 4, F.floor(k / 4)).alias("parent"), F.col("o_orderstatus").alias("name"), "o_orderkey")
    return graphs.parents_first(seed, "id", "parent", "o_orderkey").select("id", "parent", "name", "level")


_STEP = "SELECT user_id, ts, event_id, event_type FROM events"


@query(f"""SELECT user_id, calls, invalid, round(invalid / calls, 6) AS share, worst >= 4 AS stopped FROM (SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS invalid FROM events GROUP BY 1) JOIN
 (SELECT user_id, max(CASE WHEN event_type = 'error' THEN n ELSE 0 END) AS worst FROM (SELECT user_id, event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM ({_STEP})) GROUP BY user_id, event_type, run) GROUP BY 1) USING (user_id)""")
def q_tool_budget(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    w, own = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    runs = ev.select("user_id", "event_type", (F.row_number().over(w) - F.row_number().over(own)).alias("run")).groupBy("user_id", "event_type", "run").agg(F.count("*").alias("n"))
    bad = F.col("event_type") == "error"
    told = runs.groupBy("user_id").agg(F.sum("n").alias("calls"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("invalid"), F.max(F.when(bad, F.col("n")).otherwise(0)).alias("worst"))
    return told.select("user_id", "calls", "invalid", F.round(F.col("invalid") / F.col("calls"), 6).alias("share"), (F.col("worst") >= 4).alias("stopped"))
