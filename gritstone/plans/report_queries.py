"""Small reports: tallies, catalogues, admissible urls, attachments, and where a quote leaves its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gritstone.functions import fields as X, text as T
from gritstone.operators import journeys as J, placement as P
from gritstone.operators.search import contained
from gritstone.sources.tables import cut, light, table

from .catalogue import query
from .journey_queries import AS_OF, _program, nodes, requests
from .text_queries import _norm_sql


@query("SELECT coalesce('u' || CASE WHEN user_id % 3 <> 0 THEN user_id END, 'ip' || (user_id % 7)) AS subject, CASE WHEN value > 90 THEN 'HIGH' WHEN value > 50 THEN 'MEDIUM' ELSE 'LOW' END AS severity, count(*) AS n FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ALL")
def q_security_counts(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    last = ev.agg(F.max("ts").alias("last"))
    recent = ev.filter("event_type = 'error'").crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr("interval 7 days"))  # last is one row
    subject = F.coalesce(F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), "user_id")), F.concat(F.lit("ip"), F.col("user_id") % 7))
    return recent.groupBy(subject.alias("subject"), F.when(F.col("value") > 90, "HIGH").when(F.col("value") > 50, "MEDIUM").otherwise("LOW").alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT status, count(*) AS n, status IN ('DERIVED_HIGH', 'DERIVED_MEDIUM') AS usable FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'DERIVED_HIGH' WHEN 1 THEN 'DERIVED_MEDIUM' WHEN 2 THEN 'REVIEW' ELSE 'REJECTED' END AS status FROM customer) GROUP BY 1")
def q_geocode_tally(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    rows = table(spark, d, "customer").select(F.when(k == 0, "DERIVED_HIGH").when(k == 1, "DERIVED_MEDIUM").when(k == 2, "REVIEW").otherwise("REJECTED").alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("n")).withColumn("usable", F.col("status").isin(*P.USABLE))


@query("SELECT p_type AS category, count(*) AS n, count(*) FILTER (p_name LIKE '%ring%') AS named FROM part GROUP BY 1")
def q_registry_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("p_name").contains("ring")).alias("named"))


@query("SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT 'Rs. ' || CAST(CAST(l_tax * 100 AS INTEGER) AS VARCHAR))), chr(10)) AS fees FROM lineitem GROUP BY 1")
def q_fee_schedule(spark: SparkSession, d: str) -> DataFrame:
    claim = F.concat(F.lit("Rs. "), F.round(F.col("l_tax") * 100).cast("int"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(claim)), "\n").alias("fees"))  # a handful of rates


@query("SELECT s_suppkey, s_name, s_acctbal > 5000 AS by_machine, contains(lower(s_name), '7') OR s_suppkey = 3 AS shown, row_number() OVER (PARTITION BY s_acctbal > 5000 ORDER BY s_name) AS place FROM supplier")
def q_catalogue_split(spark: SparkSession, d: str) -> DataFrame:
    machine = (F.col("s_acctbal") > 5000).alias("by_machine")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", machine, (F.contains(F.lower("s_name"), F.lit("7")) | (F.col("s_suppkey") == 3)).alias("shown"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("by_machine").orderBy("s_name")))


#: Hosts that may be cited besides those of the trusted endings, and names of states.
_TRUSTED, _NAMED = r"\.example$", ("shared.example.org",)
_STATES = ("anthe", "thren", "erin", "stan")


def _only_other_state(text: Column, home: str) -> Column:
    """Whether a text names exactly one state, and that isn't the home state."""
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in _STATES)))
    return (F.size(found) == 1) & ~F.array_contains(found, home)


@query(rf"""WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, list_filter([{', '.join(f"CASE WHEN contains(lower(html), '{s}') THEN '{s}' END" for s in _STATES)}], lambda x: x IS NOT NULL) AS states FROM pages)
 SELECT page_id, regexp_matches(host, '{_TRUSTED}') OR host IN ('{"', '".join(_NAMED)}') AS citable, len(states) = 1 AND NOT list_contains(states, 'erin') AS other_state, NOT regexp_matches(path, '(?i)\.(zip|jpe?g|png|exe)$') AS readable, CASE WHEN path IN ('', '/') THEN 3 WHEN regexp_matches(path, '^/[a-z]{{2}}/') THEN 2 ELSE 1 END AS class FROM p""")
def q_url_admission(spark: SparkSession, d: str) -> DataFrame:
    host, path = T.host(F.col("url")), F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    return table(spark, d, "pages").select(
        "page_id", (host.rlike(_TRUSTED) | host.isin(*_NAMED)).alias("citable"), _only_other_state(F.col("html"), "erin").alias("other_state"), (~path.rlike(r"(?i)\.(zip|jpe?g|png|exe)$")).alias("readable"),
        F.when(path.isin("", "/"), 3).when(path.rlike("^/[a-z]{2}/"), 2).otherwise(1).alias("class"),
    )


@query(f"""WITH b AS (SELECT item_id, {_norm_sql('text')} AS q FROM benchmark), d AS (SELECT doc_id, {_norm_sql('text')} AS body FROM documents), c AS (SELECT item_id, doc_id, q, body FROM b JOIN d ON length(q) >= 24 AND contains(body, left(q, 24)))
 SELECT item_id, doc_id, length(q) AS n, max(CASE WHEN contains(body, left(q, CAST(k AS BIGINT))) THEN k END) AS prefix FROM c, unnest(generate_series(24, length(q))) AS g(k) GROUP BY item_id, doc_id, q""")
def q_divergence(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    quotes = items.select("item_id", T.norm(F.col("text")).alias("q")).filter("length(q) >= 24")
    near = cut(contained(docs, quotes.select("item_id", F.left("q", F.lit(24)).alias("text"))))
    held = docs.join(light(near.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", T.norm(F.col("text")).alias("body"))  # only texts that hold a beginning
    both = near.join(quotes, "item_id").join(held, "doc_id")
    return both.select("item_id", "doc_id", F.length("q").alias("n"), X.common_prefix(F.col("q"), F.col("body")).alias("prefix"))


@query("""WITH req AS (SELECT 'n' || c_nationkey || '|' || c_mktsegment AS request_id, 'n' || c_nationkey AS n, 'r' || any_value(n_regionkey) AS r, 's' || (min(c_custkey) % (SELECT count(*) FROM supplier)) AS goal FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey, c_mktsegment),
 e AS (SELECT 'a' || l_suppkey || '_' || l_orderkey AS id, 's' || l_suppkey AS src, 'c' || o_custkey AS dst, CASE WHEN o_orderpriority = '1-URGENT' THEN 'VISIT_AT' ELSE 'APPLY_AT' END AS type, 'n' || c_nationkey AS there, c_custkey % 2 = 0 AS office FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
 SELECT request_id, e.type, count(*) AS n, min(id) AS first_id FROM req JOIN e ON e.src = goal WHERE NOT office OR there = n GROUP BY ALL""")
def q_attach(spark: SparkSession, d: str) -> DataFrame:
    asked = requests(spark, d)
    line = table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("o_orderkey")).distinct()
    rows = line.join(table(spark, d, "orders"), "o_orderkey").select(
        F.concat(F.lit("a"), "l_suppkey", F.lit("_"), "o_orderkey").alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), F.when(F.col("o_orderpriority") == "1-URGENT", "VISIT_AT").otherwise("APPLY_AT").alias("type"),
        F.lit(None).cast("string").alias("scope"), _program(None).alias("program"), F.lit("VERIFIED").alias("status"), F.lit(None).cast("date").alias("valid_until"),
    )
    customers = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "OFFICE").otherwise("PORTAL").alias("type"), F.concat(F.lit("n"), "c_nationkey").alias("scope"))
    nation = table(spark, d, "nation")
    up = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.explode(F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).alias("ancestor_id"))
    told = J.attached(asked.select("request_id", F.col("goal").alias("node")), asked, nodes(spark, d).union(customers), rows, ["VISIT_AT", "APPLY_AT"], up, F.lit(AS_OF).cast("date"))
    return told.groupBy("request_id", "type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey) FILTER (l_linenumber <= 3), []) AS top, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag <> 'N'), []) AS kept, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'N'), []) AS open_ FROM lineitem GROUP BY 1)
 SELECT l_orderkey, array_to_string(list_sort(list_filter(top, lambda x: list_contains(kept, x))), ',') AS both_, array_to_string(list_sort(list_filter(open_, lambda x: NOT list_contains(kept, x))), ',') AS lacking FROM s""")
def q_set_operations(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*(F.collect_set(F.when(c, F.col("l_suppkey"))).alias(n) for n, c in (("top", F.col("l_linenumber") <= 3), ("kept", F.col("l_returnflag") != "N"), ("open", F.col("l_returnflag") == "N"))))  # an order's lines
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    return own.select("l_orderkey", text(F.array_intersect("top", "kept")).alias("both_"), text(F.array_except("open", "kept")).alias("lacking"))
