"""Bundles of nodes and edges: folding into one graph, rows and back, statistics, coverage of dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gritstone.functions import chunks
from gritstone.operators import bundles as B
from gritstone.sources.tables import table

from .catalogue import query


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    """A bundle for each nation: its suppliers are services, the parts that they sold at a full discount documents; regions are template packs."""
    line = table(spark, d, "lineitem").filter("l_discount >= 0.09").select("l_suppkey", "l_partkey").distinct()
    sold = line.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    service = table(spark, d, "supplier").select("s_nationkey", F.concat(F.lit("service:"), "s_suppkey").alias("id"), F.lit("SERVICE").alias("type"), F.col("s_name").alias("name"))
    parts = sold.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("s_nationkey", F.concat(F.lit("part:"), "l_partkey").alias("id"), F.lit("DOCUMENT").alias("type"), F.concat_ws(" ", "p_name", F.concat(F.lit("of "), "s_nationkey")).alias("name")).distinct()
    nodes = service.union(parts).groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("id", "type", "name"))).alias("nodes"))  # a bundle is a file's worth
    edges = sold.select("s_nationkey", F.struct(F.concat_ws("_", F.lit("e"), "l_suppkey", "l_partkey").alias("id"), F.concat(F.lit("service:"), "l_suppkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.lit("REQUIRES").alias("type")).alias("e")).groupBy("s_nationkey").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    own = nodes.join(edges, "s_nationkey", "left").select(F.concat(F.lit("n"), "s_nationkey").alias("bundle"), "nodes", F.coalesce("edges", F.array().cast("array<struct<id:string,src:string,dst:string,type:string>>")).alias("edges"), F.array().cast("array<struct<id:string,src:string,dst:string,type:string>>").alias("templates"))
    stamp = F.array(F.struct(F.concat(F.lit("t:*_r"), "r_regionkey").alias("id"), F.lit("*").alias("src"), F.concat(F.lit("help:"), "r_regionkey").alias("dst"), F.lit("ESCALATE_TO").alias("type")))
    packs = table(spark, d, "region").select(F.concat(F.lit("a_pack"), "r_regionkey").alias("bundle"), F.array(F.struct(F.concat(F.lit("help:"), "r_regionkey").alias("id"), F.lit("HELPLINE").alias("type"), F.col("r_name").alias("name"))).alias("nodes"), F.array().cast("array<struct<id:string,src:string,dst:string,type:string>>").alias("edges"), stamp.alias("templates"))
    return own.unionByName(packs)


_PARTS = "WITH sold AS (SELECT DISTINCT l_suppkey, l_partkey, s_nationkey, 'n' || s_nationkey AS bundle, p_name || ' of ' || s_nationkey AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.09)"


@query(_PARTS + """, n AS (SELECT FALSE AS pack, bundle, 'part:' || l_partkey AS id, 'DOCUMENT' AS type, name FROM sold UNION SELECT FALSE, 'n' || s_nationkey, 'service:' || s_suppkey, 'SERVICE', s_name FROM supplier UNION ALL SELECT TRUE, 'a_pack' || r_regionkey, 'help:' || r_regionkey, 'HELPLINE', r_name FROM region),
 f AS (SELECT id, type, name, bundle FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY pack, bundle) = 1) SELECT id, type, name, bundle, row_number() OVER (ORDER BY id) AS ord FROM f""")
def q_bundle_fold(spark: SparkSession, d: str) -> DataFrame:
    return B.numbered(B.folded(_bundles(spark, d), "nodes"), "id").select("id", "type", "name", "bundle", "ord")


@query(_PARTS + """ SELECT 'e_' || l_suppkey || '_' || l_partkey AS id, 'service:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'REQUIRES' AS type FROM sold UNION ALL SELECT 't:service:' || s_suppkey || '_r' || r_regionkey, 'service:' || s_suppkey, 'help:' || r_regionkey, 'ESCALATE_TO' FROM supplier, region""")
def q_template_stamp(spark: SparkSession, d: str) -> DataFrame:
    return B.stamped(_bundles(spark, d)).select("id", "src", "dst", "type")


@query(_PARTS + """, n AS (SELECT bundle, 'part:' || l_partkey AS id FROM sold UNION SELECT 'n' || s_nationkey, 'service:' || s_suppkey FROM supplier UNION ALL SELECT 'a_pack' || r_regionkey, 'help:' || r_regionkey FROM region)
 SELECT bundle, count(*) AS nodes, min(id) AS first_node, max(id) AS last_node FROM n WHERE bundle NOT LIKE 'a_pack%' GROUP BY 1""")
def q_bundle_rows(spark: SparkSession, d: str) -> DataFrame:
    own = B.journeys(_bundles(spark, d))
    again = B.to_bundles(B.to_rows(own, "nodes"), "nodes")
    return again.select("bundle", F.size("nodes").cast("bigint").alias("nodes"), F.get("nodes", F.lit(0))["id"].alias("first_node"), F.element_at("nodes", -1)["id"].alias("last_node"))


@query("""SELECT kind, n FROM (SELECT 'type:' || ['DOCUMENT', 'PAYMENT', 'ELIGIBILITY', 'ACTION', 'DOCUMENT_GROUP'][1 + p_size % 5] AS kind, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'type:SERVICE', count(*) FROM supplier
 UNION ALL SELECT 'edges', count(*) FROM lineitem UNION ALL SELECT 'verified', count(*) FILTER (l_returnflag = 'A') FROM lineitem UNION ALL SELECT 'conflicts', count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_tax) > 1))""")
def q_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("DOCUMENT", "PAYMENT", "ELIGIBILITY", "ACTION", "DOCUMENT_GROUP"))), (F.col("p_size") % 5 + 1).cast("int"))
    nodes = table(spark, d, "part").select(kinds.alias("type")).union(table(spark, d, "supplier").select(F.lit("SERVICE")))
    line = table(spark, d, "lineitem")
    counts = line.agg(F.count("*").alias("edges"), F.count_if(F.col("l_returnflag") == "A").alias("verified"))
    told = nodes.groupBy(F.concat(F.lit("type:"), "type").alias("kind")).agg(F.count("*").alias("n"))
    told = told.union(counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("edges", "verified"))))))
    differing = line.groupBy("l_partkey").agg((F.min("l_tax") < F.max("l_tax")).alias("x")).agg(F.count_if("x").alias("n"))
    return told.union(differing.select(F.lit("conflicts"), "n"))


_DIMS = ("CHANNEL", "DOCUMENTS", "FEE", "OFFICE", "SOURCE", "STEPS", "TIMELINE")


@query("""WITH f AS (SELECT c_custkey, count(o_orderkey) AS n, coalesce(bool_or(o_orderpriority = '1-URGENT'), FALSE) AS fee, coalesce(bool_or(o_orderstatus = 'P'), FALSE) AS office, coalesce(max(o_totalprice) > 300000, FALSE) AS timeline, any_value(c_acctbal) AS bal, any_value(c_mktsegment) AS seg FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
 k AS (SELECT c_custkey, list_filter([CASE WHEN seg <> 'BUILDING' THEN 'CHANNEL' END, CASE WHEN n > 0 THEN 'DOCUMENTS' END, CASE WHEN fee THEN 'FEE' END, CASE WHEN office THEN 'OFFICE' END, CASE WHEN bal > 0 THEN 'SOURCE' END, CASE WHEN n >= 2 THEN 'STEPS' END, CASE WHEN timeline THEN 'TIMELINE' END], lambda x: x IS NOT NULL) AS known FROM f)
 SELECT c_custkey, array_to_string(known, ',') AS known, array_to_string(list_filter(['CHANNEL', 'DOCUMENTS', 'FEE', 'OFFICE', 'SOURCE', 'STEPS', 'TIMELINE'], lambda x: NOT list_contains(known, x)), ',') AS missing, len(known) AS answered, CASE WHEN len(known) <= 3 THEN 'thin' WHEN len(known) <= 6 THEN 'middling' ELSE 'deep' END AS depth, round(100.0 * len(known) / 7) AS share,
 row_number() OVER (ORDER BY len(known), c_custkey) AS place FROM k""")
def q_completeness(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("fee"), F.bool_or(F.col("o_orderstatus") == "P").alias("office"), (F.max("o_totalprice") > 300000).alias("timeline"))
    rows = table(spark, d, "customer").join(per, "c_custkey", "left")
    told = B.completeness(rows, "c_custkey", dict(zip(_DIMS, (F.col("c_mktsegment") != "BUILDING", F.col("n") > 0, F.col("fee"), F.col("office"), F.col("c_acctbal") > 0, F.col("n") >= 2, F.col("timeline")), strict=True)))
    return told.select("c_custkey", F.array_join("known", ",").alias("known"), F.array_join("missing", ",").alias("missing"), F.col("answered").cast("bigint").alias("answered"), "depth", "share", "place")


@query()
def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunked(table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


@query()
def q_chunk_lengths(spark: SparkSession, d: str) -> DataFrame:
    return chunks.at_share(q_chunks(spark, d).select(F.length("text").alias("length")), "length", [0.1, 0.5, 0.9])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders), item AS (SELECT o_custkey, ord, o_orderkey, l_partkey, o_orderstatus FROM o JOIN lineitem ON l_orderkey = o_orderkey)
 SELECT o_custkey, l_partkey, arg_min(o_orderkey, ord) AS owner, coalesce(array_to_string(list_sort(list(DISTINCT o_orderkey) FILTER (o_orderkey <> first_one)), ','), '') AS also_for, bool_or(o_orderstatus = 'P') AS unverified FROM (SELECT *, first_value(o_orderkey) OVER (PARTITION BY o_custkey, l_partkey ORDER BY ord) AS first_one FROM item) GROUP BY ALL HAVING TRUE""".replace(" GROUP BY ALL HAVING TRUE", " GROUP BY o_custkey, l_partkey"))
def q_plan_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey", "o_orderkey", (F.col("o_orderstatus") == "P").alias("open"))
    told = rows.groupBy("o_custkey", "l_partkey").agg(F.min("o_orderkey").alias("owner"), F.array_sort(F.collect_set("o_orderkey")).alias("all"), F.bool_or("open").alias("unverified"))
    return told.select("o_custkey", "l_partkey", "owner", F.array_join(F.array_remove("all", F.col("owner")).cast("array<string>"), ",").alias("also_for"), "unverified")


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages), l AS (SELECT DISTINCT host, split_part(host, '.', 1) AS label FROM h), one AS (SELECT label FROM l GROUP BY 1 HAVING count(*) = 1),
 known AS (SELECT host, row_number() OVER (ORDER BY host) % 3 AS k FROM l)
 SELECT host, CASE WHEN k = 0 THEN 'EXACT' WHEN regexp_matches(host, '^a') THEN 'RULE' WHEN label IN (SELECT label FROM one) THEN 'ALIAS' ELSE 'NONE' END AS basis, CASE WHEN k = 0 THEN host WHEN regexp_matches(host, '^a') THEN 'rule:a' WHEN label IN (SELECT label FROM one) THEN label END AS owner FROM l JOIN known USING (host)""")
def q_host_registry(spark: SparkSession, d: str) -> DataFrame:
    from gritstone.functions.text import host

    hosts = table(spark, d, "pages").select(host(F.col("url")).alias("host")).distinct()
    exact = B.numbered(hosts, "host").filter("ord % 3 = 0").select("host", F.col("host").alias("name"))
    aliases = hosts.select(F.split_part("host", F.lit("."), F.lit(1)).alias("label"), F.split_part("host", F.lit("."), F.lit(1)).alias("name"))
    return B.registered(hosts, exact, [("^a", "rule:a")], aliases).select("host", "basis", "owner")
