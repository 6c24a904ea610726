"""Journeys over a graph made of the order tables: suppliers are services that require the parts of
their lines, parts depend on parts of half their number, some are produced by suppliers, some own
requirement groups; a request is a nation's customers of one segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gritstone.operators import graphs, journeys as J
from gritstone.operators.programs import program
from gritstone.sources.tables import table

from .catalogue import query


def _program(tree: dict | None) -> Column:
    steps = [F.struct(F.lit(op).alias("op"), F.lit(field).cast("string").alias("field"), (F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")).alias("values"), F.lit(arity).alias("arity")) for op, field, values, arity in program(tree)]
    return F.array(*steps) if steps else F.array().cast("array<struct<op:string,field:string,values:array<string>,arity:int>>")


RICH = {"field": "balance", "operator": "GTE", "value": 5000}
TRADE = {"any": [{"field": "segment", "operator": "IN", "value": ["BUILDING", "MACHINERY"]}, {"all": [RICH, {"not": {"field": "segment", "operator": "EQ", "value": "furniture"}}]}]}
AS_OF = "1998-01-01"


def requests(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    total = table(spark, d, "supplier").agg(F.count("*").alias("suppliers"))
    per = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"), F.min_by("c_acctbal", "c_custkey").alias("balance"))
    rows = per.join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey").crossJoin(F.broadcast(total))  # total is one row
    facts = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("balance"), F.when(F.col("c_nationkey") % 4 != 0, F.col("balance").cast("string")))
    return rows.select(
        F.concat(F.lit("n"), "c_nationkey", F.lit("|"), "c_mktsegment").alias("request_id"), F.concat(F.lit("s"), F.col("first") % F.col("suppliers")).alias("goal"),
        F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), "n_regionkey")).alias("chain"), facts.alias("facts"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("DOCUMENT", "PAYMENT", "ELIGIBILITY", "ACTION", "DOCUMENT_GROUP"))), (F.col("p_size") % 5 + 1).cast("int"))
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), kind.alias("type"), F.lit(None).cast("string").alias("scope"))
    return parts.union(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit("SERVICE"), F.lit(None).cast("string")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    size, k = F.col("p_size"), F.col("p_partkey")
    scope = F.when(size % 3 == 1, F.concat(F.lit("r"), size % 5)).when(size % 3 == 2, F.concat(F.lit("n"), size % 25))
    held = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").cast("date").alias("valid_until"))
    needs = held.join(part, "p_partkey").select(
        F.concat(F.lit("e"), "l_suppkey", F.lit("_"), k).alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), k).alias("dst"), F.lit("REQUIRES").alias("type"), scope.alias("scope"),
        F.when(k % 4 == 0, _program(RICH)).when(k % 4 == 1, _program(TRADE)).otherwise(_program(None)).alias("program"), F.when(size == 50, "REJECTED").otherwise("VERIFIED").alias("status"), "valid_until",
    )
    plain = (F.lit(None).cast("string").alias("scope"), _program(None).alias("program"), F.lit("VERIFIED").alias("status"), F.lit(None).cast("date").alias("valid_until"))
    halves = part.filter("p_partkey > 0 and p_partkey % 2 = 0").select(F.concat(F.lit("d"), k).alias("id"), F.concat(F.lit("p"), k).alias("src"), F.concat(F.lit("p"), (k / 2).cast("bigint")).alias("dst"), F.lit("DEPENDS_ON").alias("type"), *plain)
    made = part.filter("p_partkey % 499 = 0").withColumn("by", (k / 499).cast("bigint")).join(supplier.select(F.col("s_suppkey").alias("by")), "by")
    return needs.union(halves).union(made.select(F.concat(F.lit("m"), k).alias("id"), F.concat(F.lit("s"), "by").alias("src"), F.concat(F.lit("p"), k).alias("dst"), F.lit("PRODUCES").alias("type"), *plain))


def groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(groups, members): parts whose number ends in 3 ask for the next two parts and for the one of twice their number and 7."""
    owner = table(spark, d, "part").filter("p_partkey % 10 = 3").select(F.col("p_partkey").alias("k"))
    mode = F.element_at(F.array(*map(F.lit, ("ALL_OF", "ANY_OF", "AT_LEAST_N"))), (F.col("k") % 3 + 1).cast("int"))
    told = owner.select(F.concat(F.lit("g"), "k").alias("id"), F.concat(F.lit("p"), "k").alias("owner"), mode.alias("mode"), F.lit(2).alias("need"), F.lit(None).cast("string").alias("scope"), _program(None).alias("program"))
    member = F.explode(F.array(*(F.struct(x.alias("m"), F.lit(i).alias("i")) for i, x in enumerate((F.col("k") + 1, F.col("k") + 2, F.col("k") * 2 + 7)))))
    rows = owner.select("k", member.alias("x")).select("k", F.col("x.m").alias("p_partkey"), "x.i").join(table(spark, d, "part").select("p_partkey"), "p_partkey", "left_semi")
    only = F.when(F.col("i") == 0, _program({"field": "segment", "operator": "EQ", "value": "AUTOMOBILE"})).otherwise(_program(None))
    return told, rows.select(F.concat(F.lit("g"), "k").alias("group_id"), F.concat(F.lit("p"), "p_partkey").alias("node"), only.alias("program"))


def owned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'A'").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    return rows.join(table(spark, d, "customer"), "c_custkey").select(F.concat(F.lit("n"), "c_nationkey", F.lit("|"), "c_mktsegment").alias("request_id"), F.concat(F.lit("p"), "l_partkey").alias("node")).distinct()


_GRAPH = """WITH RECURSIVE req AS (SELECT 'n' || c_nationkey || '|' || c_mktsegment AS request_id, 's' || (min(c_custkey) % (SELECT count(*) FROM supplier)) AS goal, 'n' || c_nationkey AS n, 'r' || any_value(n_regionkey) AS r,
  lower(c_mktsegment) AS segment, CASE WHEN c_nationkey % 4 <> 0 THEN min_by(c_acctbal, c_custkey) END AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey, c_mktsegment),
 owned AS (SELECT DISTINCT 'n' || c_nationkey || '|' || c_mktsegment AS request_id, 'p' || l_partkey AS node FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'A'),
 own AS (SELECT p_partkey AS k, ['ALL_OF', 'ANY_OF', 'AT_LEAST_N'][1 + p_partkey % 3] AS mode FROM part WHERE p_partkey % 10 = 3),
 mem AS (SELECT k, m, i FROM (SELECT k, unnest([k + 1, k + 2, 2 * k + 7]) AS m, unnest([0, 1, 2]) AS i FROM own) JOIN part ON p_partkey = m),
 counted AS (SELECT r.request_id, o.k, o.mode, m.m, m.i, m.i > 0 OR r.segment = 'automobile' AS counts, h.node IS NOT NULL AS has FROM req r CROSS JOIN own o LEFT JOIN mem m ON m.k = o.k LEFT JOIN owned h ON h.request_id = r.request_id AND h.node = 'p' || m.m),
 base AS (SELECT request_id, k, count(m) FILTER (counts) AS n, count(m) FILTER (counts AND has) AS have, coalesce(bool_or(i = 2 AND has), FALSE) AS next_held, CASE mode WHEN 'ALL_OF' THEN count(m) FILTER (counts) WHEN 'ANY_OF' THEN least(1, count(m) FILTER (counts)) ELSE least(2, count(m) FILTER (counts)) END AS least FROM counted GROUP BY request_id, k, mode),
 met AS (SELECT request_id, k, have >= least AS sat, have >= least AND have > 0 AS gained FROM base WHERE 2 * k + 7 NOT IN (SELECT k FROM own)
  UNION ALL SELECT b.request_id, b.k, b.have + CAST(c.gained AND NOT b.next_held AS INTEGER) >= b.least, b.have + CAST(c.gained AND NOT b.next_held AS INTEGER) >= b.least AND b.have + CAST(c.gained AND NOT b.next_held AS INTEGER) > 0 FROM met c JOIN base b ON b.request_id = c.request_id AND 2 * b.k + 7 = c.k),
 held AS (SELECT request_id, node FROM owned UNION SELECT request_id, 'p' || k FROM met WHERE gained)
"""
_WALK = _GRAPH.rstrip() + """,
 edge AS (SELECT 'e' || l_suppkey || '_' || p_partkey AS id, 's' || l_suppkey AS src, 'p' || p_partkey AS dst, 'REQUIRES' AS type, CASE p_size % 3 WHEN 1 THEN 'r' || (p_size % 5) WHEN 2 THEN 'n' || (p_size % 25) END AS scope, p_partkey % 4 AS rule FROM
  (SELECT l_suppkey, l_partkey, max(l_shipdate) AS until FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey WHERE p_size <> 50 AND CAST(until AS DATE) >= DATE '1998-01-01'),
 hop AS MATERIALIZED (SELECT request_id, id, src, dst, type, src AS node, dst AS nxt, CASE rule WHEN 0 THEN balance >= 5000 WHEN 1 THEN segment IN ('building', 'machinery') OR (balance >= 5000 AND NOT segment = 'furniture') ELSE TRUE END AS truth FROM edge JOIN req ON scope IS NULL OR scope = n OR scope = r
  UNION ALL SELECT request_id, 'd' || p_partkey, 'p' || p_partkey, 'p' || p_partkey // 2, 'DEPENDS_ON', 'p' || p_partkey, 'p' || p_partkey // 2, TRUE FROM part, req WHERE p_partkey > 0 AND p_partkey % 2 = 0
  UNION ALL SELECT request_id, 'm' || p_partkey, 's' || s_suppkey, 'p' || p_partkey, 'PRODUCES', 'p' || p_partkey, 's' || s_suppkey, TRUE FROM part JOIN supplier ON p_partkey % 499 = 0 AND s_suppkey = p_partkey // 499, req WHERE p_size % 5 IN (0, 1, 4)
  UNION ALL SELECT request_id, 'rg:g' || k || ':p' || m, 'p' || k, 'p' || m, 'REQUIRES', 'p' || k, 'p' || m, TRUE FROM counted WHERE counts),
 stop AS (SELECT request_id, node FROM held UNION SELECT request_id, 'p' || k FROM met WHERE sat),
 walk AS (SELECT request_id, goal AS node FROM req UNION SELECT w.request_id, h.nxt FROM walk w JOIN hop h ON h.request_id = w.request_id AND h.node = w.node AND h.truth LEFT JOIN stop s ON s.request_id = w.request_id AND s.node = w.node WHERE s.node IS NULL)
"""


@query(_GRAPH + "SELECT request_id, node FROM held")
def q_held_closure(spark: SparkSession, d: str) -> DataFrame:
    return J.held_closure(requests(spark, d), owned(spark, d), *groups(spark, d))


def _expanded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return J.journeys(requests(spark, d), nodes(spark, d), edges(spark, d), *groups(spark, d), owned(spark, d), F.lit(AS_OF).cast("date"))


@query(_WALK + "SELECT DISTINCT request_id, id, src, dst, type, CASE WHEN truth THEN 'TRUE' ELSE 'UNKNOWN' END AS truth FROM walk JOIN hop USING (request_id, node) ANTI JOIN stop USING (request_id, node) WHERE truth IS NULL OR truth")
def q_journey_expand(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d)[1].select("request_id", "id", "src", "dst", "type", F.when(F.col("truth"), "TRUE").otherwise("UNKNOWN").alias("truth"))


@query(_WALK + """SELECT request_id, count(*) AS nodes, count(*) FILTER (node IN (SELECT node FROM held h WHERE h.request_id = w.request_id)) AS satisfied, count(*) FILTER (node LIKE 's%') AS services,
 count(*) FILTER (node LIKE 'p%' AND (SELECT p_size % 5 FROM part WHERE 'p' || p_partkey = node) IN (0, 4)) AS documents FROM walk w GROUP BY request_id""")
def q_journey_summary(spark: SparkSession, d: str) -> DataFrame:
    reached, _, held = _expanded(spark, d)
    rows = reached.join(nodes(spark, d).select(F.col("id").alias("node"), "type"), "node").join(held.withColumn("has", F.lit(True)), ["request_id", "node"], "left")
    return rows.groupBy("request_id").agg(F.count("*").alias("nodes"), F.count_if("has").alias("satisfied"), F.count_if(F.col("type") == "SERVICE").alias("services"), F.count_if(F.col("type").isin("DOCUMENT", "DOCUMENT_GROUP")).alias("documents"))


@query(_WALK + """SELECT request_id, 'balance' AS field, count(DISTINCT dst) AS affects, row_number() OVER (PARTITION BY request_id ORDER BY count(DISTINCT dst) DESC) AS rank FROM walk JOIN hop USING (request_id, node) ANTI JOIN stop USING (request_id, node) WHERE truth IS NULL GROUP BY request_id""")
def q_question_rank(spark: SparkSession, d: str) -> DataFrame:
    open_ = _expanded(spark, d)[1].filter("truth is null").select("request_id", "dst", F.explode("pending").alias("field")).groupBy("request_id", "field").agg(F.count_distinct("dst").alias("affects"))
    return open_.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("affects"), "field")).cast("bigint"))


@query("""WITH RECURSIVE pair AS (SELECT a.l_orderkey AS o, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND (a.l_partkey + b.l_partkey) % 3 = 0
  UNION SELECT l_orderkey, max(l_linenumber), min(l_linenumber) FROM lineitem WHERE l_suppkey % 10 = 0 GROUP BY 1 HAVING count(*) > 1),
 far AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS y, 0 AS layer FROM lineitem UNION SELECT f.o, p.y, f.layer + 1 FROM far f JOIN pair p ON p.o = f.o AND p.x = f.y WHERE f.layer < 20),
 top AS (SELECT o, y, max(layer) AS layer FROM far GROUP BY ALL)
 SELECT o AS l_orderkey, y AS l_linenumber, CASE WHEN layer < 20 THEN layer END AS layer, row_number() OVER (PARTITION BY o ORDER BY CASE WHEN layer < 20 THEN layer ELSE 99 END, y) AS step FROM top""")
def q_topo_layers(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("node"), "l_partkey", "l_suppkey")
    later = li.select("request_id", F.col("node").alias("after"), F.col("l_partkey").alias("other"))
    ahead = li.join(later, "request_id").filter("node < after and (l_partkey + other) % 3 = 0").select("request_id", F.col("node").alias("before"), "after")
    back = li.filter("l_suppkey % 10 = 0").groupBy("request_id").agg(F.max("node").alias("before"), F.min("node").alias("after"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = J.layered(li.select("request_id", "node", F.col("node").alias("ord")).distinct(), ahead.union(back))
    step = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("layer").asc_nulls_last(), "ord")).cast("bigint")
    return told.select(F.col("request_id").alias("l_orderkey"), F.col("node").alias("l_linenumber"), "layer", step.alias("step"))


@query("""WITH chain AS (SELECT 'n' || n_nationkey AS n, 'r' || n_regionkey AS r FROM nation),
 e AS (SELECT l_orderkey * 100 + l_linenumber AS id, CASE l_suppkey % 3 WHEN 1 THEN 'r' || (l_suppkey % 5) WHEN 2 THEN 'n' || (l_suppkey % 25) END AS scope, l_discount, CAST(l_shipdate AS DATE) AS until, l_returnflag FROM lineitem WHERE l_linestatus = 'O'),
 hit AS (SELECT n, id, CASE WHEN scope IS NULL THEN 0 WHEN scope = r THEN 1 ELSE 2 END AS specificity, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount >= 0.05 END AS truth FROM e JOIN chain ON scope IS NULL OR scope = n OR scope = r WHERE until >= DATE '1998-01-01'),
 kept AS (SELECT n, id, specificity, truth FROM hit WHERE truth IS NULL OR truth)
 SELECT n AS scope, specificity, count(*) FILTER (truth) AS yes, count(*) FILTER (truth IS NULL) AS unknown, min(id) AS first_id FROM kept GROUP BY ALL""")
def q_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    chains = table(spark, d, "nation").select(F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")).alias("chain"))
    s = F.col("l_suppkey")
    rule = _program({"field": "discount", "operator": "GTE", "value": 0.05})
    rows = table(spark, d, "lineitem").filter("l_linestatus = 'O'").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.when(s % 3 == 1, F.concat(F.lit("r"), s % 5)).when(s % 3 == 2, F.concat(F.lit("n"), s % 25)).alias("scope"), F.lit("VERIFIED").alias("status"),
        F.col("l_shipdate").cast("date").alias("valid_until"), rule.alias("program"), F.create_map(F.lit("discount"), F.when(F.col("l_returnflag") != "N", F.col("l_discount").cast("string"))).alias("facts"),
    )
    keyed = chains.select("chain", F.explode(F.concat(F.col("chain"), F.array(F.lit("")))).alias("key"))
    hits = rows.join(F.broadcast(keyed), F.coalesce("scope", F.lit("")) == F.col("key")).drop("key")  # three rows a nation
    told = J.filtered(hits, F.lit(AS_OF).cast("date"))
    return told.groupBy(F.get("chain", F.lit(0)).alias("scope"), "specificity").agg(F.count_if("truth").alias("yes"), F.count_if(F.col("truth").isNull()).alias("unknown"), F.min("id").alias("first_id"))


@query("""WITH asked AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'nowhere' ELSE '  ' || lower(r_name) || CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE ' ' END END AS region, CASE WHEN s_suppkey % 5 = 0 THEN 'lost' ELSE replace(n_name, '_', CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE '-' END) END AS nation
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
 r AS (SELECT s_suppkey, nation, r_regionkey FROM asked LEFT JOIN region ON regexp_replace(lower(trim(region)), '[\\s_-]', '', 'g') = regexp_replace(lower(trim(r_name)), '[\\s_-]', '', 'g'))
 SELECT s_suppkey, CASE WHEN n_nationkey IS NOT NULL THEN 'n' || n_nationkey ELSE 'r' || r_regionkey END AS scope, CASE WHEN n_nationkey IS NOT NULL THEN 2 WHEN r_regionkey IS NOT NULL THEN 1 ELSE 0 END AS level FROM r LEFT JOIN nation ON n_regionkey = r_regionkey AND regexp_replace(lower(trim(nation)), '[\\s_-]', '', 'g') = regexp_replace(lower(trim(n_name)), '[\\s_-]', '', 'g')""")
def q_resolve_scope(spark: SparkSession, d: str) -> DataFrame:
    region, nation, supplier = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    places = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name")).union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name"))
    s, odd = F.col("s_suppkey"), F.col("s_suppkey") % 2 == 0
    asked = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(  # 25 nations, five regions
        s.alias("request_id"),
        F.array(F.when(s % 7 == 0, "nowhere").otherwise(F.concat(F.lit("  "), F.lower("r_name"), F.when(odd, "-").otherwise(" "))), F.when(s % 5 == 0, "lost").otherwise(F.replace("n_name", F.lit("_"), F.when(odd, " ").otherwise("-")))).alias("names"),
    )
    return graphs.resolved(asked, places).select(F.col("request_id").alias("s_suppkey"), "scope", "level")


@query("""WITH asked AS (SELECT c_custkey AS q, CASE c_custkey % 5 WHEN 0 THEN 's' || (c_custkey % 50) WHEN 1 THEN 'Supplier:' || (c_custkey % 50) WHEN 2 THEN ' supplier#' || lpad(CAST(c_custkey % 50 AS VARCHAR), 9, '0') || ' ' WHEN 3 THEN 'NATION_' || (c_custkey % 30) ELSE 'unheard of' END AS name FROM customer),
 own AS (SELECT s_suppkey, 's' || s_suppkey AS id, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
 hit AS (SELECT q, s_suppkey, 1 AS priority FROM asked JOIN own ON id = trim(name) UNION ALL SELECT q, s_suppkey, 2 FROM asked JOIN own ON id = 's' || regexp_extract(lower(trim(name)), '^supplier:(.*)$', 1) UNION ALL SELECT q, s_suppkey, 3 FROM asked JOIN own ON lower(trim(name)) = lower(s_name) UNION ALL SELECT q, s_suppkey, 4 FROM asked JOIN own ON lower(trim(name)) = lower(n_name))
 SELECT q AS c_custkey, goal, priority FROM asked LEFT JOIN (SELECT q, 's' || arg_min(s_suppkey, CAST(priority AS BIGINT) * 1000000000 + s_suppkey) AS goal, min(priority) AS priority FROM hit GROUP BY q) USING (q)""")
def q_resolve_goal(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select(
        k.alias("request_id"),
        F.when(k % 5 == 0, F.concat(F.lit("s"), k % 50)).when(k % 5 == 1, F.concat(F.lit("Supplier:"), k % 50)).when(k % 5 == 2, F.concat(F.lit(" supplier#"), F.lpad((k % 50).cast("string"), 9, "0"), F.lit(" "))).when(k % 5 == 3, F.concat(F.lit("NATION_"), k % 30)).otherwise("unheard of").alias("name"),
    )
    own = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    services = own.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.array("n_name").alias("aliases"))
    return graphs.named_goal(asked, services, [("supplier:", "s")]).select(F.col("request_id").alias("c_custkey"), F.col("id").alias("goal"), "priority")
