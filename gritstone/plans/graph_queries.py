"""Queries on scopes, conditions, requirements, integrity, coverage and places, over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gritstone.operators import conditions as C, geo, graphs
from gritstone.operators.search import light
from gritstone.sources.tables import table

from .catalogue import query


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree of scopes."""
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    customer = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return region.union(nation).union(customer)


@query("""WITH RECURSIVE tree AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
 up AS (SELECT id, id AS ancestor_id, 0 AS distance FROM tree UNION ALL SELECT up.id, t.parent_id, distance + 1 FROM up JOIN tree t ON t.id = up.ancestor_id WHERE t.parent_id IS NOT NULL) SELECT id, ancestor_id, distance FROM up""")
def q_scope_chain(spark: SparkSession, d: str) -> DataFrame:
    return graphs.closure(_places(spark, d))


@query("""WITH rules(rule, scope) AS (VALUES ('all', NULL), ('region1', 'r1'), ('nation3', 'n3'), ('nation8', 'n8'), ('region2', 'r2'))
 SELECT c_custkey, rule, specificity FROM (SELECT c_custkey, rule, CASE WHEN scope IS NULL THEN 0 WHEN scope LIKE 'r%' THEN 1 ELSE 2 END AS specificity FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN rules ON scope IS NULL OR scope = 'n' || n_nationkey OR scope = 'r' || n_regionkey)
 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY specificity DESC) = 1""")
def q_scoped_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("all", None), ("region1", "r1"), ("nation3", "n3"), ("nation8", "n8"), ("region2", "r2")], "rule string, scope string")
    nations = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit(None).cast("string"), F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"))).alias("scope"))
    ranked = nations.join(F.broadcast(rules), nations.scope.eqNullSafe(rules.scope)).select("n_nationkey", "rule", F.when(nations.scope.isNull(), 0).when(nations.scope.startswith("r"), 1).otherwise(2).alias("specificity"))
    best = ranked.groupBy("n_nationkey").agg(F.max_by(F.struct("rule", "specificity"), "specificity").alias("best"))
    return table(spark, d, "customer").join(light(best), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "best.rule", "best.specificity")


TREE = {"any": [{"all": [{"field": "segment", "operator": "IN", "value": ["BUILDING", "MACHINERY"]}, {"field": "spent", "operator": "GTE", "value": 150000}]}, {"not": {"field": "orders", "operator": "EXISTS"}}, {"field": "balance", "operator": "LT", "value": -500}]}


@query("""WITH f AS (SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance, spent, orders FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey),
 t AS (SELECT c_custkey, (lower(segment) IN ('building', 'machinery') AND spent >= 150000) OR NOT (orders IS NOT NULL) OR balance < -500 AS x, spent IS NULL AS open FROM f)
 SELECT c_custkey, CASE WHEN x THEN 'TRUE' WHEN NOT x THEN 'FALSE' ELSE 'UNKNOWN' END AS truth, CASE WHEN x IS NULL THEN 'spent' ELSE '' END AS pending FROM t""")
def q_kleene_filter(spark: SparkSession, d: str) -> DataFrame:
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("orders"))
    rows = table(spark, d, "customer").join(spent, "c_custkey", "left")
    facts = {"segment": F.col("c_mktsegment"), "balance": F.col("c_acctbal"), "spent": F.col("spent"), "orders": F.col("orders")}
    return rows.select("c_custkey", C.truth(C.condition(TREE, facts)).alias("truth"), F.array_join(C.unresolved(TREE, facts), ",").alias("pending"))


@query("""WITH g AS (SELECT l_orderkey, count(*) AS members, count(*) FILTER (l_returnflag = 'R') AS have, count(*) FILTER (l_returnflag = 'N') AS open FROM lineitem GROUP BY 1)
 SELECT mode, count(*) FILTER (have >= least) AS met, count(*) FILTER (have < least AND have + open >= least) AS unknown, count(*) FILTER (have + open < least) AS unmet
 FROM (SELECT *, CASE mode WHEN 'ALL_OF' THEN members WHEN 'ANY_OF' THEN least(1, members) ELSE least(2, members) END AS least FROM g, (SELECT unnest(['ALL_OF', 'ANY_OF', 'AT_LEAST_N']) AS mode)) GROUP BY mode""")
def q_requirement_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("members"), F.count_if(F.col("l_returnflag") == "R").alias("have"), F.count_if(F.col("l_returnflag") == "N").alias("open"))
    each = groups.withColumn("mode", F.explode(F.array(*map(F.lit, ("ALL_OF", "ANY_OF", "AT_LEAST_N")))))
    truth = C.group_truth(F.col("mode"), F.lit(2), F.col("members"), F.col("have"), F.col("open"))
    return each.withColumn("truth", truth).groupBy("mode").agg(F.count_if(F.col("truth")).alias("met"), F.count_if(F.col("truth").isNull()).alias("unknown"), F.count_if(~F.col("truth")).alias("unmet"))


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem),
 one AS (SELECT DISTINCT dst AS id FROM e WHERE src = 's1'), two AS (SELECT DISTINCT e.dst AS id FROM e JOIN one ON src = one.id)
 SELECT 's1' AS id, 0 AS distance UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two""")
def q_traverse_bfs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    edges = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).union(li.select(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("o"), "l_orderkey"))).distinct()
    return graphs.reached(edges, spark.createDataFrame([("s1",)], "id string"), 2)


@query("""SELECT 'DANGLING_CUSTOMER' AS code, count(*) AS n FROM orders ANTI JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'DANGLING_ORDER', count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT 'DANGLING_PART', count(*) FROM lineitem ANTI JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'DUPLICATE_LINE', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'BAD_DISCOUNT', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.1""")
def q_integrity(spark: SparkSession, d: str) -> DataFrame:
    li, orders, customer, part = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    told = lambda code, rows: rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
    out = told("DANGLING_CUSTOMER", orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"))
    out = out.union(told("DANGLING_ORDER", li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")))
    out = out.union(told("DANGLING_PART", li.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti")))
    out = out.union(told("DUPLICATE_LINE", li.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")))
    return out.union(told("BAD_DISCOUNT", li.filter("not l_discount between 0 and 0.1")))


@query("SELECT 'customer' AS stored, c_custkey AS id FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') s ON o_custkey = c_custkey UNION ALL SELECT 'part', p_partkey FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) s ON l_partkey = p_partkey")
def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    seed = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    customers = table(spark, d, "customer").join(seed, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer").alias("stored"), F.col("c_custkey").alias("id"))
    kept = table(spark, d, "lineitem").filter("l_quantity = 50")
    return customers.union(table(spark, d, "part").join(kept, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.lit("part"), "p_partkey"))


@query("SELECT r_name, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(o_orderkey) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q_coverage_pivot(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    where = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    rows = table(spark, d, "customer").join(per, "c_custkey", "left").join(light(where.select("n_nationkey", "r_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.lower())
    out = rows.groupBy("r_name").agg(n("F"), n("O"), n("P"))
    return out.withColumn("total", F.col("f") + F.col("o") + F.col("p"))


@query("""WITH a AS (SELECT c_custkey, CAST(c_acctbal > 0 AS INTEGER) + CAST(coalesce(max(o_orderkey) IS NOT NULL, FALSE) AS INTEGER) + CAST(coalesce(bool_or(o_orderpriority = '1-URGENT'), FALSE) AS INTEGER) + CAST(coalesce(bool_or(o_orderstatus = 'F'), FALSE) AS INTEGER) + CAST(coalesce(max(o_totalprice) > 200000, FALSE) AS INTEGER) AS answered FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal)
 SELECT CASE WHEN answered <= 1 THEN 'thin' WHEN answered <= 3 THEN 'middling' ELSE 'deep' END AS depth, answered, count(*) AS n FROM a GROUP BY ALL""")
def q_depth_buckets(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("any"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.bool_or(F.col("o_orderstatus") == "F").alias("done"), (F.max("o_totalprice") > 200000).alias("large"))
    rows = table(spark, d, "customer").join(per, "c_custkey", "left")
    flags = [F.col("c_acctbal") > 0, *(F.col(c) for c in ("any", "urgent", "done", "large"))]
    answered = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags[1:]), F.coalesce(flags[0], F.lit(False)).cast("int"))
    depth = F.when(F.col("answered") <= 1, "thin").when(F.col("answered") <= 3, "middling").otherwise("deep")
    return rows.select(answered.alias("answered")).groupBy(depth.alias("depth"), "answered").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_discount) AS terms, CASE WHEN count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT l_discount) > 1 THEN 'CONFLICTING' WHEN count(DISTINCT l_suppkey) >= 2 THEN 'CONFIRMED' ELSE 'SINGLE' END AS verdict FROM lineitem GROUP BY 1")
def q_conflict_judge(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_discount").alias("terms"))
    return seen.withColumn("verdict", F.when((F.col("suppliers") >= 2) & (F.col("terms") > 1), "CONFLICTING").when(F.col("suppliers") >= 2, "CONFIRMED").otherwise("SINGLE"))


@query("SELECT s_nationkey, count(*) AS n, array_to_string(list_sort(list(s_name))[1:6], '|') AS names, count(DISTINCT s_acctbal) > 1 AS differing FROM supplier GROUP BY 1")
def q_office_consolidation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_name"))).filter("k <= 6")  # a limit by group: each task keeps six of a nation
    names = few.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "|").alias("names"))
    return rows.groupBy("s_nationkey").agg(F.count("*").alias("n"), (F.min("s_acctbal") < F.max("s_acctbal")).alias("differing")).join(names, "s_nationkey")


@query("""SELECT c_custkey, coalesce(a.v, b.v, 'default') AS value, CASE WHEN a.v IS NOT NULL THEN 'segment' WHEN b.v IS NOT NULL THEN 'nation' ELSE 'none' END AS basis FROM customer
 LEFT JOIN (SELECT * FROM (VALUES ('BUILDING', 'x'), ('MACHINERY', 'y')) t(k, v)) a ON a.k = c_mktsegment LEFT JOIN (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_regionkey = 1) b ON b.k = c_nationkey""")
def q_priority_join(spark: SparkSession, d: str) -> DataFrame:
    first = spark.createDataFrame([("BUILDING", "x"), ("MACHINERY", "y")], "c_mktsegment string, a string")
    second = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("b"))
    rows = table(spark, d, "customer").join(F.broadcast(first), "c_mktsegment", "left").join(light(second), "c_nationkey", "left")
    return rows.select("c_custkey", F.coalesce("a", "b", F.lit("default")).alias("value"), F.when(F.col("a").isNotNull(), "segment").when(F.col("b").isNotNull(), "nation").otherwise("none").alias("basis"))


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


@query(f"""SELECT n_nationkey, s_suppkey, k, round(km, 4) AS km FROM (SELECT n_nationkey, s_suppkey, km, row_number() OVER (PARTITION BY n_nationkey ORDER BY round(km, 6), s_suppkey) AS k FROM (
 SELECT n_nationkey, s_suppkey, {_KM.format('(n_nationkey * 5.0 - 60)', '(n_nationkey * 11.0 - 130)', '((s_suppkey * 37) % 120 - 60)', '((s_suppkey * 91) % 300 - 150)')} AS km FROM nation JOIN supplier ON s_nationkey = n_nationkey)) WHERE k <= 3""")
def q_nearest_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(light(table(spark, d, "nation").select("n_nationkey")), F.col("s_nationkey") == F.col("n_nationkey"))
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    km = geo.haversine_km(n * 5.0 - 60, n * 11.0 - 130, (s * 37) % 120 - 60, (s * 91) % 300 - 150)
    w = Window.partitionBy("n_nationkey").orderBy(F.round("km", 6), "s_suppkey")
    return rows.select("n_nationkey", "s_suppkey", km.alias("km")).withColumn("k", F.row_number().over(w)).filter("k <= 3").withColumn("km", F.round("km", 4))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def q_admin_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(50).select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(total))  # total is one row
