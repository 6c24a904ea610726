"""Queries on retrieval and on stored tables against wanted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritstone.functions import text as T
from gritstone.operators import retrieval as R
from gritstone.operators.search import few, light
from gritstone.sources import files
from gritstone.sources.tables import cut, table

from .catalogue import query
from .text_queries import _TOKENS

#: Words that every question brings along; a passage needs one of the others.
_COMMON = "the and of to in is that for on with as are at be this by an it or from de la le et les en der die und das".split()
#: Where a document lies, in SQL that both engines read; an item's own pages are those whose number ends as its own does, on its own host.
_HOST, _URL = "source || '.' || lang || '.example'", "'https://' || source || '.' || lang || '.example/' || doc_id"

_HITS = f"""WITH own AS (SELECT doc_id, {_TOKENS.format('text')} AS words, {_TOKENS.format("split_part(text, chr(10), 1)")} AS heading, {_URL} AS url, {_HOST} AS host FROM documents), term AS (SELECT DISTINCT doc_id, unnest(words) AS term FROM own),
 item AS (SELECT item_id, {_TOKENS.format('text')} AS iw FROM benchmark), part AS (SELECT item_id, half, unnest(list_distinct(CASE half WHEN 'head' THEN iw[1:6] ELSE iw[7:] END)) AS term FROM item, (SELECT unnest(['head', 'tail']) AS half)),
 hit AS (SELECT item_id, half, doc_id, count(*) AS score FROM part JOIN term USING (term) GROUP BY ALL HAVING count(*) >= 3 AND bool_or(NOT list_contains({_COMMON!r}, term))),
 best AS (SELECT item_id, doc_id, max(score) AS score, arg_min(half, (-score, half)) AS query, bool_or(half = 'head' AND score = 6) AS whole FROM hit GROUP BY ALL),
 topical AS (SELECT b.*, CASE WHEN o.doc_id % 100 = item_id % 100 AND len(host) % 5 = item_id % 5 THEN 3 WHEN list_has_all(heading, iw[1:2]) OR list_has_all(heading, iw[3:4]) THEN 2 WHEN list_has_all({_TOKENS.format('url')}, iw[1:2]) OR list_has_all({_TOKENS.format('url')}, iw[3:4]) OR host = 'src' || (item_id % 20) || '.en.example' THEN 1 ELSE 0 END AS topical FROM best b JOIN own o USING (doc_id) JOIN item USING (item_id)),
 few AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY whole DESC, topical DESC, score DESC, doc_id) AS rank FROM topical QUALIFY rank <= 30)
"""


def _shortlists(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    words = T.tokens(F.col("text"))
    halves = items.select("item_id", F.explode(F.array(F.struct(F.lit("head").alias("query"), F.slice(words, 1, 6).alias("w")), F.struct(F.lit("tail").alias("query"), F.slice(words, 7, 1 << 30).alias("w")))).alias("q"))
    asked = halves.select("item_id", "q.query", F.explode(F.array_distinct("q.w")).alias("term")).withColumn("anchor", ~F.col("term").isin(_COMMON))
    terms = few(asked, "term")  # those of the phrases are among them
    told = lambda w: w if terms is None else F.filter(w, lambda x: x.isin(terms))
    # a document is split into words once, and all that is found in it is summed up where it lies
    lies = cut(docs.select(
        "doc_id", told(F.array_distinct(words)).alias("words"), told(F.array_distinct(T.tokens(F.get(F.split("text", "\n"), F.lit(0))))).alias("heading"),
        told(T.tokens(F.expr(_URL))).alias("address"), F.expr(_URL).alias("url"), F.expr(_HOST).alias("host"),
    ).repartition("doc_id"))
    hits = lies.select("doc_id", F.explode("words").alias("term")).join(light(asked), "term").groupBy("item_id", "query", "doc_id").agg(F.count("*").alias("score"), F.bool_or("anchor").alias("anchored")).filter("score >= 3 and anchored")
    # what the services' own pages, hosts and phrases are
    phrases = items.select("item_id", F.array(F.slice(words, 1, 2), F.slice(words, 3, 2)).alias("phrases"))
    k, own_page = F.col("item_id"), F.col("doc_id") % 100 == F.col("item_id") % 100
    own_urls = F.when(own_page & (F.length("host") % 5 == k % 5), F.array("url")).otherwise(F.array().cast("array<string>"))
    own_hosts = F.array(F.concat(F.lit("src"), k % 20, F.lit(".en.example")))
    told = hits.join(lies.drop("words"), "doc_id").join(light(phrases), "item_id").select(
        k.alias("question_id"), "query", F.col("doc_id").alias("chunk_id"), "score", ((F.col("query") == "head") & (F.col("score") == 6)).alias("whole"),
        R.topicality_of(F.col("heading"), F.col("address"), F.col("url"), F.col("host"), F.col("phrases"), own_urls, own_hosts).alias("topical"),
    )
    return R.retrieved(items.select(k.alias("question_id")), told)


@query(_HITS + "SELECT item_id, doc_id, score, query, whole, topical, rank, CASE WHEN doc_id IS NULL THEN 'NO_EVIDENCE_FOUND' ELSE 'FOUND' END AS status FROM (SELECT item_id FROM benchmark) LEFT JOIN few USING (item_id)")
def q_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _shortlists(spark, d).select(F.col("question_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "score", "query", "whole", "topical", "rank", "status")


_REPLY = """, said AS (SELECT item_id, rank, least(3.0, greatest(0.0, CAST((item_id + rank * 7) % 5 AS DOUBLE))) AS relevance FROM (SELECT item_id, unnest([2, 1, 2, 5, 9, 12, 99]) AS rank FROM benchmark WHERE item_id % 4 <> 0) GROUP BY ALL),
 kept AS (SELECT f.item_id, f.doc_id, s.relevance, row_number() OVER (PARTITION BY f.item_id ORDER BY s.relevance DESC NULLS LAST, CASE WHEN f.item_id % 4 <> 0 THEN -topical END, CASE WHEN f.item_id % 4 <> 0 THEN -score END, f.rank) AS place FROM few f LEFT JOIN said s ON s.item_id = f.item_id AND s.rank = f.rank WHERE f.item_id % 4 = 0 OR s.relevance >= 2 QUALIFY place <= 8)
"""


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lists = cut(_shortlists(spark, d).filter("chunk_id is not null"))
    k = F.col("item_id")
    said = F.array(*(F.struct(F.lit(r).alias("id"), ((k + r * 7) % 5).cast("double").alias("relevance")) for r in (2, 1, 2, 5, 9, 12, 99)))
    replies = table(spark, d, "benchmark").select(k.alias("question_id"), F.when(k % 4 != 0, F.to_json(said)).otherwise("no answer").alias("reply"))
    return lists, R.reranked(lists, replies)


@query(_HITS + _REPLY + "SELECT item_id, doc_id, relevance, place, CASE WHEN item_id % 4 = 0 THEN 'RETRIEVAL' ELSE 'MODEL' END AS ranked_by FROM kept")
def q_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d)[1].select(F.col("question_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "relevance", "place", "ranked_by")


@query(_HITS + _REPLY + """, one AS (SELECT item_id, count(*) FILTER (doc_id IN (SELECT doc_id FROM few f WHERE f.item_id = kept.item_id AND rank <= 8)) AS agreed, count(*) AS n FROM kept GROUP BY 1),
 r AS (SELECT item_id, coalesce(min(rank) FILTER (f.doc_id IS NOT NULL), 0) AS r FROM (SELECT item_id, doc_id FROM kept WHERE place = 1) k LEFT JOIN few f USING (item_id, doc_id) GROUP BY 1)
 SELECT item_id % 4 AS grp, count(*) AS cases, sum(agreed) AS agreed, sum(n - agreed) AS rescued, round(avg(CASE WHEN r > 0 THEN 1.0 / r ELSE 0 END), 6) AS mrr, CAST(round(100 * count(*) FILTER (r BETWEEN 1 AND 5) / count(*)) AS INTEGER) AS hit_5 FROM one JOIN r USING (item_id) GROUP BY 1""")
def q_rerank_eval(spark: SparkSession, d: str) -> DataFrame:
    lists, kept = _kept(spark, d)
    kept = cut(kept)
    group = (F.col("question_id") % 4).alias("grp")
    both = R.agreement(kept, lists).groupBy(group).agg(F.sum("agreed").alias("agreed"), F.sum("rescued").alias("rescued"))
    found = R.ranks(lists, kept.filter("place = 1")).withColumn("grp", F.col("question_id") % 4)
    return R.measured(found, "grp").select("grp", "cases", "mrr", "hit_5").join(both, "grp").select("grp", "cases", "agreed", "rescued", "mrr", "hit_5")


@query("""WITH l AS (SELECT user_id AS q, 1 + event_id % 2 AS pass, CASE WHEN event_type = 'error' THEN 'v1' ELSE 'v2' END AS v, value > 60 AS found FROM events)
 SELECT q AS user_id, CASE WHEN count(*) FILTER (v = 'v2') = 0 THEN 1 WHEN NOT bool_or(found) FILTER (v = 'v2') AND max(pass) FILTER (v = 'v2') < 2 THEN max(pass) FILTER (v = 'v2') + 1 END AS pass FROM l GROUP BY q""")
def q_next_pass(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("question_id"), (F.col("event_id") % 2 + 1).alias("pass"), F.when(F.col("event_type") == "error", "v1").otherwise("v2").alias("retriever"), F.when(F.col("value") > 60, "FOUND").otherwise("NO_EVIDENCE_FOUND").alias("status"))
    return R.next_pass(rows, "v2").select(F.col("question_id").alias("user_id"), "pass")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 7 <> 0)
 SELECT k, CASE WHEN b.k IS NULL THEN 'EXTRA' WHEN a.k IS NULL THEN 'MISSING' ELSE 'CHANGED' END AS kind FROM a FULL JOIN b USING (k) WHERE a.s IS DISTINCT FROM b.s""".replace("SELECT k, CASE WHEN b.k", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k").replace("FULL JOIN b USING (k)", "FULL JOIN b ON a.k = b.k"))
def q_readback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    stored = rows.filter("k % 11 <> 0")
    wanted = rows.filter("k % 7 <> 0").select("p", F.when(F.col("k") % 13 == 0, "X").otherwise(F.col("s")).alias("s"), "k")
    return files.differences(stored, wanted, ["k"])


@query("SELECT s_suppkey, s_suppkey || chr(9) || count(*) || chr(9) || array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), ',') || chr(9) || array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS line FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) GROUP BY 1")
def q_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    near = table(spark, d, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("s_nationkey"))
    own = files.pruned(table(spark, d, "supplier"), near, ["s_nationkey"])
    return files.fingerprints(own.join(table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")), "s_suppkey", {"parts": "l_partkey", "flags": "l_returnflag"})


@query(r"""WITH l AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'http://shared.example/' || page_id % 20 ELSE 'http://' || regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) || '/' END AS url, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host, page_id % 9 AS score, page_id FROM pages)
 SELECT url, count(*) AS n, array_to_string(list_sort(list(DISTINCT host)), ',') AS hosts, max(score) AS score, 'p' || min(page_id) AS title FROM l GROUP BY url""")
def q_link_harvest(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)
    k = F.col("page_id")
    links = table(spark, d, "pages").select(F.when(k % 3 == 0, F.concat(F.lit("http://shared.example/"), k % 20)).otherwise(F.concat(F.lit("http://"), host, F.lit("/"))).alias("url"), host.alias("host"), (k % 9).alias("score"), F.concat(F.lit("p"), k).alias("title"), k.alias("ord"))
    return files.harvested(links).select("url", "n", F.array_join("hosts", ",").alias("hosts"), "score", "title")


@query("SELECT 'e' || l_orderkey || '_' || l_linenumber AS id, 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 JOIN part ON p_partkey = l_partkey AND p_size > 10")
def q_live_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("e"), "l_orderkey", F.lit("_"), "l_linenumber").alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return files.live_edges(edges, table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")), table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("id"))).select("id", "src", "dst")
