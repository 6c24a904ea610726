"""Queries on gates, tallies, ledgers, back-off, budgets, sessions and evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gritstone.operators import ledgers as L
from gritstone.operators.events import epoch_micros
from gritstone.sources.tables import table

from .catalogue import query
from .text_queries import _norm_sql

_CODES = ", ".join(f"'{r}'" for r in L.REASONS)
_FACTS = f"""WITH facts AS (SELECT doc_id * 2 + copy AS fact_id, CASE WHEN doc_id % 13 = 0 THEN -doc_id - 1 ELSE doc_id END AS page_id, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'RUMOUR' WHEN doc_id % 2 = 0 THEN ' fee ' ELSE 'Office' END AS kind,
  source AS subject, lang AS object, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'never printed on any page' WHEN doc_id % 17 = 0 THEN substr(text, 1, 5) ELSE substr(text, 1, 60) END AS evidence, doc_id % 5 - 1.0 AS confidence
  FROM documents, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR doc_id % 3 = 0),
 asked AS (SELECT f.*, upper(trim(kind)) AS k, {_norm_sql('evidence')} AS quote, d.doc_id IS NOT NULL AS there, {_norm_sql('d.text')} AS body FROM facts f LEFT JOIN documents d ON d.doc_id = f.page_id),
 ruled AS (SELECT *, CASE WHEN evidence IS NULL AND kind IS NULL THEN 'INVALID_SCHEMA' WHEN NOT there THEN 'MISSING_SOURCE' WHEN NOT coalesce(k IN ({', '.join(f"'{k}'" for k in L.KINDS)}), FALSE) THEN 'UNSUPPORTED_KIND' WHEN NOT coalesce(length(quote) >= 12 AND contains(body, quote), FALSE) THEN 'EVIDENCE_NOT_VERBATIM' END AS r FROM asked),
 gate AS (SELECT fact_id, subject, object, k AS kind, greatest(0, least(1, confidence)) AS confidence, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY page_id, k, subject, object, quote, r IS NULL ORDER BY fact_id) > 1 THEN 'DUPLICATE' ELSE r END AS reason, quote FROM ruled)
"""


def _gate(spark: SparkSession, d: str) -> DataFrame:
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    rows = docs.select("*", F.explode(F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    facts = rows.select(
        (k * 2 + F.col("copy")).alias("fact_id"), F.when(k % 13 == 0, -k - 1).otherwise(k).alias("page_id"),
        F.when(k % 29 == 0, F.lit(None)).when(k % 11 == 0, "RUMOUR").when(k % 2 == 0, " fee ").otherwise("Office").alias("kind"), F.col("source").alias("subject"), F.col("lang").alias("object"),
        F.when(k % 29 == 0, F.lit(None)).when(k % 7 == 0, "never printed on any page").when(k % 17 == 0, F.substring("text", 1, 5)).otherwise(F.substring("text", 1, 60)).alias("evidence"), (k % 5 - 1.0).alias("confidence"),
    )
    return L.gated(facts, docs.select(k.alias("page_id"), "text"))


@query(_FACTS + "SELECT fact_id, kind, CAST(confidence AS DOUBLE) AS confidence, reason, CASE WHEN reason = 'EVIDENCE_NOT_VERBATIM' THEN CASE WHEN coalesce(length(quote), 0) < 12 THEN 'shorter than a quote' ELSE 'not on the page' END END AS note FROM gate")
def q_claim_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).select("fact_id", "kind", "confidence", "reason", "note")


@query(_FACTS + f"""SELECT coalesce(code, reason) AS reason, count(reason) AS n, coalesce(array_to_string(list(fact_id ORDER BY fact_id) FILTER (reason IS NOT NULL AND k <= 5), ','), '') AS examples FROM (SELECT unnest([{_CODES}]) AS code) FULL JOIN (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY fact_id) AS k FROM gate WHERE reason IS NOT NULL) ON code = reason GROUP BY 1""")
def q_rejection_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return L.tally(_gate(spark, d).filter("reason is not null"), L.REASONS)


@query(_FACTS + "SELECT object AS dimension, count(*) AS considered, count(*) FILTER (reason IS NULL) AS kept, count(DISTINCT subject) FILTER (reason IS NULL) AS services, bool_or(reason IS NULL AND confidence = 1) AS answered, CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'NO_EVIDENCE_FOUND' ELSE 'FOUND' END AS status FROM gate GROUP BY 1")
def q_dimension_report(spark: SparkSession, d: str) -> DataFrame:
    kept = F.col("reason").isNull()
    return _gate(spark, d).groupBy(F.col("object").alias("dimension")).agg(
        F.count("*").alias("considered"), F.count_if(kept).alias("kept"), F.count_distinct(F.when(kept, F.col("subject"))).alias("services"), F.bool_or(kept & (F.col("confidence") == 1)).alias("answered"),
        F.when(F.count_if(kept) == 0, "NO_EVIDENCE_FOUND").otherwise("FOUND").alias("status"),
    )


@query(_FACTS + """, cases AS (SELECT subject || '|' || object AS case_id, object, count(DISTINCT fact_id) AS chunks, list(DISTINCT quote) AS quotes FROM gate WHERE reason IS NULL GROUP BY subject, object),
 dealt AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY sha1(case_id)) AS turn FROM cases)
 SELECT case_id, chunks, array_to_string(list_transform(list_sort(list_transform(quotes, lambda q: lpad(CAST(1000 - length(q) AS VARCHAR), 4, '0') || q))[1:3], lambda q: substr(q, 5)), '|') AS answers, row_number() OVER (ORDER BY turn, object) AS position FROM dealt ORDER BY turn, object LIMIT 10""")
def q_eval_cases(spark: SparkSession, d: str) -> DataFrame:
    from gritstone.functions.text import norm

    docs = table(spark, d, "documents").select("doc_id", "text")
    kept = _gate(spark, d).filter("reason is null").join(docs, F.col("fact_id") - F.col("fact_id") % 2 == F.col("doc_id") * 2)
    quote = norm(F.substring("text", 1, 60))
    each = kept.select("subject", "object", "fact_id", quote.alias("quote"))
    few = each.select("subject", "object", "quote").distinct().withColumn("k", F.row_number().over(Window.partitionBy("subject", "object").orderBy(F.desc(F.length("quote")), "quote"))).filter("k <= 3")
    answers = few.groupBy("subject", "object").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "quote"))), lambda x: x["quote"]), "|").alias("answers"))
    cases = each.groupBy("subject", "object").agg(F.count_distinct("fact_id").alias("chunks")).join(answers, ["subject", "object"]).withColumn("case_id", F.concat_ws("|", "subject", "object"))
    return L.dealt(cases, "object", "case_id", 10).select("case_id", "chunks", "answers", F.col("position").cast("bigint").alias("position"))


_WHEN = "CASE event_id % 5 WHEN 0 THEN 'HTTP_404' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'DNS_FAIL' WHEN 3 THEN 'TOO_THIN' ELSE 'ODD' END"


@query(f"""WITH last AS (SELECT user_id, arg_max({_WHEN}, event_id) AS reason, arg_max(ts, event_id) AS recorded_at FROM events WHERE event_type = 'error' GROUP BY 1),
 u AS (SELECT *, recorded_at + to_hours(CASE reason WHEN 'HTTP_404' THEN 8760 WHEN 'DNS_FAIL' THEN 168 WHEN 'TOO_THIN' THEN 720 ELSE 24 END) AS until FROM last)
 SELECT 'http://u' || user_id || '.example/' AS url, reason, strftime(until, '%Y-%m-%d %H:%M:%S') AS blocked_until FROM u WHERE until >= (SELECT max(ts) FROM events)""")
def q_negative_cache(spark: SparkSession, d: str) -> DataFrame:
    ev, k = table(spark, d, "events"), F.col("event_id") % 5
    reason = F.when(k == 0, "HTTP_404").when(k == 1, "TIMEOUT").when(k == 2, "DNS_FAIL").when(k == 3, "TOO_THIN").otherwise("ODD")
    failed = ev.filter("event_type = 'error'").select(F.concat(F.lit("http://u"), "user_id", F.lit(".example/")).alias("url"), reason.alias("reason"), F.col("ts").alias("recorded_at"), F.col("event_id").alias("seq"))
    now = ev.agg(F.max("ts").alias("now"))
    live = L.negatives(failed).crossJoin(F.broadcast(now)).filter("blocked_until >= now")  # now is one row
    return live.select("url", "reason", F.date_format("blocked_until", "yyyy-MM-dd HH:mm:ss").alias("blocked_until"))


@query("SELECT stage, count(*) AS n, sum(amount) AS amount FROM (SELECT o_orderstatus AS stage, o_shippriority AS amount FROM (SELECT o_orderstatus, o_orderkey % 7 AS o_shippriority FROM orders) WHERE o_orderstatus <> 'F' UNION ALL SELECT 'F', l_linenumber FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1")
def q_replace_stage(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "orders").select(F.col("o_orderstatus").alias("stage"), (F.col("o_orderkey") % 7).cast("bigint").alias("amount"))
    rows = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.lit("F").alias("stage"), F.col("l_linenumber").cast("bigint").alias("amount"))
    return L.replaced(stored, rows, ["F"]).groupBy("stage").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("""WITH s AS (SELECT page_id, url, length(html) % 23 - 5 AS score FROM pages), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, url) AS rank FROM s WHERE score >= 4)
 SELECT url, score, rank, CASE WHEN rank <= 60 THEN 'DISCOVERED' ELSE 'SKIPPED_OVER_CAP' END AS state FROM r UNION ALL SELECT url, score, NULL, 'SKIPPED_LOW_SCORE' FROM s WHERE score < 4""")
def q_url_states(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("url", (F.length("html") % 23 - 5).cast("bigint").alias("score"))
    return L.discovered(links, 60, 4)


@query(r"""WITH c AS (SELECT 'http://' || regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS url, page_id % 4 AS j, page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'T' || page_id END AS title, page_id % 5 = 0 AS verified, page_id % 7 = 0 AS failed FROM pages)
 SELECT url, array_to_string(list_sort(list(DISTINCT 'j' || j)), ',') AS journeys, arg_min(title, page_id) FILTER (title IS NOT NULL) AS title, bool_or(verified) AS verified, CASE WHEN bool_or(page_id % 2 = 0) THEN 'CACHED' WHEN bool_or(failed) THEN 'FETCH_FAILED' ELSE 'NO_CACHE_FILE' END AS status FROM c GROUP BY url""")
def q_source_ledger(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    rows = table(spark, d, "pages").withColumn("site", F.concat(F.lit("http://"), F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)))
    cited = rows.select(F.col("site").alias("url"), F.concat(F.lit("j"), k % 4).alias("journey"), k.alias("ord"), F.when(k % 3 != 0, F.concat(F.lit("T"), k)).alias("title"), (k % 5 == 0).alias("verified"), (k % 7 == 0).alias("failed"))
    return L.merged_sources(cited, rows.filter("page_id % 2 = 0").select(F.col("site").alias("url")))


@query("""WITH m AS (SELECT event_id, user_id, ts, CAST(CASE WHEN event_type = 'signup' THEN -40 ELSE event_id % 10 END AS BIGINT) AS amount FROM events),
 s AS (SELECT *, sum(amount) OVER w AS total FROM m WINDOW w AS (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
 SELECT event_id, CAST(spent AS BIGINT) AS spent, CAST(greatest(0, 20 - spent) AS BIGINT) AS remaining FROM (SELECT event_id, total - least(0, min(total) OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS spent FROM s)""")
def q_guest_budget(spark: SparkSession, d: str) -> DataFrame:
    moves = table(spark, d, "events").select("event_id", "user_id", "ts", F.floor(epoch_micros("ts") / 86_400_000_000).alias("day"), F.when(F.col("event_type") == "signup", -40).otherwise(F.col("event_id") % 10).cast("bigint").alias("amount"))
    told = L.clamped_balance(moves, ["user_id", "day"], ["ts", "event_id"])
    return told.select("event_id", F.col("spent").cast("bigint").alias("spent"), F.greatest(F.lit(0), 20 - F.col("spent")).cast("bigint").alias("remaining"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber AS n, lag('step' || l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS after, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= l_shipdate AS rising FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_shipdate))
 SELECT l_orderkey, count(*) AS steps, min(n) = 1 AND max(n) = count(*) AS gapless, coalesce(bool_and(rising), TRUE) AS ascending, coalesce(array_to_string(list(after ORDER BY n) FILTER (after IS NOT NULL), '>'), '') AS links FROM n GROUP BY 1""")
def q_step_runs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_shipdate").alias("at"))
    w = Window.partitionBy("l_orderkey").orderBy("n")
    rows = li.withColumn("after", F.lag(F.concat(F.lit("step"), "n")).over(w)).withColumn("rising", F.lag("at").over(w) <= F.col("at"))
    told = rows.groupBy("l_orderkey").agg(F.coalesce(F.bool_and("rising"), F.lit(True)).alias("ascending"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "after"))), lambda x: x["after"]), ">").alias("links"))
    return L.gapless(li, ["l_orderkey"], "n").join(told, "l_orderkey").select("l_orderkey", F.col("n").alias("steps"), "gapless", "ascending", "links")


@query("""SELECT user_id, count(*) AS sessions, max(live) AS most_at_once, max(live) > 2 AS over_concurrent, CAST(sum(ms) AS BIGINT) AS ms, sum(ms) > 1800000 AS over_day FROM (
 SELECT user_id, epoch_us(ts) // 86400000000 AS day, greatest(0, least(300000, CAST(floor(value * 1000) AS BIGINT))) AS ms, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS live FROM events WHERE event_type = 'click') GROUP BY user_id""")
def q_session_limits(spark: SparkSession, d: str) -> DataFrame:
    from gritstone.operators.events import active_leases

    calls = active_leases(table(spark, d, "events").filter("event_type = 'click'"), "user_id", 300)
    ms = F.greatest(F.lit(0), F.least(F.lit(300_000), F.floor(F.col("value") * 1000))).cast("bigint")
    told = calls.withColumn("ms", ms).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("active").alias("most_at_once"), F.sum("ms").alias("ms"))
    return told.select("user_id", "sessions", "most_at_once", (F.col("most_at_once") > 2).alias("over_concurrent"), "ms", (F.col("ms") > 1_800_000).alias("over_day"))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('view', 'click', 'signup') AND NOT props LIKE '%"k": 0}%') WHERE n <= 3""")
def q_event_ingest(spark: SparkSession, d: str) -> DataFrame:
    from gritstone.operators.events import rate_limited

    known = table(spark, d, "events").filter(F.col("event_type").isin("view", "click", "signup") & ~F.contains("props", F.lit('"k": 0}')))
    return rate_limited(known, "user_id", 3600, 3).filter("allowed").select("event_id", "user_id", "event_type")
