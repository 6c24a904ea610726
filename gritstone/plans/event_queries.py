"""Queries on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gritstone.operators import events as E
from gritstone.sources.tables import latest, table

from .catalogue import query


@query("SELECT day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM events) LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) USING (day)")
def q_daily_histogram(spark: SparkSession, d: str) -> DataFrame:
    return E.daily(table(spark, d, "events"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS visitors FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1")
def q_event_totals(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    last = ev.agg((F.max("ts") - F.expr("interval 7 days")).alias("since"))
    return ev.join(F.broadcast(last), F.col("ts") >= F.col("since")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("visitors"))  # last is one row


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-15'")
def q_count_since(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'click' and ts >= timestamp '2024-01-15'").agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def q_unique_visitors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("visitors"))


@query("SELECT day, v AS views, c AS clicks, s AS signups, CAST(round(100 * c / nullif(v, 0)) AS INTEGER) AS click_rate, CAST(round(100 * s / nullif(c, 0)) AS INTEGER) AS signup_rate FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1)")
def q_funnel_ratio(spark: SparkSession, d: str) -> DataFrame:
    count = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(count("view", "views"), count("click", "clicks"), count("signup", "signups"))
    return days.withColumn("click_rate", E.ratio(F.col("clicks"), F.col("views"))).withColumn("signup_rate", E.ratio(F.col("signups"), F.col("clicks")))


@query("SELECT event_id, user_id, n, n <= 5 AS allowed FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) AS n FROM events)")
def q_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return E.rate_limited(table(spark, d, "events"), "user_id", 86_400, 5).select("event_id", "user_id", "n", "allowed")


@query("SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error') WHERE recent >= 3")
def q_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return E.cooldowns(table(spark, d, "events").filter("event_type = 'error'"), "user_id", 86_400, 3).select("event_id", "user_id", "recent")


@query("""SELECT user_id, event_type, first_id, length FROM (SELECT user_id, event_type, run, arg_min(event_id, (ts, event_id)) AS first_id, count(*) AS length FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events) GROUP BY user_id, event_type, run) WHERE length > 3""")
def q_loop_detection(spark: SparkSession, d: str) -> DataFrame:
    return E.runs(table(spark, d, "events"), "user_id", "event_type").filter("length > 3")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 2699999999 PRECEDING AND CURRENT ROW) AS active FROM events")
def q_lease_overlap(spark: SparkSession, d: str) -> DataFrame:
    return E.active_leases(table(spark, d, "events"), "user_id", 2700).select("event_id", "user_id", "active")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position, CAST(ceil(row_number() OVER (ORDER BY ts, event_id) / 10) * 45 AS BIGINT) AS wait FROM events WHERE event_type = 'view'")
def q_queue_position(spark: SparkSession, d: str) -> DataFrame:
    told = E.queue_positions(table(spark, d, "events").filter("event_type = 'view'"))
    return told.select("event_id", "position", (F.ceil(F.col("position") / 10) * 45).cast("bigint").alias("wait"))


@query("SELECT user_id, round(sum(greatest(0, least(value, 50) - 10)), 4) AS used FROM events GROUP BY 1")
def q_usage_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.least("value", F.lit(50.0)) - 10)), 4).alias("used"))


@query("SELECT days, count(*) FILTER (ts < last - to_days(CAST(days AS INTEGER))) AS expired, count(*) AS total FROM events, (SELECT max(ts) AS last FROM events), (SELECT unnest([7, 14, 21, 28]) AS days) GROUP BY days")
def q_retention_counts(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    last = ev.agg(F.max("ts").alias("last"))
    old = lambda days: F.count_if(F.col("ts") < F.col("last") - F.make_dt_interval(F.lit(days)))
    counts = ev.crossJoin(F.broadcast(last)).agg(*(old(x).alias(f"d{x}") for x in (7, 14, 21, 28)), F.count("*").alias("total"))  # last is one row
    return counts.select(F.inline(F.array(*(F.struct(F.lit(x).alias("days"), F.col(f"d{x}").alias("expired"), F.col("total").alias("total")) for x in (7, 14, 21, 28)))))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def q_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum, count(json_extract_string(props, '$.secret')) AS dropped FROM events GROUP BY 1")
def q_metadata_allowlist(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    kept = F.map_filter(props, lambda k, _: ~k.rlike("(?i)secret|token|phone|email"))
    rows = table(spark, d, "events").select("event_type", kept.alias("kept"), (F.size(props) - F.size(kept)).alias("dropped"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.element_at("kept", "k").try_cast("bigint")).alias("k_sum"), F.sum("dropped").cast("bigint").alias("dropped"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, greatest(count(*) - 5, 0) AS refused FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY 1, 2")
def q_streaming_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    from gritstone.streaming.limits import daily_counts

    return daily_counts(spark, d).withColumn("refused", F.greatest(F.col("n") - 5, F.lit(0)))
