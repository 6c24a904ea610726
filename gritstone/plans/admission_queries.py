"""Queries on calls for lines, run as streams over the events to their present end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritstone.operators.events import epoch_micros
from gritstone.streaming.gate import Policy, gated
from gritstone.streaming.runs import files_as_stream, run_to_end

from .catalogue import query

_HOUR = 3_600_000


def _requests(spark: SparkSession, d: str, action: str) -> DataFrame:
    """A request for each event: sixteen pools of callers."""
    k = F.col("event_id")
    ticket = F.when(F.expr(action).isin("join", "poll", "leave") | ((F.expr(action) == "admit") & (k % 3 == 0)), F.concat(F.lit("t"), "user_id"))
    events = files_as_stream(spark, f"{d}/events.parquet")
    at = F.timestamp_micros(epoch_micros("ts")) if events.schema["ts"].dataType.typeName() == "timestamp_ntz" else F.col("ts")  # a clock without a zone has no missing hour
    return events.select(
        F.concat(F.lit("p"), F.col("user_id") % 16).alias("pool"), at.alias("at"), k.alias("seq"), F.expr(action).alias("action"),
        F.concat(F.lit("s"), "user_id").alias("session"), F.concat(F.lit("u"), "user_id").alias("subject"), (F.col("user_id") % 2 == 0).alias("guest"), ticket.alias("ticket"), F.lit("x").alias("token"), (F.col("value") * 1000).cast("bigint").alias("ms"),
    )


_LEASE_ACTION = "CASE WHEN event_id % 5 = 0 THEN 'release' WHEN event_id % 5 = 1 THEN 'beat' ELSE 'admit' END"
_LEASES = Policy(lines=3, lease_ms=3 * _HOUR, beat_ms=_HOUR, rate=1 << 30)


@query(f"""WITH RECURSIVE r AS (SELECT 'p' || (user_id % 16) AS pool, 's' || user_id AS session, epoch_ms(ts) AS now, event_id AS seq, {_LEASE_ACTION} AS action, row_number() OVER (PARTITION BY user_id % 16 ORDER BY epoch_ms(ts), event_id) AS k FROM events),
 st(pool, k, leases, seq, verdict) AS (SELECT DISTINCT pool, 0::BIGINT, []::STRUCT(s VARCHAR, u BIGINT)[], NULL::BIGINT, NULL::VARCHAR FROM r UNION ALL
  SELECT pool, k, CASE WHEN v IN ('ADMITTED', 'LIVE') THEN list_append(rest, {{'s': session, 'u': now + CASE v WHEN 'LIVE' THEN {_LEASES.beat_ms} ELSE {_LEASES.lease_ms} END}}) WHEN v = 'RELEASED' THEN rest ELSE live END, seq, v FROM (
   SELECT *, list_filter(live, lambda x: x.s <> session) AS rest, CASE action WHEN 'admit' THEN CASE WHEN len(live) >= {_LEASES.lines} THEN 'BUSY' ELSE 'ADMITTED' END WHEN 'beat' THEN CASE WHEN len(list_filter(live, lambda x: x.s = session AND x.u > now)) > 0 THEN 'LIVE' ELSE 'EXPIRED' END ELSE CASE WHEN len(list_filter(live, lambda x: x.s = session)) > 0 THEN 'RELEASED' ELSE 'GONE' END END AS v
   FROM (SELECT r.*, list_filter(st.leases, lambda x: x.u >= r.now) AS live FROM st JOIN r ON r.pool = st.pool AND r.k = st.k + 1)))
 SELECT pool, seq, verdict, len(leases)::INT AS active FROM st WHERE k > 0""")
def q_leases(spark: SparkSession, d: str) -> DataFrame:
    told = run_to_end(gated(_requests(spark, d, _LEASE_ACTION).withColumn("ticket", F.lit(None).cast("string")).withColumn("guest", F.lit(False)), _LEASES), rocks=True)
    return told.filter("seq is not null").select("pool", "seq", "verdict", "active")


_ACTION = "CASE WHEN event_type = 'error' THEN 'high' ELSE CASE event_id % 9 WHEN 0 THEN 'release' WHEN 1 THEN 'beat' WHEN 2 THEN 'join' WHEN 3 THEN 'poll' WHEN 4 THEN 'poll' WHEN 5 THEN 'leave' WHEN 6 THEN 'settle' ELSE 'admit' END END"


@query()
def q_admission(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain of checks; its rules are one after another, so it is held against a replay in the tests."""
    policy = Policy(lines=3, lease_ms=9 * _HOUR, beat_ms=3 * _HOUR, ticket_ms=12 * _HOUR, claim_ms=6 * _HOUR, rate=4, rate_ms=12 * _HOUR, high_ms=24 * _HOUR, cool_ms=24 * _HOUR)
    return run_to_end(gated(_requests(spark, d, _ACTION), policy), rocks=True)
