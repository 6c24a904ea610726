"""Event logs: histograms, funnels, limits, cooldowns, runs, queues and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def epoch_micros(ts: str = "ts") -> Column:
    """Microseconds from 1970 of a timestamp without a zone, whatever the session's zone is."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86_400_000_000 + clock.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("bigint")


def epoch_seconds(ts: str = "ts") -> Column:
    return F.floor(epoch_micros(ts) / 1_000_000)


def daily(events: DataFrame, ts: str = "ts") -> DataFrame:
    """day, n for every day between the first and last event, days without events too."""
    counts = events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null")
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def rate_limited(events: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """events with their number in the key's fixed window, and whether that is within the limit."""
    start = (F.floor(epoch_seconds() / seconds) * seconds).alias("window_start")
    held = events.withColumn("window_start", start)
    w = Window.partitionBy(key, "window_start").orderBy("ts", "event_id")
    return held.withColumn("n", F.row_number().over(w)).withColumn("allowed", F.col("n") <= most)


def cooldowns(events: DataFrame, key: str, seconds: int, least: int) -> DataFrame:
    """Events that are at least the least-th of their key within the seconds that end with them."""
    w = Window.partitionBy(key).orderBy(epoch_seconds()).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(w)).filter(F.col("recent") >= least)


def runs(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, first_id, length of each unbroken run of one value of a key."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    turn = (F.col(value) != F.lag(value).over(w)).cast("int")
    marked = events.withColumn("run", F.sum(F.coalesce(turn, F.lit(0))).over(w))
    return marked.groupBy(key, "run", value).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.count("*").alias("length")).drop("run")


def ratio(part: Column, whole: Column) -> Column:
    """Whole per cents; null without a whole."""
    return F.round(100 * part / F.nullif(whole, F.lit(0))).cast("int")


def active_leases(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """events with the number of the key's leases of so many seconds that are live when each starts, its own included."""
    w = Window.partitionBy(key).orderBy(epoch_micros()).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("active", F.count("*").over(w))


def queue_positions(waiting: DataFrame) -> DataFrame:
    """waiting(ts, event_id) with position, first come first served, from 1.

    Places are counted within an hour; what waited in earlier hours comes from a running sum of
    the hours' counts, a row an hour, so no task sorts the whole queue.
    """
    held = waiting.withColumn("_hour", F.floor(epoch_seconds() / 3600))
    counts = held.groupBy("_hour").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_hour")) - F.col("_n")).select("_hour", "_before")
    own = F.row_number().over(Window.partitionBy("_hour").orderBy("ts", "event_id"))
    return held.join(before, "_hour").withColumn("position", F.col("_before") + own).drop("_hour", "_before")
