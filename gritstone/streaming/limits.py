"""Event counts as a stream: a key's events in fixed day windows, late ones within the watermark too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritstone.operators.events import epoch_micros

from .runs import files_as_stream, run_to_end


def daily_counts(spark: SparkSession, sf_dir: str, lateness: str = "6 hours") -> DataFrame:
    """user_id, day, n of the events files, read as a stream to its present end.

    A day is told, and its state dropped, once the watermark has passed it; later rows of it are
    late and count no more. Days that the watermark hasn't passed at the end aren't told. The
    table of days lies in the shared folder, as does the stream's checkpoint, so a stream that is
    started again goes on where it was.
    """
    events = files_as_stream(spark, f"{sf_dir}/events.parquet")
    counts = events.withColumn("at", F.timestamp_micros(epoch_micros("ts"))).withWatermark("at", lateness).groupBy("user_id", F.window("at", "1 day")).agg(F.count("*").alias("n"))
    told = counts.select("user_id", F.date_from_unix_date((F.unix_seconds("window.start") / 86_400).cast("int")).alias("day"), "n")
    return run_to_end(told)
