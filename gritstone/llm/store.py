"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a saved table of a few numbers or 16-byte keys that may be broadcast (about 30 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir or SparkContext.setCheckpointDir names it; in local mode without either, one of our own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
            held = sc._jsc.sc().getCheckpointDir()
        path = held.get()
    return path.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: a lost executor costs no more than its tasks.

    The folder belongs to the run, as checkpoints do; whoever set it clears it afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def light(df: DataFrame) -> DataFrame:
    """df, a saved table of numbers and short keys, marked for broadcast up to BROADCAST_ROWS rows; otherwise as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (one column, saved). A small table of ids travels to the rows; beyond, both sides are shuffled."""
    return df.join(light(ids.select(F.col(ids.columns[0]).alias(key)).distinct()), key, "left_semi")
