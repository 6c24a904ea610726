"""Files read as a stream to their present end, and the table that such a stream leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gritstone.sources.tables import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def files_as_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file, or a folder of them, as a stream."""
    parent, name = path.rsplit("/", 1)
    still = spark.read.parquet(path)
    alone = all(f.rsplit("/", 1)[-1] == name for f in still.inputFiles())  # one file of that name, not a folder of files
    reader = spark.readStream.schema(still.schema)
    return reader.option("pathGlobFilter", name).parquet(parent) if alone else reader.parquet(path)


def run_to_end(told: DataFrame, mode: str = "append", own: str | None = None, rocks: bool = False) -> DataFrame:
    """The rows that a stream tells until the present end of its source.

    Rows and checkpoint lie in `own`, a folder under the shared one unless it is given: a stream started again with the same one goes
    on where it was. With `rocks` its state is kept in RocksDB, which processors with named states need; the session's own choice comes back afterwards.
    """
    spark = told.sparkSession
    own = own or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER, None)
    if rocks:
        spark.conf.set(_PROVIDER, ROCKS)
    try:
        told.writeStream.outputMode(mode).format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{own}/state").start(f"{own}/out").awaitTermination()
    finally:
        if rocks:
            spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(told.schema).parquet(f"{own}/out")
