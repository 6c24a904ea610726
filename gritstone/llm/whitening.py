"""Whitened embeddings by MLlib's block matrices.

1. Vectors become whole numbers. Each distinct one is a row of the fit list; its size n and the
   sums S by dimension give the exact centre S / n.
2. Rows of a saved table are numbered, centred as (n x - S) / n and dealt into blocks of a
   BlockMatrix, ROWS rows each.
3. Transpose times matrix is the scatter. Its inner dimension is split, so that many tasks
   multiply blocks and only d x d partial products meet; d x d numbers reach the driver.
4. eigh of scatter / n gives the components; a BlockMatrix product with the whitening matrix
   projects the blocks of all rows. Blocks come back as rows by number, a unique key, so that a
   vector which a third of all rows share makes no hot key.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import saved
from .vectors import finite, one_length, scaled

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows of a block.
ROWS = 1024
#: Blocks that one task multiplies into a partial scatter.
BLOCKS_A_TASK = 16
#: Share of the largest eigenvalue under which a direction counts as having no variance.
NO_VARIANCE = 1e-12


def numbered(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """df, saved with `number`, 0 to n - 1, and n. Places within a partition are saved with the rows, so they can't differ between reads; counts by partition pass the driver."""
    placed = saved(df.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), tag)
    counts = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([n for _, n in counts])
    starts = df.sparkSession.createDataFrame([(p, int(e - n)) for (p, n), e in zip(counts, ends, strict=True)], "part int, start bigint")  # one row a partition
    out = placed.join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.col("place")).drop("part", "place", "start")
    return out, int(ends[-1]) if len(ends) else 0


def blocks(df: DataFrame, rows: int, width: int) -> BlockMatrix:
    """A BlockMatrix of df(number, centred)."""
    vectors = MLUtils.convertVectorColumnsFromML(df.select(F.col("number").alias("index"), array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, rows, width).toBlockMatrix(ROWS, width)


def scatter(m: BlockMatrix) -> np.ndarray:
    """Transpose times m. PySpark's multiply() leaves out the number of splits of the inner dimension, without which one task would get all rows, so the JVM's is called."""
    splits = max(1, m.numRowBlocks // BLOCKS_A_TASK)
    across = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(across, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def times(m: BlockMatrix, right: np.ndarray) -> BlockMatrix:
    """m times a small local matrix, as one block."""
    sc = SparkSession.active().sparkContext
    own = BlockMatrix(sc.parallelize([((0, 0), Matrices.dense(*right.shape, right.reshape(-1, order="F").tolist()))]), *right.shape, *right.shape)
    return m.multiply(own)


def rows_of_blocks(m: BlockMatrix) -> DataFrame:
    """number, projected: the rows of a matrix one block wide."""

    def spread(block):
        (at, _), values = block
        return [(at * ROWS + k, row) for k, row in enumerate(values.toArray().tolist())]

    return SparkSession.active().createDataFrame(m.blocks.flatMap(spread), "number bigint, projected array<double>")


def _centred(n: int, sums: list[int]):
    to = F.zip_with("x", F.array(*(F.lit(s) for s in sums)), lambda x, s: F.lit(n) * x - s)
    return F.transform(to, lambda v: v.cast("double") / F.lit(float(n))), F.aggregate(to, F.lit(0).cast("bigint"), lambda a, v: a + v * v)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each kept row of vectors(vec_id, embedding) and component.

    Rows whose vector is null or holds null or non-finite entries are dropped. Repeated ids and rows,
    null ids too, each get their rows; equal vectors count once in the fit. Directions without variance
    (an eigenvalue of at most 1e-12 of the largest) have no component, so there may be fewer than
    16, and none where all vectors are equal. Other columns, whatever their names, are ignored; an
    empty table gives an empty table. Vectors of different lengths are a ValueError.
    """
    spark = vectors.sparkSession
    own = finite(vectors).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled("embedding", SCALE, SHIFT).alias("x"))
    rows, many = numbered(own, "vectors")
    width = one_length(rows, "x")
    nothing = rows.limit(0).selectExpr("vec_id", "1 as component", "1L as n", "1L as deviation", "1D as whitened", "1D as explained", "1D as identity_error")
    if not width:
        return nothing
    fit, n = numbered(rows.select("x").distinct(), "distinct")
    told = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).collect()  # one row a dimension
    centred, deviation = _centred(n, [r.s for r in sorted(told, key=lambda r: r.at)])
    fitted = blocks(fit.select("number", centred.alias("centred")), n, width)
    values, directions = np.linalg.eigh(scatter(fitted) / n)
    values, directions = values[::-1], directions[:, ::-1]
    use = min(components, int((values > max(values[0], 0) * NO_VARIANCE).sum()))
    if not use:
        return nothing
    projection = directions[:, :use] / np.sqrt(values[:use])
    error = float(np.abs(scatter(times(fitted, projection)) / n - np.eye(use)).max())
    placed = rows.select("number", "vec_id", deviation.alias("deviation"), centred.alias("centred"))
    projected = rows_of_blocks(times(blocks(placed, many, width), projection))
    share = spark.createDataFrame([(k + 1, float(values[k] / values.sum())) for k in range(use)], "component int, explained double")
    spread = placed.drop("centred").join(projected, "number").select("vec_id", "deviation", F.posexplode("projected").alias("at", "whitened"))
    return spread.join(F.broadcast(share), F.col("component") == F.col("at") + 1).select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")
    )


def op13_blockmatrix_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
