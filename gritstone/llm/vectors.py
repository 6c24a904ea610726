"""Embedding rows that can be worked with: whole, finite vectors of one length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor holds null or non-finite entries."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return df.filter(F.col(column).isNotNull() & good)


def one_length(df: DataFrame, column: str) -> int | None:
    """The length that all vectors of df have, None for an empty df; ValueError where lengths differ."""
    least, most = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if least != most:
        raise ValueError(f"vectors of {least} and of {most} entries in one table")
    return least


def scaled(column: str, factor: int, shift: int = 0) -> Column:
    """Each entry as long: floor(factor * entry) + shift, in double arithmetic."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("bigint") + F.lit(shift))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as rows x width."""
    return np.asarray(column.flatten()).reshape(len(column), width)
