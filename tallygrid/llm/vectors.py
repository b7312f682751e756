"""Helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = float(1 << 53)  # whole numbers below it are exact as doubles


def whole_numbers(rows: DataFrame, vector: str, steps: int) -> DataFrame:
    """``rows`` with the column ``x``: floor(``steps`` * component) for each component, as long.

    Rows whose vector is null or holds null or non-finite components are left out, as are those with a
    component of ``EXACT / steps`` or more, which no double holds to the unit.
    """
    doubles = F.transform(F.col(vector), lambda c: c.cast("double"))
    # A comparison with NaN is true in Spark (NaN is the greatest), so NaN fails the test as well.
    usable = F.forall(doubles, lambda c: c.isNotNull() & (F.abs(c) < EXACT / steps))
    kept = rows.where(F.col(vector).isNotNull() & usable)
    return kept.withColumn("x", F.transform(doubles, lambda c: F.floor(c * float(steps))))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int = 0) -> np.ndarray:
    """The vectors of a column of lists as the rows of an array of 64-bit numbers.

    Shorter vectors are filled up with zeros to the longest, or to ``dim``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    dim = max(dim, int(lengths.max(initial=0)))
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def key(vector: Column | str = "x") -> list[Column]:
    """Two hashes that stand for a vector."""
    return [F.xxhash64(vector).alias("v1"), F.xxhash64(vector, F.lit(1)).alias("v2")]
