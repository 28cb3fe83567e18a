"""Vector columns as whole-number matrices, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components must be under this, so that squared norms fit 64 bits.
MOST = 1 << 28


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Without the rows whose vector is null or holds null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col(column).isNotNull() & ~F.exists(column, bad))


def whole(column: pa.Array, dim: int, factor: int) -> np.ndarray:
    """floor(factor * x) of every component as a row of dim integers; shorter vectors end in zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.floor(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64) * factor)
    if len(flat) and np.abs(flat).max() >= MOST:
        raise ValueError(f"a component times {factor} is beyond {MOST}: 64-bit scores would overflow")
    out = np.zeros((len(lengths), dim), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def longest(rows: DataFrame, column: str = "embedding") -> int:
    """The number of components of the longest vector, 0 without rows."""
    return rows.agg(F.max(F.size(column))).first()[0] or 0
