"""Vectors as integers: which rows take part, and Arrow list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1024.0
#: Integer components beyond this take this value, so that squares and their sums stay bounded.
LIMIT = float(1 << 40)
LONG = (1 << 63) - 1


def usable(vector: str) -> Column:
    """True for a vector that is there and all of whose components are finite numbers."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def integers(column, width: int) -> np.ndarray:
    """floor(1024 * x) of usable vectors as doubles, one row each; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten()).astype(np.float64)
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(values * SCALE), -LIMIT, LIMIT)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T with Python's integers, cut to 64 bits; for few vectors with huge components."""
    big = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return np.clip(big, -LONG - 1, LONG).astype(np.int64)
