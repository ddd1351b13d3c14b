"""Shared handling of vector columns: which rows take part, and dense matrices from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def widest(df: DataFrame, column: str) -> int:
    return df.agg(F.max(F.size(column))).first()[0] or 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype=np.float64) -> np.ndarray:
    """One row per list; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, width), dtype=dtype)
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    if len(sizes) and (sizes == width).all():
        return values.astype(dtype).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def best_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]
