"""Distances of vectors: column expressions, and products of whole batches."""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x.cast("double") / length))).otherwise(F.transform(a, lambda x: x.cast("double")))


def scores(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Nearness, greater is nearer: dot products, or squared distances below zero. A row for each row, a column for each query."""
    if metric == "dot":
        return rows @ queries.T
    return 2 * rows @ queries.T - (rows**2).sum(1)[:, None] - (queries**2).sum(1)[None, :]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def half(a: np.ndarray) -> np.ndarray:
    """Values as a 16-bit float keeps them."""
    return a.astype(np.float16).astype(np.float32)


def records_per_block(dim: int, item_bytes: int = 2, block: int = 65536) -> int:
    """Records (vector and 4-byte id) that fit a block less its 4-byte count."""
    return (block - 4) // (dim * item_bytes + 4)


def cached_buckets(cache_bytes: int, bucket_size: int, dim: int, item_bytes: int = 4) -> int:
    """Buckets that a cache of so many bytes holds, one at least."""
    return max(1, cache_bytes // (bucket_size * (dim * item_bytes + 4))) if cache_bytes else 1
