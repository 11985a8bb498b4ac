"""Cosine distance as a column expression and as an Arrow batch kernel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCE_DIGITS = 9


def rounded(value: Column, digits: int) -> Column:
    """Round and turn negative zero into zero."""
    return F.round(value, digits) + F.lit(0.0)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos(a, b)`` in double precision; null when either vector has no length."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, F.lit(1.0) - _dot(a, b) / norms)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles with one unit vector per row (zero vectors become NaN)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return values.reshape(0, 0)
    if len(values) % n or len(values) == 0:
        raise ValueError("vectors of one column must all have the same dimension")
    widths = np.diff(column.offsets.to_numpy())
    if not (widths == widths[0]).all():
        raise ValueError("vectors of one column must all have the same dimension")
    return unit_rows(values.reshape(n, -1))


def unit_rows(values: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", values, values))
    norms[norms == 0] = np.nan
    return values / norms[:, None]


def distances(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Rounded cosine distances, queries by corpus; what is not comparable is infinitely far."""
    if queries.shape[1] != corpus.shape[1]:
        raise ValueError(f"query dimension {queries.shape[1]} differs from corpus dimension {corpus.shape[1]}")
    far = np.round(1.0 - queries @ corpus.T, DISTANCE_DIGITS) + 0.0
    far[np.isnan(far)] = np.inf
    return far


def nearest_places(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest finite distances of one query, equal distances in order of id."""
    places = np.nonzero(np.isfinite(dist))[0]
    if len(places) > k:
        edge = np.partition(dist[places], k - 1)[k - 1]
        places = places[dist[places] <= edge]
    return places[np.lexsort((ids[places], dist[places]))[:k]]
