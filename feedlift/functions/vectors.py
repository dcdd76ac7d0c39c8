"""Distances between embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlift.functions.text import as_column


def _flat(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components one after the other, and which of them are there."""
    flat = vectors.flatten()
    return pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(flat).to_numpy(zero_copy_only=False)


def _cosine_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distances of many pairs of vectors, from three sums over flat arrays."""
    out, known = np.zeros(len(a)), np.zeros(len(a), bool)
    lengths = [pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False) for v in (a, b)]
    rows = np.flatnonzero((lengths[0] == lengths[1]) & (lengths[0] > 0))
    if len(rows):
        (x, there_x), (y, there_y) = (_flat(v.take(pa.array(rows))) for v in (a, b))
        n = lengths[0][rows]
        first = np.cumsum(n) - n
        xy, xx, yy = (np.add.reduceat(p, first) for p in (x * y, x * x, y * y))
        norm = np.sqrt(xx * yy)
        ok = np.logical_and.reduceat(there_x & there_y, first) & (norm != 0)
        out[rows[ok]] = 1.0 - xy[ok] / norm[ok]
        known[rows[ok]] = True
    return pa.array(out, mask=~known)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """NULL for a vector of zeros, for vectors of different length and where a component is missing. Computed over Arrow
    batches, a whole batch at a time."""
    a = as_column(a).cast("array<double>")
    b = as_column(b).cast("array<double>")
    return F.arrow_udf(_cosine_distances, "double")(a, b)


def distance_bucket(distance: Column | str) -> Column:
    """Upper edge of the tenth a distance falls into."""
    return F.ceil(as_column(distance).cast("double") * 10) / F.lit(10.0)
