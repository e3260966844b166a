"""Vector columns: normalisation, dense vectors from buckets, score conversions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsheet.functions.text import fixed_text

_ROWS_PER_BLOCK = 1024


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # The norm is a value of its own here; inside a lambda it would be computed per component.
    norms = F.array_repeat(norm, F.size(vector))
    return F.zip_with(
        vector, norms, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)).cast("float")
    )


def checked(vector: Column, dimension: int) -> Column:
    """The vector itself, or a failed task when its dimension is wrong or it is missing."""
    message = F.format_string(
        f"vector dimension %s does not match {dimension}", F.coalesce(F.size(vector), F.lit(-1))
    )
    fail = F.raise_error(message).cast(T.ArrayType(T.FloatType()))
    return F.when(F.size(vector) == dimension, vector).otherwise(fail)


def similarity(distance: Column) -> Column:
    """1 - squared distance of unit vectors, that is 2 cos - 1, from -3 to 1."""
    return 1 - distance


def cosine(distance: Column) -> Column:
    return 1 - distance / 2


def score_text(score: Column) -> Column:
    return fixed_text(score, 4)


def dense_counts(buckets: Column, dimension: int) -> Column:
    """Unit-length bag-of-words vector of each list of buckets, one Arrow batch at a time."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def densify(lists: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(lists), _ROWS_PER_BLOCK):
            block = lists.slice(start, _ROWS_PER_BLOCK)
            flat = block.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(block.offsets.to_numpy())
            row = np.repeat(np.arange(len(block), dtype=np.int64), lengths)
            counts = np.bincount(row * dimension + flat, minlength=len(block) * dimension)
            dense = counts.reshape(len(block), dimension).astype(np.float64)
            norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
            np.divide(dense, norm, out=dense, where=norm > 0)
            parts.append(dense.astype(np.float32))
        whole = np.concatenate(parts) if parts else np.zeros((0, dimension), np.float32)
        offsets = np.arange(len(whole) + 1, dtype=np.int32) * dimension
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.reshape(-1)))

    return densify(F.coalesce(buckets, F.array().cast("array<int>")))
