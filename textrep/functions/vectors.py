"""Expressions and Arrow helpers for vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def normalized(vector: Column) -> Column:
    """Each vector divided by its L2 norm; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(
        vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))
    )


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(rows, -1)


def list_array(values: np.ndarray, dtype: pa.DataType) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    rows, width = values.shape
    offsets = pa.array(np.arange(0, (rows + 1) * width, width) if width else np.zeros(rows + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)).cast(dtype))
