"""Rows of vectors as whole numbers, and as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str, most: float) -> Column:
    """Whether a vector is there, and all its components are below ``most`` in size; NaN and infinity are not."""
    return F.forall(vector, lambda c: F.abs(c.cast("double")) < F.lit(most))


def whole(vector: str, scale: int) -> Column:
    """Each component times ``scale``, rounded down, as a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, fill: int = 0) -> np.ndarray:
    """A column of lists of longs as a matrix; a shorter list ends in ``fill``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(len(column), dims)
    out = np.full((len(column), dims), fill, np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out
