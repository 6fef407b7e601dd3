"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """A vector without null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def table_dimension(vectors: DataFrame, column: str) -> tuple[int, int]:
    """(length, rows) of the most frequent vector length, the longer one of
    ties; (0, 0) for none.  Rows of other lengths compare with nothing."""
    sizes = vectors.groupBy(F.size(column).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return (sizes[0]["dim"], sizes[0]["count"]) if sizes else (0, 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as a double matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
