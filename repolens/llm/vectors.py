"""Reading vector columns: which rows take part, and their values in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, vec: str) -> int:
    """The commonest length of the vectors (0 if there is none); the smaller of two equally common."""
    row = df.where(F.size(vec) > 0).groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row.d if row else 0


def usable(df: DataFrame, vec: str, dim: int):
    """Column: the vector has ``dim`` components, all of them finite numbers, and isn't zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.col(vec).isNotNull() & (F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column of usable vectors as a (n, dim) float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim) if len(column) else np.empty((0, dim))
