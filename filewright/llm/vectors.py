"""What the operators on embeddings share: which vectors take part, and their blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.llm._shared import stash


def usable(column: str = "embedding") -> Column:
    """Whether a vector is there, has a component, and holds no null or non-finite one."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad, F.lit(False))


def numbered(vectors: DataFrame, label: str, *more: str) -> DataFrame:
    """``(uid, vec_id, embedding array<double>, *more, dims)`` of every row; uid tells repeated rows apart."""
    doubles = F.col("embedding").cast("array<double>")
    return stash(vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", doubles.alias("embedding"), *more).withColumn("dims", F.coalesce(F.size("embedding"), F.lit(-1))), label)


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    joined = column.combine_chunks()
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.chunk(0)
    return joined.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(joined), -1)


def blocks(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))
