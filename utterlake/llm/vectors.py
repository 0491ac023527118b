"""Vectors shared by the operators on embeddings: which rows count, and exact sums that leave Python for Spark."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of integers, wide enough for squares of longs; Spark adds them without rounding.
EXACT = "decimal(38,0)"


def finite(vector: Column, most: float) -> Column:
    """True for a vector that is not null and whose entries all are numbers smaller than ``most`` in size."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < most, F.lit(False)))


def common_length(vectors: DataFrame, vector_col: str) -> int:
    """The length that most vectors have, the larger of equally frequent ones; 0 for an empty table."""
    sizes = vectors.select(F.size(vector_col).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return first["d"] if first else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_array(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
