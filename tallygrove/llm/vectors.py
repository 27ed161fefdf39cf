"""Vectors of a table: which take part, and their places in shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id whose vector is neither null nor zero and has only finite components, as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0.0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(finite & some, F.lit(False)))


def matrix(column) -> np.ndarray:
    """A pandas or list column of equally long arrays as a matrix."""
    return np.stack([np.asarray(x, np.float64) for x in column])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
