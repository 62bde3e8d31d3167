"""Vectors as whole numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = 2.0**52  # whole numbers below it are exact as doubles, and so are sums that stay below it


def _infinite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | _infinite(x))
    return F.col(vector).isNotNull() & ~bad


def floored(vector: str, scale: int, offset: int = 0) -> Column:
    """floor(scale * x) + offset of every component; null for one that is not finite, as Spark may
    evaluate this before a filter."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(
        ~_infinite(x), F.floor(x * scale).cast("long") + F.lit(offset).cast("long")))


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), dims)
