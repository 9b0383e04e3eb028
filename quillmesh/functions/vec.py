"""Vector algebra on array<double> columns, and NumPy twins for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(column: str | Column) -> Column:
    return F.col(column).cast("array<double>") if isinstance(column, str) else column.cast("array<double>")


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dist2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(dist2(a, b))


def gaussian(x: Column, mean: Column, precision: Column) -> Column:
    """Diagonal Gaussian log density without its constant; precision = 1 / (2 variance)."""
    spread = total(F.zip_with(F.zip_with(x, mean, lambda p, m: (p - m) * (p - m)), precision, lambda d, q: d * q))
    return F.lit(0.5) * total(F.transform(precision, lambda q: F.log(q))) - spread


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(total(F.transform(values, lambda v: F.exp(v - top))))


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        if column.null_count:
            raise ValueError("vectors must not be null")
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if not len(column):
            return flat.reshape(0, 0)
        if len(flat) % len(column) or any(n != len(flat) // len(column) for n in np.diff(column.offsets.to_numpy())):
            raise ValueError("vectors must have one dimension")
        return flat.reshape(len(column), -1)
    raise TypeError(f"not a list column: {column.type}")


def distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)
