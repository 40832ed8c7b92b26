"""Dense vector columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clausework.functions.text import _c


def dot(left, right) -> Column:
    """Inner product in double precision, summed in index order."""
    pairs = F.zip_with(_c(left), _c(right), lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(col, dimension: int) -> Column:
    """Unit-length copy; null for a wrong dimension, a zero vector or a non-finite component."""
    v = F.transform(_c(col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    usable = (F.size(v) == dimension) & (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(usable, F.transform(v, lambda x: x / norm))
