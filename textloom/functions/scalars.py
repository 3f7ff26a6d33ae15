"""Scalar column functions that are safe under ANSI arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def safe_divide(x, y, otherwise: float = 0.0) -> Column:
    """x / y; otherwise where y is 0 or either is null."""
    return F.coalesce(F.try_divide(_c(x).cast("double"), _c(y).cast("double")), F.lit(otherwise))


def sum_score(x, y) -> Column:
    """Sum of the positive parts."""
    return F.greatest(_c(x), F.lit(0)) + F.greatest(_c(y), F.lit(0))


def logit_clip(p, floor: float = -12.0) -> Column:
    """ln(p / (1 - p)), not under the floor; null stays null, 0 gives the floor and 1 infinity, and what is above 1 has none and gives NaN."""
    p = _c(p).cast("double")
    inner = F.greatest(F.ln(F.try_divide(p, 1 - p)), F.lit(floor))
    return F.when(p.isNull(), None).when(p <= 0, F.lit(floor)).when(p > 1, F.lit(float("nan"))).when(p == 1, F.lit(float("inf"))).otherwise(inner)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x).cast("double")))


def row_mean(cols: Sequence) -> Column:
    """Mean over columns, passing over nulls; null where all are."""
    cs = [_c(c).cast("double") for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    return F.try_divide(total, n)


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Sum of columns times weights, nulls as 0."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(w)) for c, w in weights.items()]
    return sum(parts[1:], parts[0])
