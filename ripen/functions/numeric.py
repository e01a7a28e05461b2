"""Null-safe scalar maths shared by encoders, calibration and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_log1p(column: Column) -> Column:
    """log(1 + max(x, 0)); null stays null (``greatest`` alone would skip it)."""
    return F.when(column.isNotNull(), F.log1p(F.greatest(column.cast("double"), F.lit(0.0))))


def sigmoid(column: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-column))


def clip_probability(column: Column, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(column, F.lit(eps)), F.lit(1.0 - eps))


def logit(column: Column, eps: float = 1e-12) -> Column:
    clipped = clip_probability(column, eps)
    return F.ln(clipped) - F.log1p(-clipped)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def bround_share(fraction: float, n: Column) -> Column:
    """Half-even rounding of ``fraction * n``, at least one row."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(fraction)) * n, 0).cast("long"))
