"""Short fixed-length arrays: head labels and maturity masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0), int(size))


def last_element(column: Column) -> Column:
    """Last entry; null for an empty array (element_at raises there, and a filter on
    try_element_at over a literal array drops out of generated code)."""
    return F.get(column, F.size(column) - 1)


def any_one(column: Column) -> Column:
    return F.exists(column, lambda x: x == 1)


def all_ones(column: Column) -> Column:
    return F.forall(column, lambda x: x == 1)


def exploded_positions(column: Column, size: int, prefix: str) -> list[Column]:
    """The array as ``size`` scalar columns ``prefix1 .. prefixN``."""
    return [F.get(column, F.lit(k - 1)).alias(f"{prefix}{k}") for k in range(1, size + 1)]
