"""Day arithmetic on columns; the same arithmetic on plain dates lives in plans.folds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_timestamp(value) -> Column:
    """A timestamp column from a column, a date, a datetime or text."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, dt.datetime) or isinstance(value, str):
        return F.to_timestamp(F.lit(str(value)))
    return F.to_timestamp(F.lit(value.isoformat()))


def day_floor(column: Column) -> Column:
    return F.date_trunc("day", column)


def add_days(column: Column, days: int) -> Column:
    return F.date_add(column, int(days))


def epoch_seconds(column: Column) -> Column:
    """Whole seconds since 1970, floored (a session in UTC is assumed)."""
    return column.cast("timestamp").cast("long")


def seconds_since(column: Column, moment) -> Column:
    """Age of ``column`` at ``moment`` in whole seconds."""
    return epoch_seconds(as_timestamp(moment)) - epoch_seconds(column)
