"""Train, calibration and test splits of a prepared fold.  All windows are half-open."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_timestamp, last_element
from .conform import START, TARGET
from .maturity import MASK_EVAL, supervised


def window_slice(df: DataFrame, start, end, column: str = START) -> DataFrame:
    """Rows with ``start <= column < end``.

    A table laid out by day also gets the filter on its day column, which prunes files.
    """
    low, high = as_timestamp(start), as_timestamp(end)
    kept = df.filter((F.col(column) >= low) & (F.col(column) < high))
    if "event_date" in df.columns:
        # An end at midnight needs nothing of its own day.
        last = F.to_date(high - F.expr("interval 1 microsecond"))
        kept = kept.filter((F.col("event_date") >= F.to_date(low)) & (F.col("event_date") <= last))
    return kept


def train_single(df: DataFrame, train_end) -> DataFrame:
    return supervised(df, train_end)


def train_multi(df: DataFrame, train_end) -> DataFrame:
    return supervised(df, train_end, any_head=True)


def train_all(df: DataFrame, train_end) -> DataFrame:
    """Every row before ``train_end``, mature or not (importance weighting corrects them)."""
    return df.filter(F.col(START) < as_timestamp(train_end))


def calibration_bounds_after(train_end: dt.date) -> tuple[dt.date, dt.date]:
    """The first day after training."""
    return train_end, train_end + dt.timedelta(days=1)


def calibration_bounds_before(train_end: dt.date, days: int = 1) -> tuple[dt.date, dt.date]:
    """The last ``days`` of the training window."""
    return train_end - dt.timedelta(days=days), train_end


def test_split(df: DataFrame, start, end, *, mature_only: bool = False) -> DataFrame:
    kept = window_slice(df, start, end)
    return kept.filter(last_element(F.col(MASK_EVAL)) == 1) if mature_only else kept


def label_balance(df: DataFrame) -> DataFrame:
    """Rows per label with the overall count and base rate (summed over the label rows)."""
    per_label = df.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n_label"))
    labels = Window.partitionBy(F.lit(1))
    positives = F.sum(F.col("n_label") * F.col(TARGET)).over(labels)
    return per_label.withColumn("n_rows", F.sum("n_label").over(labels)).withColumn(
        "base_rate", positives / F.col("n_rows"))


def require_rows(**splits: DataFrame) -> None:
    empty = [name for name, df in splits.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"No rows left in: {', '.join(empty)}")
