"""Rolling time folds.  Plain date arithmetic: a fold costs no Spark job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_timestamp
from ..operators.conform import START


@dataclass(frozen=True)
class Fold:
    fold_id: int
    train_start: dt.date
    train_end: dt.date
    test_end: dt.date

    @property
    def test_start(self) -> dt.date:
        return self.train_end


def _as_date(value) -> dt.date:
    return value.date() if isinstance(value, dt.datetime) else value


def _rolling(start, last, train_days: int, test_days: int, step_days: int) -> list[Fold]:
    """Folds whose test window ends on or before ``last``."""
    if min(train_days, test_days, step_days) < 1:
        raise ValueError("Train, test and step lengths must be at least one day.")
    folds, cursor = [], _as_date(start)
    while True:
        train_end = cursor + dt.timedelta(days=train_days)
        test_end = train_end + dt.timedelta(days=test_days)
        if test_end > last:
            return folds
        folds.append(Fold(len(folds) + 1, cursor, train_end, test_end))
        cursor += dt.timedelta(days=step_days)


def outer_folds(first, last_impression, lengths: Sequence[int] = (25, 1, 1)) -> list[Fold]:
    """Stop once the test window would end after the day of the last impression."""
    return _rolling(first, _as_date(last_impression), *lengths)


def inner_folds(outer: Fold, lengths: Sequence[int] = (23, 1, 1)) -> list[Fold]:
    """Folds inside the outer training window; validation must end within it."""
    return _rolling(outer.train_start, outer.train_end, *lengths)


def folds_frame(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    rows = [(f.fold_id, f.train_start, f.train_end, f.test_start, f.test_end) for f in folds]
    return spark.createDataFrame(
        rows, "fold_id int, train_start date, train_end date, test_start date, test_end date")


def explode_folds(df: DataFrame, folds: Sequence[Fold], column: str = START, *, part: str = "all") -> DataFrame:
    """Each row once per fold whose window holds it, with ``fold_id``; ``part`` is "all" or "test".

    A row is compared with the (few) folds in a projection, so several folds are
    processed in one job without a range join.
    """
    def inside(f: Fold) -> Column:
        ts = F.col(column)
        return (ts >= as_timestamp(f.test_start if part == "test" else f.train_start)) & (ts < as_timestamp(f.test_end))

    members = F.array_compact(F.array(*[F.when(inside(f), F.lit(f.fold_id)) for f in folds]))
    return df.withColumn("fold_id", F.explode(members))


def by_fold(folds: Sequence[Fold], pick) -> Column:
    """A per-fold constant chosen by ``fold_id``: ``pick(fold)`` gives a literal."""
    chosen = None
    for f in folds:
        hit = F.col("fold_id") == f.fold_id
        chosen = F.when(hit, pick(f)) if chosen is None else chosen.when(hit, pick(f))
    return chosen
