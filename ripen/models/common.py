"""What all models share: their inputs, their splits and their result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import splits
from ..operators.calibration import Platt, apply_platt, fit_platt
from ..plans.folds import Fold
from ..session import cut


@dataclass(frozen=True)
class ModelSpec:
    """``n_heads`` is 1 (only the last label counts) or the number of delay buckets."""

    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    aux: str | None = "click"
    n_heads: int = 1
    calibrate: bool = False
    platt_slope: bool | None = None
    seed: int = 42
    max_delay_days: int | None = None
    params: Mapping[str, Any] = field(default_factory=dict)

    def settings(self, defaults: Mapping[str, Any]) -> dict[str, Any]:
        """Defaults overridden by the parameters that the model knows."""
        return {**defaults, **{k: v for k, v in self.params.items() if k in defaults}}


@dataclass(frozen=True)
class Outcome:
    """``predictions``: impression_id, y, p, p_raw (and aux_y, aux_p if there is a second
    task); materialised, because metrics read them several times."""

    predictions: DataFrame
    platt: Platt = Platt()
    notes: Mapping[str, Any] = field(default_factory=dict)


def late_splits(rows: DataFrame, fold: Fold, calibrate: bool) -> tuple[DataFrame | None, DataFrame]:
    """Calibration rows (the first day after training, if asked for) and test rows."""
    if not calibrate:
        return None, splits.test_split(rows, fold.test_start, fold.test_end)
    start, end = splits.calibration_bounds_after(fold.train_end)
    if end >= fold.test_end:
        raise ValueError("Calibration uses up the first test day: test windows need two days or more.")
    return splits.window_slice(rows, start, end), splits.test_split(rows, end, fold.test_end)


def finish(
    cal: DataFrame | None,
    test: DataFrame,
    logit: Column,
    raw: Column,
    label: Column,
    *,
    slope: bool = False,
    extra: Mapping[str, Column] | None = None,
    notes: Mapping[str, Any] | None = None,
) -> Outcome:
    """Predictions of the scored test rows, Platt-calibrated when ``cal`` is given."""
    platt = Platt()
    p = raw
    if cal is not None:
        platt = fit_platt(cal, logit, label, slope=slope)
        p = apply_platt(logit, platt)
    columns = {"y": label.cast("int"), "p": p, "p_raw": raw, **(extra or {})}
    predictions = test.select("impression_id", *[c.alias(name) for name, c in columns.items()])
    return Outcome(cut(predictions), platt, notes or {})


def stacked(predictions: Sequence[DataFrame]) -> DataFrame:
    """Predictions of several candidates in one table, with ``candidate`` counting from 0."""
    return reduce(DataFrame.union, [p.select(F.lit(i).alias("candidate"), "*") for i, p in enumerate(predictions)])


def probability_of_one(vector: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.element_at(vector_to_array(F.col(vector)), 2)
