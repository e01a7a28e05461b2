"""Platt scaling by Newton's method, of many groups at once; each step is one aggregate over the calibration rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logit, sigmoid
from ..session import cut, small_side
from .heads import click_and_convert_probability, cross_entropy, hazard_probability


@dataclass(frozen=True)
class Platt:
    slope: float = 1.0
    intercept: float = 0.0


@dataclass
class _State:
    """One group's fit: where it stands, the sums there, and the step that is being tried."""

    platt: Platt
    at: Row
    da: float = 0.0
    db: float = 0.0
    step: float = 1.0
    steps: int = 0

    def direction(self, slope: bool, tolerance: float) -> bool:
        """Set the Newton direction; False when there is nothing left to gain."""
        at = self.at
        gradient = max(abs(at["gb"]), abs(at["ga"]) if slope else 0.0) / at["n"]
        if gradient < tolerance:
            return False
        determinant = at["haa"] * at["hbb"] - at["hab"] ** 2
        if slope and determinant > 0:
            self.da = (at["hbb"] * at["ga"] - at["hab"] * at["gb"]) / determinant
            self.db = (at["haa"] * at["gb"] - at["hab"] * at["ga"]) / determinant
        elif at["hbb"] > 0:
            self.da, self.db = 0.0, at["gb"] / at["hbb"]
        else:
            return False
        self.step = 1.0
        return True

    def candidate(self) -> Platt:
        return Platt(self.platt.slope - self.step * self.da, self.platt.intercept - self.step * self.db)


def _sums(cal: DataFrame, tried: dict[tuple, Platt], by: Sequence[str]) -> dict[tuple, Row]:
    """Loss, gradient and curvature of every group at its parameters, in one aggregate."""
    fields = [cal.schema[c] for c in by]
    schema = T.StructType([*[T.StructField(f"_{f.name}", f.dataType) for f in fields],
                           T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType())])
    # A row per group, as many as the driver holds already.
    at = cal.sparkSession.createDataFrame([(*g, float(p.slope), float(p.intercept)) for g, p in tried.items()], schema)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    x, y, z = F.col("x"), F.col("y"), F.col("_a") * F.col("x") + F.col("_b")
    p = sigmoid(z)
    residual, spread = p - y, p * (F.lit(1.0) - p)
    rows = cal.join(F.broadcast(at), same).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"),
        F.sum(cross_entropy(y, z)).alias("loss"),
        F.sum(residual).alias("gb"), F.sum(residual * x).alias("ga"),
        F.sum(spread).alias("hbb"), F.sum(spread * x).alias("hab"),
        F.sum(spread * x * x).alias("haa"),
    ).collect()
    return {tuple(r[c] for c in by): r for r in rows}


def fit_platt_groups(
    cal: DataFrame, x: Column | str, y: Column | str, by: Sequence[str], *,
    slope: bool = False, max_steps: int = 50, tolerance: float = 1e-10,
) -> dict[tuple, Platt]:
    """``sigmoid(slope * x + intercept)`` of every group (fold, head, candidate), all fitted side by side.

    A Newton step of all groups is one aggregate over the calibration rows.  Groups that have converged
    leave the next one; a group whose loss grew tries half the step.  A group without rows of both
    classes keeps the identity.  The driver holds one row per group.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    # Every step reads the pairs again: keep them, not what they are computed from.
    cal = cut(cal.select(*by, x.alias("x"), y.alias("y")))
    groups = [tuple(r) for r in cal.select(*by).distinct().collect()]
    found = {g: Platt() for g in groups}
    sums = _sums(cal, found, by) if groups else {}
    live = {}
    for group, at in sums.items():
        state = _State(Platt(), at)
        if at["pos"] not in (None, 0.0) and at["pos"] != at["n"] and state.direction(slope, tolerance):
            live[group] = state
    while live:
        there = _sums(cal, {g: s.candidate() for g, s in live.items()}, by)
        for group, state in list(live.items()):
            new = there[group]
            if new["loss"] <= state.at["loss"]:
                state.platt, state.at, state.steps = state.candidate(), new, state.steps + 1
                found[group] = state.platt
                if state.steps >= max_steps or not state.direction(slope, tolerance):
                    del live[group]
            else:
                state.step /= 2
                if state.step <= 1e-6:
                    del live[group]
    return found


def fit_platt(
    cal: DataFrame, x: Column | str, y: Column | str, *,
    slope: bool = False, max_steps: int = 50, tolerance: float = 1e-10,
) -> Platt:
    """Fit ``sigmoid(slope * x + intercept)``; without rows of both classes, the identity."""
    whole = fit_platt_groups(cal.withColumn("_all", F.lit(1)), x, y, ["_all"], slope=slope, max_steps=max_steps, tolerance=tolerance)
    return whole.get((1,), Platt())


def platt_frame(cal: DataFrame, fitted: dict[tuple, Platt], by: Sequence[str]) -> DataFrame:
    """``by, slope, intercept``; ``cal`` tells the types of the groups."""
    schema = T.StructType([*[cal.schema[c] for c in by], T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType())])
    return cal.sparkSession.createDataFrame([(*g, float(p.slope), float(p.intercept)) for g, p in fitted.items()], schema)


def calibrate_groups(
    cal: DataFrame, rows: DataFrame, x: str, y: str, by: Sequence[str], *, slope: bool = False, output: str = "p",
) -> DataFrame:
    """Fit every group on its ``cal`` rows and add the calibrated probability to its ``rows``; rows of a group without
    calibration rows keep the uncalibrated one."""
    fitted = fit_platt_groups(cal, x, y, by, slope=slope)
    side = platt_frame(cal, fitted, by).select(*[F.col(c).alias(f"_side_{c}") for c in by], F.col("slope").alias("_a"), F.col("intercept").alias("_b"))
    same = [F.col(c).eqNullSafe(F.col(f"_side_{c}")) for c in by]
    z = F.coalesce("_a", F.lit(1.0)) * F.col(x) + F.coalesce("_b", F.lit(0.0))
    return rows.join(small_side(side, len(fitted)), same, "left").select(*rows.columns, sigmoid(z).alias(output))


def apply_platt(x: Column, platt: Platt) -> Column:
    return sigmoid(F.lit(platt.slope) * x + F.lit(platt.intercept))


def hazard_logit(logits: Sequence[Column]) -> Column:
    """The single logit of a multi-head prediction."""
    return logit(hazard_probability(logits), 1e-12)


def click_and_convert_logit(click_logit: Column, conversion_logit: Column) -> Column:
    return logit(click_and_convert_probability(click_logit, conversion_logit), 1e-12)


def calibrate(
    cal: DataFrame, rows: DataFrame, x: Column, y: Column, *, slope: bool = False, output: str = "p",
) -> tuple[DataFrame, Platt]:
    """Fit on ``cal`` and add the calibrated probability to ``rows``."""
    platt = fit_platt(cal, x, y, slope=slope)
    return rows.withColumn(output, apply_platt(x, platt)), platt
