"""Logistic regression and random forest, fitted by Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logit
from ..operators import splits
from ..operators.conform import TARGET
from ..plans.folds import Fold
from ..session import cut
from ..sources.tables import present
from .common import ModelSpec, Outcome, finish, probability_of_one, stacked
from .features import fit_one_hot

# Settings of the two benchmark models.
LR_DEFAULTS = {"inverse_penalty": 1.0, "max_iter": 2000}
RF_DEFAULTS = {
    "n_trees": 500, "max_depth": None, "min_samples_leaf": 250, "max_features": "sqrt",
    "row_share": 0.7, "calibration_days": 1,
    "trees_at_once": 50,
}
DEEPEST_TREE = 30  # the deepest tree Spark grows
FOREST_EPS = 1e-7


@dataclass(frozen=True)
class OneHotPlan:
    """A fold's one-hot rows, stored once for any number of settings."""

    encoded: DataFrame
    n_rows: int
    cal: DataFrame | None
    test: DataFrame


def _features(train: DataFrame, spec: ModelSpec):
    return fit_one_hot(train, present(train, spec.categorical), present(train, spec.numeric))


def _one_hot(train: DataFrame, cal: DataFrame | None, test: DataFrame, spec: ModelSpec) -> OneHotPlan:
    splits.require_rows(train=train, test=test)
    features = _features(train, spec)
    encoded = cut(features.apply(train).select("features", F.col(TARGET).cast("double").alias("label")))

    def kept(df):
        return None if df is None else cut(features.apply(df).select("impression_id", "features", TARGET))

    return OneHotPlan(encoded, encoded.count(), kept(cal), kept(test))


def plan_regression(rows: DataFrame, fold: Fold, spec: ModelSpec) -> OneHotPlan:
    return _one_hot(splits.train_single(rows, fold.train_end), None,
                    splits.test_split(rows, fold.test_start, fold.test_end, mature_only=True), spec)


def fit_regression(plan: OneHotPlan, spec: ModelSpec):
    settings = spec.settings(LR_DEFAULTS)
    return LogisticRegression(
        regParam=1.0 / (settings["inverse_penalty"] * plan.n_rows), elasticNetParam=0.0,
        standardization=False, maxIter=settings["max_iter"], tol=1e-6,
    ).fit(plan.encoded)


def _regression_outcome(plan: OneHotPlan, spec: ModelSpec) -> Outcome:
    scored = fit_regression(plan, spec).transform(plan.test).withColumn("_p", probability_of_one())
    return finish(None, scored, logit(F.col("_p")), F.col("_p"), F.col(TARGET))


def certificate(plan: OneHotPlan, model, spec: ModelSpec) -> DataFrame:
    """Proof of a fit, in one aggregate over the training rows: at the optimum of the penalised loss the mean
    prediction is the base rate and no coefficient has a slope.  One row: n_rows, base_rate, mean_p,
    steepest (largest slope in absolute value)."""
    settings = spec.settings(LR_DEFAULTS)
    penalty = 1.0 / (settings["inverse_penalty"] * plan.n_rows)
    scored = model.transform(plan.encoded).withColumn("_off", probability_of_one() - F.col("label"))
    row = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("base_rate"), F.avg(probability_of_one()).alias("mean_p"),
        F.avg("_off").alias("at_intercept"), Summarizer.mean(F.col("features"), F.col("_off") + 1.0).alias("tilted"),
        Summarizer.mean(F.col("features")).alias("plain"), F.avg(F.col("_off") + 1.0).alias("weight")).first()
    # A weighted mean with weights 1 + off, times their mean, less the plain mean, leaves the mean of off * x.
    slopes = row["tilted"].toArray() * row["weight"] - row["plain"].toArray() + penalty * model.coefficients.toArray()
    steepest = max(abs(row["at_intercept"]), float(np.abs(slopes).max(initial=0.0)))
    return scored.sparkSession.createDataFrame(
        [(row["n"], float(row["base_rate"]), float(row["mean_p"]), steepest)], "n_rows long, base_rate double, mean_p double, steepest double")


def logistic_regression(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Outcome:
    """L2-penalised regression on mature rows.

    The penalty weighs 1 / (C n) because the loss is averaged over the n rows here.  It has
    no calibration step.
    """
    return _regression_outcome(plan_regression(rows, fold, spec), spec)


def plan_forest(rows: DataFrame, fold: Fold, spec: ModelSpec) -> OneHotPlan:
    """Calibration takes the last days of the training window."""
    settings = spec.settings(RF_DEFAULTS)
    train_end, cal = fold.train_end, None
    if spec.calibrate:
        start, end = splits.calibration_bounds_before(fold.train_end, settings["calibration_days"])
        train_end, cal = start, splits.window_slice(rows, start, end)
    return _one_hot(splits.train_single(rows, train_end), cal,
                    splits.test_split(rows, fold.test_start, fold.test_end, mature_only=True), spec)


def _tree_depth(settings) -> int:
    depth = DEEPEST_TREE if settings["max_depth"] is None else int(settings["max_depth"])
    if depth > DEEPEST_TREE:
        raise ValueError(f"max_depth={depth}: trees grow to a depth of {DEEPEST_TREE} at most; None asks for that.")
    return depth


def _grow(plan: OneHotPlan, settings, n_trees: int, seed: int):
    """Each row keeps its node of every tree, so a level costs one step a tree and not a walk from the root."""
    return RandomForestClassifier(
        numTrees=n_trees, maxDepth=_tree_depth(settings), minInstancesPerNode=int(settings["min_samples_leaf"]),
        featureSubsetStrategy=str(settings["max_features"]), subsamplingRate=float(settings["row_share"]), seed=seed,
        cacheNodeIds=True, checkpointInterval=10,
    ).fit(plan.encoded).copy()  # without the training summary, which would travel to the tasks


def _forest_scores(plan: OneHotPlan, spec: ModelSpec) -> tuple[DataFrame | None, DataFrame]:
    """Calibration and test rows with ``_p``, the mean probability of all trees.

    Trees grow in groups of ``trees_at_once``.  A group scores the rows it is asked for, its sums are added to
    those of the groups before, and it is dropped: the driver never holds more than one group, whatever
    the number of trees.
    """
    settings = spec.settings(RF_DEFAULTS)
    n_trees, at_once = int(settings["n_trees"]), int(settings["trees_at_once"])
    held = [None if df is None else df.withColumn("_sum", F.lit(0.0)) for df in (plan.cal, plan.test)]
    for number, first in enumerate(range(0, n_trees, at_once)):
        some = min(at_once, n_trees - first)
        model = _grow(plan, settings, some, int(spec.seed) + number)

        def added(df):
            if df is None:
                return None
            scored = model.transform(df).withColumn("_sum", F.col("_sum") + probability_of_one() * some)
            return cut(scored.drop("rawPrediction", "probability", "prediction"))

        held = [added(df) for df in held]
    return tuple(None if df is None else df.withColumn("_p", F.col("_sum") / n_trees) for df in held)


def _forest_outcome(plan: OneHotPlan, spec: ModelSpec) -> Outcome:
    cal, test = _forest_scores(plan, spec)
    slope = True if spec.platt_slope is None else spec.platt_slope
    return finish(cal, test, logit(F.col("_p"), FOREST_EPS), F.col("_p"), F.col(TARGET), slope=slope)


def random_forest(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Outcome:
    """Forest on mature rows."""
    return _forest_outcome(plan_forest(rows, fold, spec), spec)


def regression_candidates(plan: OneHotPlan, specs: Sequence[ModelSpec]) -> DataFrame:
    return stacked([_regression_outcome(plan, s).predictions.select("impression_id", "y", "p") for s in specs])


def forest_candidates(plan: OneHotPlan, specs: Sequence[ModelSpec]) -> DataFrame:
    """``candidate, impression_id, y, p`` of every spec, grown on the same stored rows."""
    return stacked([_forest_outcome(plan, s).predictions.select("impression_id", "y", "p") for s in specs])
