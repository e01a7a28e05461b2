"""Rolling experiments: prepare, tune, fit, predict and evaluate fold by fold."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import MODELS, ModelSpec, Outcome, fit_predict
from ..operators import metrics
from ..operators.conform import Conformed
from ..operators.delays import time_span
from ..operators.maturity import mask_stats
from ..session import drop_stored, store, stored_mark
from ..sources.tables import write_table
from .folds import Fold, outer_folds
from .prepare import prepare_fold
from .tuning import Scorer, Search, tune_forest, tune_network


@dataclass(frozen=True)
class ExperimentConfig:
    model: str = "esmm"
    outer_lengths: tuple[int, int, int] = (25, 1, 1)
    inner_lengths: tuple[int, int, int] = (23, 1, 1)
    first_day: dt.date | None = None  # default: the first impression's day
    aux: str | None = "click"
    n_heads: int = 1
    calibrate: bool = False
    tune: bool = True
    seed: int = 42
    threads: int = 2
    score_by: str = "mean"  # or "median": how a candidate's inner folds are summed up
    require_mature_test: bool = False  # only folds whose test labels are final in the data
    params: dict[str, Any] = field(default_factory=dict)
    tuning: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class FoldResult:
    fold: Fold
    metrics: dict[str, float]
    outcome: Outcome
    mask_stats: dict[str, Any]
    search: Search | None
    note: str = ""


@dataclass(frozen=True)
class Report:
    """``metrics``: one row per fold and an AVG row."""

    metrics: DataFrame
    folds: tuple[FoldResult, ...]

    def write(self, target: str, **options) -> None:
        write_table(self.metrics, target, **options)


def spec_for(clean: Conformed, config: ExperimentConfig, params: dict[str, Any]) -> ModelSpec:
    return ModelSpec(
        categorical=clean.categorical, numeric=clean.numeric, aux=config.aux, n_heads=config.n_heads,
        calibrate=config.calibrate, seed=config.seed,
        max_delay_days=math.ceil(clean.horizon / 86_400), params=params,
    )


def plan_folds(clean: Conformed, config: ExperimentConfig) -> list[Fold]:
    span = time_span(clean.rows).first()
    if span["last_start"] is None:
        raise ValueError("The table has no impressions.")
    if span["last_event"] is None:
        raise ValueError("The table has no conversion timestamps.")
    first = config.first_day or span["first_start"].date()
    last = span["last_start"]
    if config.require_mature_test:
        final = span["last_event"].date() - dt.timedelta(days=math.ceil(clean.horizon / 86_400))
        last = min(last.date(), final + dt.timedelta(days=config.outer_lengths[1]))
    return outer_folds(first, last, config.outer_lengths)


def run_fold(clean: Conformed, fold: Fold, config: ExperimentConfig,
             previous: Search | None = None) -> FoldResult:
    """One outer fold.  Its prepared rows are written once; tuning starts from the unprepared
    rows, because categories unseen in an inner fold depend on that fold alone."""
    prepared = store(prepare_fold(clean.rows, fold, clean.cuts, clean.categorical, aux=config.aux))
    params, search = dict(config.params), None
    if config.tune:
        scorer = Scorer(clean.rows, fold, clean.cuts, spec_for(clean, config, params), config.model,
                        config.inner_lengths, how=config.score_by, threads=config.threads)
        last_best = (previous.best_params or None) if previous else None
        if config.model == "rf":
            search = tune_forest(scorer, previous=last_best, **config.tuning)
        else:
            search = tune_network(
                scorer, previous=last_best,
                previous_score=previous.best_score if previous else None, **config.tuning)
        params |= search.best_params
    outcome = fit_predict(config.model, prepared, fold, spec_for(clean, config, params))
    values = metrics.evaluate(outcome.predictions).first().asDict()
    untuned = search is not None and not search.best_params
    return FoldResult(fold, values, outcome, mask_stats(prepared, fold.train_end).first().asDict(), search,
                      "no inner fold could be scored: parameters are not tuned" if untuned else "")


def run_experiment(clean: Conformed, config: ExperimentConfig) -> Report:
    """All outer folds in order, carrying the best parameters forward."""
    if config.model not in MODELS:
        raise ValueError(f"Unknown model '{config.model}'. Choose from {sorted(MODELS)}.")
    results: list[FoldResult] = []
    previous = None
    spark = clean.rows.sparkSession
    for fold in plan_folds(clean, config):
        mark = stored_mark()
        result = run_fold(clean, fold, config, previous)
        drop_stored(spark, mark)  # predictions are kept on their own
        results.append(result)
        previous = result.search
    columns = ", ".join(f"{m} double" for m in metrics.METRICS)
    rows = [(r.fold.fold_id, *(float(r.metrics[m]) for m in metrics.METRICS)) for r in results]
    per_fold = spark.createDataFrame(rows, f"fold_id int, {columns}")
    return Report(metrics.average_folds(per_fold) if rows else per_fold, tuple(results))


def diagnostics(outcome: Outcome, *, calibrated: bool = False) -> dict[str, DataFrame]:
    """The tables behind a fold's plots: box statistics, reliability and calibration error,
    the latter two before and after calibration."""
    predictions = outcome.predictions
    tables = {
        "summary": metrics.summary(predictions, raw="p_raw"),
        "boxes": metrics.box_stats(predictions),
        "reliability": metrics.reliability(predictions),
        "calibration_error": metrics.calibration_error(predictions),
    }
    if calibrated:
        before = predictions.withColumn("p", F.col("p_raw"))
        tables["reliability_before"] = metrics.reliability(before)
        tables["calibration_error_before"] = metrics.calibration_error(before)
    if "aux_y" in predictions.columns:
        aux = predictions.select("impression_id", F.col("aux_y").alias("y"), F.col("aux_p").alias("p"))
        tables["boxes_aux"] = metrics.box_stats(aux)
    return tables


__all__: Sequence[str] = [
    "ExperimentConfig", "FoldResult", "Report", "run_experiment", "run_fold", "plan_folds",
    "diagnostics", "spec_for",
]
