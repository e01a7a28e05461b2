"""Models by name, with one signature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..plans.folds import Fold
from . import benchmarks, neural
from .common import ModelSpec, Outcome

MODELS = {
    "lr": benchmarks.logistic_regression,
    "rf": benchmarks.random_forest,
    "mlp": neural.trunk_network,
    "deep_fm": neural.deep_fm,
    "esmm": neural.esmm,
    "fsiw": neural.fsiw,
}
#: How a fold is encoded once, and how candidates are fitted on that.
CANDIDATES = {
    "lr": (benchmarks.plan_regression, benchmarks.regression_candidates),
    "rf": (benchmarks.plan_forest, benchmarks.forest_candidates),
    "mlp": (neural.plan_trunk, neural.fit_candidates),
    "deep_fm": (neural.plan_machine, neural.fit_candidates),
    "esmm": (neural.plan_towers, neural.fit_candidates),
    "fsiw": (neural.plan_weighted, neural.fit_candidates),
}


def _known(name: str) -> None:
    if name not in MODELS:
        raise ValueError(f"Unknown model '{name}'. Choose from {sorted(MODELS)}.")


def fit_predict(name: str, rows: DataFrame, fold: Fold, spec: ModelSpec) -> Outcome:
    """Train on the fold's prepared rows and predict its test window."""
    _known(name)
    return MODELS[name](rows, fold, spec)


class Candidates:
    """A fold encoded once, on which any number of settings are fitted and scored."""

    def __init__(self, name: str, rows: DataFrame, fold: Fold, spec: ModelSpec):
        _known(name)
        encode, self._fit = CANDIDATES[name]
        self.plan = encode(rows, fold, spec)

    def predictions(self, specs: Sequence[ModelSpec]) -> DataFrame:
        """``candidate`` (from 0), ``impression_id``, ``y``, ``p`` of the fold's test rows."""
        return self._fit(self.plan, specs)
