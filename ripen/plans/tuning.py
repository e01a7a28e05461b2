"""Hyperparameter search over inner rolling folds.

Each inner fold is prepared, encoded and written once, whatever the number of candidates.  All
networks of a fold train together, a Spark job per epoch for all of them, and their losses are one
aggregate.  Folds run from a small thread pool on the driver, whose jobs share the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..models import Candidates, ModelSpec
from ..operators.metrics import candidate_scores, loss_metrics
from ..session import discard, store
from .folds import Fold, inner_folds
from .prepare import prepare_fold

# The two search spaces and their budgets.
LEAF_GRID = (10, 50, 100, 150, 200, 250)
LEAF_RANGE = (50, 300)
LEAF_DRAWS = 8
BATCH_SIZES = (256, 512, 1024, 2048)
EMB_DIMS = (4, 8, 16, 32)
HIDDEN_LAYERS = ((256, 256), (512, 512), (256, 128), (512, 256), (128, 128, 128), (512, 256, 128),
                 (256, 128, 64))
LEARNING_RATE = (1e-4, 5e-3)
WEIGHT_DECAY = (1e-7, 1e-3)
DROPOUT, DROPOUT_STEP = (0.0, 0.5), 0.05
EPOCHS = (10, 25)
AUX_WEIGHT = (0.05, 1.5)
SEARCH_SEED = 3
TRIALS, SHORT_TRIALS = 32, 12
CLOSE = 1.0

Params = dict[str, Any]


@dataclass(frozen=True)
class Trial:
    candidate: int
    params: Params
    score: float


@dataclass(frozen=True)
class Search:
    best_params: Params
    best_score: float
    trials: tuple[Trial, ...]


def grid_leaves(grid: Sequence[int] = LEAF_GRID) -> list[Params]:
    """Smallest leaf sizes to try, as listed."""
    return [{"min_samples_leaf": int(size)} for size in grid]


def drawn_leaves(rng: np.random.Generator, draws: int = LEAF_DRAWS, bounds: tuple[int, int] = LEAF_RANGE) -> list[Params]:
    """Smallest leaf sizes to try, drawn from the range, small ones first."""
    return grid_leaves(np.sort(rng.integers(bounds[0], bounds[1], size=draws, endpoint=True)))


def warm_first(candidates: Sequence[Params], previous: Params | None, name: str = "min_samples_leaf") -> list[Params]:
    """Candidates by value, each once; what was best before comes first unless it is among them."""
    by_value = {c[name]: c for c in candidates}
    start = {} if not previous or name not in previous else {int(previous[name]): {name: int(previous[name])}}
    new = {value: c for value, c in start.items() if value not in by_value}
    return [*new.values(), *by_value.values()]


def draw_network(rng: np.random.Generator, with_aux: bool) -> Params:
    """One seeded draw from the network space (rates on a log scale)."""
    def log_uniform(bounds):
        return float(np.exp(rng.uniform(np.log(bounds[0]), np.log(bounds[1]))))

    steps = int(round((DROPOUT[1] - DROPOUT[0]) / DROPOUT_STEP))
    params: Params = {
        "deep_hidden": HIDDEN_LAYERS[rng.integers(len(HIDDEN_LAYERS))],
        "learning_rate": log_uniform(LEARNING_RATE),
        "l2_weight_decay": log_uniform(WEIGHT_DECAY),
        "dropout_rate": round(DROPOUT[0] + DROPOUT_STEP * int(rng.integers(steps + 1)), 2),
        "epochs": int(rng.integers(EPOCHS[0], EPOCHS[1] + 1)),
        "batch_size": int(BATCH_SIZES[rng.integers(len(BATCH_SIZES))]),
        "emb_dim": int(EMB_DIMS[rng.integers(len(EMB_DIMS))]),
    }
    if with_aux:
        params["aux_weight"] = log_uniform(AUX_WEIGHT)
    return params


class Scorer:
    """Scores candidates on the inner folds of an outer fold, encoding each fold once."""

    def __init__(self, rows: DataFrame, outer: Fold, cuts, spec: ModelSpec, model: str,
                 lengths: Sequence[int], *, how: str = "mean", threads: int = 2):
        self.spark: SparkSession = rows.sparkSession
        self.model, self.spec, self.how, self.threads = model, spec, how, threads
        self.folds: list[tuple[Fold, Candidates]] = []
        for fold in inner_folds(outer, lengths):
            prepared = store(prepare_fold(rows, fold, cuts, spec.categorical, aux=spec.aux))
            self.folds.append((fold, Candidates(model, prepared, fold, spec)))
            discard(prepared)  # what candidates read is encoded
        self.results: list[tuple[int, int, float]] = []
        self.trials: list[Trial] = []

    def _on_fold(self, job) -> list[tuple[int, int, float]]:
        first, candidates, fold, encoded = job
        specs = [ModelSpec(**{**self.spec.__dict__, "params": {**self.spec.params, **p}}) for p in candidates]
        losses = loss_metrics(encoded.predictions(specs), by=["candidate"]).select("candidate", "rce").collect()
        return [(first + r["candidate"], fold.fold_id, float(r["rce"])) for r in losses]

    def score(self, candidates: Sequence[Params]) -> list[Trial]:
        """Mean (or median) relative cross entropy of each candidate."""
        first = len(self.trials)
        if not self.folds or not candidates:
            made = [Trial(first + i, dict(p), -math.inf) for i, p in enumerate(candidates)]
            self.trials += made
            return made
        jobs = [(first, candidates, fold, encoded) for fold, encoded in self.folds]
        with ThreadPool(self.threads) as pool:
            found = [r for some in pool.map(inheritable_thread_target(self.spark)(self._on_fold), jobs, chunksize=1) for r in some]
        self.results += found
        table = self.spark.createDataFrame(found, "candidate int, fold_id int, rce double")
        scores = {r["candidate"]: r["score"] for r in candidate_scores(table, self.how).collect()}
        made = [Trial(first + i, dict(p), scores[first + i]) for i, p in enumerate(candidates)]
        self.trials += made
        return made

    def best(self) -> Search:
        """Highest score; the earlier candidate wins a tie.  Without a usable score (no inner fold fits,
        or none could be scored) nothing is tuned: no parameters, at minus infinity."""
        usable = [t for t in self.trials if math.isfinite(t.score)]
        if not usable:
            return Search({}, -math.inf, tuple(self.trials))
        top = max(usable, key=lambda t: (t.score, -t.candidate))
        return Search(top.params, top.score, tuple(self.trials))


def tune_forest(scorer: Scorer, *, previous: Params | None = None, grid: Sequence[int] = LEAF_GRID,
                draws: int | None = None, bounds: tuple[int, int] = LEAF_RANGE) -> Search:
    """Score the grid, or ``draws`` seeded draws from the range instead."""
    tried = grid_leaves(grid) if draws is None else drawn_leaves(np.random.default_rng(scorer.spec.seed), draws, bounds)
    scorer.score(warm_first(tried, previous))
    return scorer.best()


def trials_left(warm_score: float | None, previous_score: float | None, budget: int = TRIALS,
                short: int = SHORT_TRIALS) -> int:
    """After re-scoring the previous best: few more trials if it still scores alike."""
    if warm_score is None or previous_score is None:
        return budget
    return short if abs(warm_score - previous_score) <= CLOSE else max(0, budget - 1)


def tune_network(scorer: Scorer, *, previous: Params | None = None, previous_score: float | None = None,
                 budget: int = TRIALS, short: int = SHORT_TRIALS, seed: int = SEARCH_SEED,
                 draw: Callable[[np.random.Generator, bool], Params] = draw_network) -> Search:
    """Seeded random search, warm-started with the previous fold's best."""
    warm = scorer.score([previous])[0].score if previous else None
    rng = np.random.default_rng(seed)
    left = trials_left(warm, previous_score, budget, short)
    scorer.score([draw(rng, scorer.spec.aux is not None) for _ in range(left)])
    return scorer.best()
