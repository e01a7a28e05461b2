"""The network models: trunk, factorization machine, two towers, importance weighted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import any_one, hash_keep, logit, sigmoid
from ..operators import heads, numerics, shift, splits
from ..operators.calibration import calibrate_groups, hazard_logit
from ..operators.conform import HEADS, TARGET
from ..operators.maturity import MASK_TRAIN
from ..plans.folds import Fold
from ..session import cut, store
from ..sources.tables import present
from .common import ModelSpec, Outcome, finish, late_splits, probability_of_one, stacked
from .features import MOST_CATEGORIES, DenseEncoder, dense_vector, fit_dense
from .network import Shape
from .trainer import DEFAULTS, MACHINE_DEFAULTS, Fitted, Job, Layout, train_many

# Settings of the two boosted selection models.
SELECTION_DEFAULTS = {
    "selection_rate": 0.01, "selection_depth": 6, "selection_trees": 1000,
    "selection_holdout": 0.10, "tau_days": shift.DEFAULT_TAU_DAYS,
}


def _hidden(value) -> tuple[int, ...]:
    if isinstance(value, str):
        value = [part for part in value.strip("()").split(",") if part.strip()]
    return tuple(int(h) for h in value)


def _encoder(train: DataFrame, spec: ModelSpec, unseen: str) -> DenseEncoder:
    return fit_dense(train, present(train, spec.categorical), present(train, spec.numeric), unseen=unseen)


def _layout(encoder: DenseEncoder, n_heads: int, aux: bool) -> Layout:
    return Layout(
        tuple(encoder.index_columns), tuple(encoder.numeric_columns),
        tuple(f"y{k}" for k in range(1, n_heads + 1)), tuple(f"w{k}" for k in range(1, n_heads + 1)),
        "aux_y" if aux else None,
    )


def _labels(spec: ModelSpec, risk_set: bool) -> dict[str, Column]:
    """Labels ``y1..``, weights ``w1..`` and the second task's label of the training rows."""
    columns: dict[str, Column] = {}
    if spec.n_heads == 1:
        columns |= {"y1": F.col(TARGET), "w1": F.lit(1.0)}
    else:
        risk = heads.at_risk(F.col(HEADS), spec.n_heads)
        for k in range(1, spec.n_heads + 1):
            mature = F.get(F.col(MASK_TRAIN), F.lit(k - 1))
            columns[f"y{k}"] = F.get(F.col(HEADS), F.lit(k - 1))
            columns[f"w{k}"] = mature * risk[k - 1] if risk_set else mature
    if spec.aux:
        columns["aux_y"] = heads.clipped_label(F.col(spec.aux))
    return columns


@dataclass(frozen=True)
class Plan:
    """A fold's encoded rows, ready for any number of settings: nothing here depends on what is tuned."""

    kind: str
    encoder: DenseEncoder
    layout: Layout
    train: DataFrame
    cal: DataFrame | None
    test: DataFrame
    n_out: int
    defaults: Mapping[str, Any]
    #: Logit, uncalibrated probability and label of scored rows.
    z: Column
    raw: Column
    label: Column
    extra: Mapping[str, Column]
    product: bool = False
    notes: Mapping[str, Any] = field(default_factory=dict)

    def job(self, spec: ModelSpec) -> Job:
        settings = spec.settings(self.defaults)
        shape = Shape(self.kind, self.encoder.sizes, len(self.encoder.numeric_columns), int(settings["emb_dim"]),
                      _hidden(settings["deep_hidden"]), self.n_out)
        return Job(shape, settings, spec.seed, self.product)

    def outcome(self, fitted: Fitted, spec: ModelSpec) -> Outcome:
        def score(df):
            return None if df is None else fitted.logits(df)

        return finish(score(self.cal), score(self.test), self.z, self.raw, self.label, slope=bool(spec.platt_slope),
                      extra=self.extra, notes=self.notes)


def _run(plan: Plan, spec: ModelSpec) -> Outcome:
    return plan.outcome(train_many(plan.train, [plan.job(spec)], plan.layout)[0], spec)


def fit_candidates(plan: Plan, specs: Sequence[ModelSpec]) -> DataFrame:
    """``candidate, impression_id, y, p``: test predictions of every spec, all trained together."""
    fitted = train_many(plan.train, [plan.job(s) for s in specs], plan.layout)
    if plan.cal is None:
        return stacked([
            f.logits(plan.test).select("impression_id", plan.label.cast("int").alias("y"), plan.raw.alias("p")) for f in fitted])
    # Calibrated side by side.
    def scored(df):
        return stacked([f.logits(df).select("impression_id", plan.label.cast("int").alias("y"), plan.z.alias("z")) for f in fitted])

    slope = bool(specs[0].platt_slope)
    return calibrate_groups(scored(plan.cal), scored(plan.test), "z", "y", ["candidate"], slope=slope).drop("z")


def _encoded(rows: DataFrame, train: DataFrame, spec: ModelSpec, unseen: str) -> tuple[DataFrame, DenseEncoder]:
    """All rows of the fold encoded once with what ``train`` shows; the splits are filters
    over them."""
    encoder = _encoder(train, spec, unseen)
    return store(encoder.apply(rows)), encoder


def _heads_plan(rows, fold, spec, *, kind, defaults, unseen, risk_set) -> Plan:
    pick = splits.train_multi if spec.n_heads > 1 else splits.train_single
    rows, encoder = _encoded(rows, pick(rows, fold.train_end), spec, unseen)
    train = pick(rows, fold.train_end)
    cal, test = late_splits(rows, fold, spec.calibrate)
    splits.require_rows(train=train, test=test)
    return _plan_of(train.withColumns(_labels(spec, risk_set)), cal, test, encoder, spec, kind, defaults)


def _plan_of(labelled, cal, test, encoder, spec, kind, defaults) -> Plan:
    """The heads' hazards are aggregated where there are several."""
    if spec.n_heads == 1:
        z, raw, label = F.col("z1"), sigmoid(F.col("z1")), F.col(TARGET)
    else:
        logits = [F.col(f"z{k}") for k in range(1, spec.n_heads + 1)]
        z, raw = hazard_logit(logits), heads.hazard_probability(logits)
        label = any_one(F.col(HEADS))
    extra = {}
    if spec.aux:
        extra = {"aux_y": F.col(spec.aux), "aux_p": sigmoid(F.col(f"z{spec.n_heads + 1}"))}
    return Plan(kind, encoder, _layout(encoder, spec.n_heads, bool(spec.aux)), labelled, cal, test,
                spec.n_heads + bool(spec.aux), defaults, z, raw, label, extra)


def plan_trunk(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Plan:
    """Heads learn from labels that are final and still at risk."""
    return _heads_plan(rows, fold, spec, kind="trunk", defaults=DEFAULTS, unseen="raise", risk_set=True)


def trunk_network(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Outcome:
    """Shared trunk: one head or one hazard per delay bucket, with or without a second task."""
    return _run(plan_trunk(rows, fold, spec), spec)


def plan_machine(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Plan:
    return _heads_plan(rows, fold, spec, kind="machine", defaults=MACHINE_DEFAULTS, unseen="zero", risk_set=False)


def deep_fm(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Outcome:
    """Factorization machine plus deep part in the same four modes, without risk sets."""
    return _run(plan_machine(rows, fold, spec), spec)


def plan_towers(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Plan:
    if spec.n_heads != 1:
        raise ValueError("The entire-space model has a single head.")
    if not spec.aux:
        raise ValueError("The entire-space model needs the click column as second task.")
    rows, encoder = _encoded(rows, splits.train_single(rows, fold.train_end), spec, "raise")
    train = splits.train_single(rows, fold.train_end)
    cal, test = late_splits(rows, fold, spec.calibrate)
    splits.require_rows(train=train, test=test)
    organic = numerics.organic_share(train, target=TARGET, aux=spec.aux).first()[0]
    labelled = train.withColumns({"y1": F.col(TARGET), "w1": F.lit(1.0), "aux_y": F.col(spec.aux)})
    p = heads.click_and_convert_probability(F.col("z1"), F.col("z2"))
    return Plan("towers", encoder, _layout(encoder, 1, True), labelled, cal, test, 2, DEFAULTS, logit(p, 1e-12), p,
                F.col(TARGET), {"aux_y": F.col(spec.aux), "aux_p": sigmoid(F.col("z1"))}, product=True,
                notes={"organic_share": organic})


def esmm(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Outcome:
    """Click and conversion towers; the product is fitted to and predicts the conversion
    (Ma et al., 2018)."""
    return _run(plan_towers(rows, fold, spec), spec)


def stratified_holdout(df: DataFrame, label: str, share: float, seed) -> DataFrame:
    """Mark a share of each label's rows as ``is_valid`` by a hash of the row key."""
    draw = F.concat_ws("/", F.col(label).cast("string"), F.col("impression_id").cast("string"))
    return df.withColumn("is_valid", hash_keep(draw, share, f"{seed}-holdout"))


def selection_model(table: DataFrame, columns: list[str], nominal: Mapping[str, int], settings, seed: int):
    """Boosted trees for the selection label ``s``; stops early on the held-out rows.  Categories (``nominal``, with
    their numbers of values) are split as sets: how they are numbered does not matter."""
    rows = stratified_holdout(table, "s", settings["selection_holdout"], seed)
    encoded = cut(dense_vector(rows, columns, nominal=dict(nominal)).select(
        "features", F.col("s").cast("double").alias("label"), "is_valid"))
    counts = encoded.agg(F.count_if(~F.col("is_valid")), F.count_if(F.col("is_valid"))).first()
    if not counts[0]:
        raise ValueError("No rows for an importance-weight model: tau leaves no usable history.")
    booster = GBTClassifier(
        stepSize=float(settings["selection_rate"]), maxDepth=int(settings["selection_depth"]),
        maxIter=int(settings["selection_trees"]), seed=int(seed), maxBins=MOST_CATEGORIES,
    )
    if counts[1]:
        booster = booster.setValidationIndicatorCol("is_valid")
    return booster.fit(encoded)


def plan_weighted(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Plan:
    """All rows before the end of training, weighted by two selection models."""
    if spec.n_heads != 1:
        raise ValueError("Importance weighting has a single head.")
    if spec.aux:
        raise ValueError("Importance weighting has no second task.")
    settings = spec.settings({**DEFAULTS, **SELECTION_DEFAULTS})
    tau = int(settings["tau_days"])
    shift.check_tau(tau, spec.max_delay_days)
    rows, encoder = _encoded(rows, splits.train_all(rows, fold.train_end), spec, "raise")
    train = splits.train_all(rows, fold.train_end)
    cal, test = late_splits(rows, fold, spec.calibrate)
    splits.require_rows(train=train, test=test)
    observed = shift.observe(train, fold.train_end, tau)

    fit_columns = [*encoder.columns, "time"]
    deadline = F.col(shift.ELAPSED_DEADLINE)
    positive = shift.positive_table(observed, fold.train_end, tau).withColumn("time", deadline)
    negative = shift.negative_table(observed, fold.train_end, tau).withColumn("time", deadline)
    nominal = dict(zip(encoder.index_columns, encoder.sizes))
    selected = selection_model(positive, fit_columns, nominal, settings, spec.seed)
    stayed = selection_model(negative, fit_columns, nominal, settings, spec.seed)

    vectors = dense_vector(observed.withColumn("time", F.col(shift.ELAPSED)).select(
        "impression_id", shift.OBSERVED, *[F.col(c).alias(f"_fit_{c}") for c in encoder.columns], *fit_columns), fit_columns, nominal=nominal)
    # The networks read the indexes as they were.
    scored = vectors.drop(*fit_columns).withColumnsRenamed({f"_fit_{c}": c for c in encoder.columns})
    for model, name in ((selected, "p_positive"), (stayed, "p_negative")):
        scored = model.transform(scored).withColumn(name, probability_of_one()).drop(
            "rawPrediction", "probability", "prediction")
    weighted = scored.withColumns({
        "y1": F.col(shift.OBSERVED),
        "w1": shift.importance_weight(F.col("p_positive"), F.col("p_negative")),
    })
    return _plan_of(store(weighted.select("impression_id", *encoder.columns, "y1", "w1")), cal, test, encoder, spec, "trunk", settings)


def fsiw(rows: DataFrame, fold: Fold, spec: ModelSpec) -> Outcome:
    """A trunk on importance-weighted rows."""
    return _run(plan_weighted(rows, fold, spec), spec)
