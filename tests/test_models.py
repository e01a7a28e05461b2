"""Network arithmetic against finite differences, and models on data with a known truth."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ripen.models import ModelSpec, fit_predict
from ripen.models import network
from ripen.models.neural import stratified_holdout
from ripen.operators import conform, delays, metrics
from ripen.plans.experiment import ExperimentConfig, diagnostics, run_experiment
from ripen.plans.folds import Fold
from ripen.plans.prepare import prepare_fold
from ripen.session import cut

DAY = 86_400
FOLD = Fold(1, dt.date(2024, 1, 1), dt.date(2024, 1, 21), dt.date(2024, 1, 24))
QUICK = {"epochs": 12, "deep_hidden": (16, 8), "batch_size": 128, "learning_rate": 1e-2, "dropout_rate": 0.0}


def cross_entropy(z, y):
    return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))


@pytest.mark.parametrize("kind", ["trunk", "machine", "towers"])
def test_gradients_match_finite_differences(kind):
    rng = np.random.default_rng(3)
    shape = network.Shape(kind, (3, 4), 2, 3, (5, 4), 2)
    flat = rng.normal(0, 0.4, shape.n_parameters())
    n_dense = shape.n_dense()
    at = np.stack([rng.integers(0, 3, 7), 3 + rng.integers(0, 3, 7)], axis=1)  # the last row is not met
    xn = rng.normal(size=(7, 2))
    y, click = rng.integers(0, 2, (7, 1)).astype(float), rng.integers(0, 2, 7).astype(float)
    w = rng.random((7, 1)) + 0.5

    def net_of(vector):
        return network.Network(shape, vector[:n_dense], vector[n_dense:].reshape(shape.n_rows, shape.row_width))

    def loss(vector):
        z = net_of(vector).forward(at, xn)
        if kind == "towers":
            p = network.sigmoid(z[:, 0]) * network.sigmoid(z[:, 1])
            product = -(y[:, 0] * np.log(p) + (1 - y[:, 0]) * np.log(1 - p))
            return (cross_entropy(z[:, 0], click) + product).mean()
        heads = (cross_entropy(z[:, :1], y) * w).sum() / max(w.sum(), 1.0)
        return heads + 0.3 * cross_entropy(z[:, 1], click).mean()

    net = net_of(flat)
    z = net.forward(at, xn)
    d = (network.product_loss_gradient(z, y[:, 0], click) if kind == "towers"
         else network.head_loss_gradient(z, y, w, click, 0.3))
    net.backward(np.asarray(d, dtype=float))
    assert net.touched.tolist() == np.unique(at).tolist() and 6 not in net.touched
    rows = np.zeros((shape.n_rows, shape.row_width))
    rows[net.touched] = net.row_gradient
    gradient = np.concatenate([net.gradient, rows.ravel()])
    for cell in rng.choice(len(flat), 60, replace=False):
        bump = np.zeros_like(flat)
        bump[cell] = 1e-6
        slope = (loss(flat + bump) - loss(flat - bump)) / 2e-6
        assert gradient[cell] == pytest.approx(slope, abs=2e-6)


def test_a_head_without_weight_has_no_gradient():
    d = network.head_loss_gradient(np.ones((4, 2)), np.ones((4, 2)), np.array([[1.0, 0.0]] * 4))
    assert (d[:, 1] == 0).all() and (d[:, 0] < 0).all()


def planted(spark, n=12_000, seed=8, mean_delay=2.5):
    """Conversion depends on a category, a count and the click; delays are exponential."""
    rng = np.random.default_rng(seed)
    start = rng.integers(0, 30 * DAY, n)
    cat, count, click = rng.integers(1, 5, n), rng.poisson(3, n), rng.integers(0, 2, n)
    z = -2.2 + np.array([0.0, 0.0, 2.0, -2.0, 3.5])[cat] + 1.5 * (np.log1p(count) - 1.2) + 0.3 * click
    converted = rng.random(n) < 1 / (1 + np.exp(-z))
    delay = np.minimum(rng.exponential(mean_delay * DAY, n), 12 * DAY - 1).astype(int)
    delay[:4], converted[:4] = [100, 2 * DAY, 5 * DAY, 12 * DAY - 1], True
    base = pd.Timestamp("2024-01-01")
    frame = pd.DataFrame({
        "impression_id": np.arange(n), "timestamp_dt": base + pd.to_timedelta(start, unit="s"),
        "conversion": converted.astype(int), "conversion_delay": np.where(converted, delay, -1),
        "conversion_timestamp_dt": (base + pd.to_timedelta(start + delay, unit="s")).where(converted),
        "click": click, "cat1": cat, "impression_number": count.astype(float),
        # Known only here: the probability itself, as a column no model reads.
        "time_since_last_click": 1 / (1 + np.exp(-z)),
    })
    rows = spark.createDataFrame(frame)
    rows = delays.add_delay_buckets(rows, delays.bucket_edges(delays.horizon(rows)))
    return conform.conform(rows)


@pytest.fixture(scope="module")
def clean(spark):
    made = planted(spark)
    return conform.Conformed(cut(made.rows), made.horizon, made.cuts, made.categorical, made.numeric)


@pytest.fixture(scope="module")
def rows(clean):
    return cut(prepare_fold(clean.rows, FOLD, clean.cuts, clean.categorical))


def spec(**options):
    return ModelSpec(categorical=("cat1",), numeric=("impression_number",), **options)


def quality(outcome):
    return metrics.evaluate(outcome.predictions).first()


def ideal(rows):
    """The ranking quality of the true probabilities on the test days."""
    test = rows.filter(F.col("timestamp_dt") >= F.lit("2024-01-22").cast("timestamp"))
    return metrics.evaluate(test.select(
        "impression_id", F.col("conversion").alias("y"), F.col("time_since_last_click").alias("p"))).first()


def assert_close_to_ideal(rows, found, loss=0.12):
    """The models do not see the click and share few distinct feature rows, hence ``loss``."""
    assert found.base_rate < ideal(rows).ap and found.ap > ideal(rows).ap - loss, found


def test_logistic_regression(rows):
    found = quality(fit_predict("lr", rows, FOLD, spec()))
    assert_close_to_ideal(rows, found)
    assert found.rce > 10


def test_forest_is_calibrated_before_the_test_window(rows):
    outcome = fit_predict("rf", rows, FOLD, spec(
        calibrate=True, params={"n_trees": 20, "min_samples_leaf": 20, "max_depth": 6}))
    assert_close_to_ideal(rows, quality(outcome))
    assert outcome.platt.slope != 1.0
    tables = diagnostics(outcome, calibrated=True)
    assert {"reliability_before", "calibration_error_before"} <= set(tables)
    assert tables["boxes"].count() == 2 and tables["summary"].first().n == outcome.predictions.count()


@pytest.mark.parametrize("model", ["mlp", "deep_fm"])
@pytest.mark.parametrize("n_heads,aux", [(1, None), (1, "click"), (4, None), (4, "click")])
def test_network_modes(rows, model, n_heads, aux):
    outcome = fit_predict(model, rows, FOLD, spec(n_heads=n_heads, aux=aux, calibrate=True, params=QUICK))
    found = quality(outcome)
    assert_close_to_ideal(rows, found)
    assert found.rce > 10
    assert ("aux_p" in outcome.predictions.columns) == (aux is not None)
    assert outcome.predictions.filter("p <= 0 or p >= 1").isEmpty()


def test_entire_space(rows):
    outcome = fit_predict("esmm", rows, FOLD, spec(calibrate=True, params=QUICK))
    assert_close_to_ideal(rows, quality(outcome))
    assert 0 < outcome.notes["organic_share"] < 1


def test_training_is_repeatable(rows):
    made = [
        sorted(map(tuple, fit_predict("mlp", rows, FOLD, spec(aux=None, params={**QUICK, "epochs": 2}))
                   .predictions.select("impression_id", "p").collect()))
        for _ in range(2)
    ]
    assert made[0] == made[1]


def test_importance_weights_undo_the_late_label_bias(spark):
    """Labels read at the end of training miss late conversions; weighting restores them."""
    made = planted(spark, mean_delay=4.0)
    fold = Fold(1, dt.date(2024, 1, 1), dt.date(2024, 1, 11), dt.date(2024, 1, 16))
    rows = cut(prepare_fold(made.rows, fold, made.cuts, made.categorical, any_head=True))
    quick = {**QUICK, "selection_trees": 60, "selection_rate": 0.1, "selection_depth": 3}
    # Few rows are old enough to be mature: keep the categories as they are.
    rows = rows.drop("cat1").join(made.rows.select("impression_id", "cat1"), "impression_id")
    weighted = fit_predict("fsiw", rows, fold, spec(aux=None, params=quick)).predictions
    truth = weighted.agg(F.avg("y")).first()[0]
    end = F.lit(str(fold.train_end)).cast("timestamp")
    known = F.coalesce((F.col("conversion_timestamp_dt") <= end).cast("double"), F.lit(0.0))
    observed = rows.filter(F.col("timestamp_dt") < end).agg(F.avg(known)).first()[0]
    mean = weighted.agg(F.avg("p")).first()[0]
    # The weights see tau days of late conversions, so they undo a part of the bias.
    assert observed < truth - 0.05
    assert observed + 0.02 < mean < truth


def test_holdout_is_stratified(spark):
    df = spark.range(20_000).select(F.col("id").alias("impression_id"), (F.col("id") % 5 == 0).cast("int").alias("s"))
    shares = stratified_holdout(df, "s", 0.1, 1).groupBy("s").agg(F.avg(F.col("is_valid").cast("double")).alias("r"))
    assert all(abs(r.r - 0.1) < 0.02 for r in shares.collect())


@pytest.mark.parametrize("n_values", [6, 900])
def test_renumbering_categories_leaves_the_selection_unchanged(spark, n_values):
    """Trees split categories as sets, so a category's number says nothing; many values are hashed and still told apart."""
    from pyspark.ml.functions import vector_to_array

    from ripen.models.features import dense_vector
    from ripen.models.neural import selection_model

    settings = {"selection_holdout": 0.1, "selection_rate": 0.3, "selection_depth": 3, "selection_trees": 5}
    rows = spark.range(3000).select(
        F.col("id").alias("impression_id"), (F.hash("id") % n_values).alias("h"), (F.col("id") % 11 / 11.0).alias("x")
    ).withColumn("c", F.pmod("h", F.lit(n_values)).cast("int")).withColumn("s", (F.pmod(F.hash("c"), F.lit(3)) == 0).cast("int"))

    def chances(renumbered):
        own = rows.withColumn("c", renumbered.cast("int"))
        model = selection_model(own, ["c", "x"], {"c": n_values}, settings, 4)
        out = model.transform(dense_vector(own.select("impression_id", "s", "c", "x"), ["c", "x"], nominal={"c": n_values}))
        return {r[0]: (r[1], r[2]) for r in out.select("impression_id", F.element_at(vector_to_array("probability"), 2), "s").collect()}

    plain = chances(F.col("c"))
    assert np.mean([(p > 0.5) == (s == 1) for p, s in plain.values()]) > (0.99 if n_values == 6 else 0.7)
    if n_values == 6:
        other = chances(F.pmod(F.col("c") * 5 + 2, F.lit(6)))
        assert max(abs(plain[i][0] - other[i][0]) for i in plain) < 1e-9


def test_experiment_with_tuning_carries_the_best_forward(clean):
    config = ExperimentConfig(
        model="rf", outer_lengths=(20, 3, 3), inner_lengths=(17, 2, 2), first_day=dt.date(2024, 1, 1),
        params={"n_trees": 5, "max_depth": 4}, tuning={"grid": (20, 60)})
    report = run_experiment(clean, config)
    assert [r.fold.fold_id for r in report.folds] == [1, 2, 3]
    assert report.metrics.count() == 4
    for result in report.folds:
        assert result.search.best_params["min_samples_leaf"] in (20, 60)
        assert result.search.best_score == max(t.score for t in result.search.trials)
        assert result.mask_stats["n_test"] > 0
