"""Queries that train models, tune them, or run as streams.

What trained models return depends on random draws or floating-point training, so they have
no SQL twin; tests check them against brute force and planted truth.  Sizes that only cost time
(trees, epochs, layer widths) are set small here and default to the full ones in the library.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import epoch_seconds, exploded_positions
from ..models import ModelSpec, fit_predict
from ..models.benchmarks import certificate, fit_regression, plan_regression
from ..models.features import fit_one_hot
from ..models.neural import stratified_holdout
from ..operators import metrics, shift, splits
from ..operators.delays import bucket_edges, horizon
from ..plans.experiment import ExperimentConfig, run_experiment, spec_for
from ..plans.tuning import Scorer, draw_network, tune_forest, tune_network
from ..session import shared_folder
from ..sources import read_table, write_days, write_table
from ..streaming import bucket_counts_stream, label_stream, run_available, write_in_turn
from . import tables as t
from .queries import query, rounded

_NETWORK = {"epochs": 3, "deep_hidden": (32, 16), "batch_size": 256}


def _spec(clean, **options) -> ModelSpec:
    return ModelSpec(categorical=clean.categorical, numeric=clean.numeric, **options)


def _metrics(spark, sf_dir, model, **options):
    rows, clean = t.prepared(spark, sf_dir)
    outcome = fit_predict(model, rows, t.FOLD, _spec(clean, **options))
    return rounded(metrics.evaluate(outcome.predictions))


@query
def holdout(spark, sf_dir):
    rows = splits.train_all(t.prepared(spark, sf_dir)[0], t.FOLD.train_end)
    negative = shift.negative_table(
        shift.observe(rows, t.FOLD.train_end, t.TAU_DAYS), t.FOLD.train_end, t.TAU_DAYS)
    marked = stratified_holdout(negative, "s", 0.10, 42)
    return marked.select("impression_id", "s", F.col("is_valid").cast("int").alias("is_valid"))


@query
def one_hot(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows, clean = t.prepared(spark, sf_dir)
    features = fit_one_hot(splits.train_single(rows, t.FOLD.train_end), clean.categorical, clean.numeric)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return rounded(features.apply(rows).select("impression_id", total.alias("total")))


@query
def lr(spark, sf_dir):
    return _metrics(spark, sf_dir, "lr")


@query
def lr_certificate(spark, sf_dir):
    """The regression is at its optimum, which is unique: the mean prediction is the base rate, and no slope is left."""
    rows, clean = t.prepared(spark, sf_dir)
    plan = plan_regression(rows, t.FOLD, _spec(clean))
    found = certificate(plan, fit_regression(plan, _spec(clean)), _spec(clean))
    return found.select("n_rows", F.round("base_rate", 4).alias("base_rate"), F.round("mean_p", 4).alias("mean_p"),
                        (F.col("steepest") < 1e-4).cast("int").alias("is_optimal"))


def _rows_of(spark, sf_dir, model, **options):
    """Which rows a model at its default settings predicts, their labels, and whether its number is a probability."""
    rows, clean = t.prepared(spark, sf_dir)
    found = fit_predict(model, rows, t.FOLD, _spec(clean, **options)).predictions
    return found.select("impression_id", "y", ((F.col("p") > 0) & (F.col("p") < 1)).cast("int").alias("is_probability"))


@query
def rows_lr(spark, sf_dir):
    return _rows_of(spark, sf_dir, "lr")


@query
def rows_rf(spark, sf_dir):
    return _rows_of(spark, sf_dir, "rf", calibrate=True)


@query
def rows_mlp_heads_click(spark, sf_dir):
    return _rows_of(spark, sf_dir, "mlp", n_heads=t.N_HEADS, calibrate=True)


@query
def rows_deep_fm_heads_click(spark, sf_dir):
    return _rows_of(spark, sf_dir, "deep_fm", n_heads=t.N_HEADS)


@query
def rows_esmm(spark, sf_dir):
    return _rows_of(spark, sf_dir, "esmm", calibrate=True)


@query
def rf(spark, sf_dir):
    return _metrics(spark, sf_dir, "rf", calibrate=True,
                    params={"n_trees": 20, "min_samples_leaf": 20, "max_depth": 8})


@query
def mlp_single(spark, sf_dir):
    return _metrics(spark, sf_dir, "mlp", aux=None, params=_NETWORK)


@query
def mlp_click(spark, sf_dir):
    return _metrics(spark, sf_dir, "mlp", calibrate=True, params=_NETWORK)


@query
def mlp_heads(spark, sf_dir):
    return _metrics(spark, sf_dir, "mlp", aux=None, n_heads=t.N_HEADS, params=_NETWORK)


@query
def mlp_heads_click(spark, sf_dir):
    return _metrics(spark, sf_dir, "mlp", n_heads=t.N_HEADS, calibrate=True, params=_NETWORK)


@query
def deep_fm(spark, sf_dir):
    return _metrics(spark, sf_dir, "deep_fm", aux=None, params=_NETWORK)


@query
def deep_fm_heads_click(spark, sf_dir):
    return _metrics(spark, sf_dir, "deep_fm", n_heads=t.N_HEADS, calibrate=True, params=_NETWORK)


@query
def esmm(spark, sf_dir):
    return _metrics(spark, sf_dir, "esmm", calibrate=True, params=_NETWORK)


@query
def fsiw(spark, sf_dir):
    return _metrics(spark, sf_dir, "fsiw", aux=None, max_delay_days=12,
                    params={**_NETWORK, "selection_trees": 5, "selection_depth": 3})


@query
def head_labels(spark, sf_dir):
    """Head labels and masks as scalar columns, as the network trainer reads them."""
    rows = splits.train_multi(t.prepared(spark, sf_dir)[0], t.FOLD.train_end)
    return rows.select(
        "impression_id", *exploded_positions(F.col("bucket_vec"), t.N_HEADS, "b"),
        *exploded_positions(F.col("mask_train"), t.N_HEADS, "m"))


_TINY_SPACE = {"epochs": 1, "deep_hidden": (16,), "batch_size": 512, "emb_dim": 2}


def _config(**options) -> ExperimentConfig:
    return ExperimentConfig(outer_lengths=t.FOLD_LENGTHS, inner_lengths=t.INNER_LENGTHS,
                            first_day=t.FIRST_DAY, **options)


@query
def tune_rf(spark, sf_dir):
    """Two leaf sizes on the inner folds of the first outer fold."""
    clean = t.materialised(spark, sf_dir)
    config = _config(model="rf", params={"n_trees": 5, "max_depth": 5})
    scorer = Scorer(clean.rows, t.FOLD, clean.cuts, spec_for(clean, config, config.params), "rf",
                    t.INNER_LENGTHS)
    found = tune_forest(scorer, grid=(10, 50))
    return spark.createDataFrame(
        [(c.params["min_samples_leaf"], float(c.score)) for c in found.trials],
        "min_samples_leaf int, score double")


@query
def tune_net(spark, sf_dir):
    """A warm start and one draw of the network search."""
    clean = t.materialised(spark, sf_dir)
    config = _config(model="mlp")
    scorer = Scorer(clean.rows, t.FOLD, clean.cuts, spec_for(clean, config, {}), "mlp", t.INNER_LENGTHS)
    found = tune_network(
        scorer, previous={**_TINY_SPACE, "learning_rate": 1e-3}, previous_score=0.0, budget=2, short=1,
        draw=lambda rng, aux: {**draw_network(rng, aux), **_TINY_SPACE})
    return spark.createDataFrame(
        [(c.candidate, float(c.params["learning_rate"]), float(c.score)) for c in found.trials],
        "candidate int, learning_rate double, score double")


@query
def experiment(spark, sf_dir):
    """Logistic regression over every outer fold, with the average row."""
    return rounded(run_experiment(t.materialised(spark, sf_dir), _config(model="lr", tune=False)).metrics)


def _streamed(spark, source, name):
    """The rows as a file stream."""
    folder = shared_folder(spark, name)
    source.write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


@query
def stream_labels(spark, sf_dir):
    rows = t.bucketed(spark, sf_dir)
    edges = bucket_edges(horizon(rows))
    impressions = _streamed(
        spark, rows.select("impression_id", "uid", "timestamp_dt"), "impressions")
    conversions = _streamed(
        spark, rows.filter("conversion = 1").select("impression_id", "conversion_timestamp_dt"), "conversions")
    target = shared_folder(spark, "labels")
    run_available(label_stream(impressions, conversions, edges), target, shared_folder(spark, "state"))
    return spark.read.parquet(target).select("impression_id", "conversion", "conversion_delay", "bucket.bucket_id")


@query
def stream_labels_restarted(spark, sf_dir):
    """The same labels from micro-batches of a few days each; the stream ends half-way and goes on from its
    checkpoint."""
    rows = t.bucketed(spark, sf_dir)
    edges = bucket_edges(horizon(rows))
    sides = ((rows.select("impression_id", "uid", "timestamp_dt"), "timestamp_dt", shared_folder(spark, "impressions")),
             (rows.filter("conversion = 1").select("impression_id", "conversion_timestamp_dt"), "conversion_timestamp_dt",
              shared_folder(spark, "conversions")))
    target, state = shared_folder(spark, "labels"), shared_folder(spark, "state")
    days = [t.FIRST_DAY + dt.timedelta(days=d) for d in (6, 12, 18, 24)]
    first = F.lit(str(days[1])).cast("timestamp")
    for early in (True, False):
        for side, moment, folder in sides:
            some = side.filter(F.col(moment) < first if early else F.col(moment) >= first)
            write_in_turn(some, folder, moment, days[:1] if early else days[2:])
        impressions, conversions = (
            spark.readStream.schema(side.schema).option("maxFilesPerTrigger", 1).parquet(folder) for side, _, folder in sides)
        run_available(label_stream(impressions, conversions, edges), target, state)
    return spark.read.parquet(target).select("impression_id", "conversion", "conversion_delay", "bucket.bucket_id")


@query
def sink_days(spark, sf_dir):
    """The preprocessed table laid out by day; then three days of it are replaced by their conversions alone."""
    rows = t.bucketed(spark, sf_dir).select("impression_id", "timestamp_dt", "conversion")
    folder = shared_folder(spark, "days")
    write_table(rows, folder, time_column="timestamp_dt")
    days = [t.FIRST_DAY + dt.timedelta(days=d) for d in (4, 5, 11)]
    some = rows.filter(F.to_date("timestamp_dt").isin(days) & (F.col("conversion") == 1))
    write_days(some, folder, time_column="timestamp_dt", days=days)
    back = read_table(spark, folder, fmt="parquet")
    return back.groupBy(epoch_seconds(F.col("event_date").cast("timestamp")).alias("day_s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("conversion").cast("long").alias("conversions"))


@query
def stream_buckets(spark, sf_dir):
    rows = t.bucketed(spark, sf_dir).select("timestamp_dt", "bucket")
    target = shared_folder(spark, "counts")
    run_available(bucket_counts_stream(_streamed(spark, rows, "bucketed")), target, shared_folder(spark, "state"))
    return spark.read.parquet(target).select(epoch_seconds(F.col("day")).alias("day_s"), "bucket_id", "n")
