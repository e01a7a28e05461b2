"""Training many networks on one stored table, wide networks, and forests in groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripen import session
from ripen.models import Candidates, ModelSpec, benchmarks, trainer
from ripen.models.network import Shape, initial_rows
from ripen.models.trainer import Job, Layout
from ripen.operators import metrics
from ripen.plans.tuning import Scorer

from test_models import FOLD, clean, planted, rows, spec  # noqa: F401  (fixtures)

LAYOUT = Layout(("a_idx", "b_idx"), ("x",), ("y1",), ("w1",))
SETTINGS = {**trainer.DEFAULTS, "epochs": 2, "deep_hidden": (8,), "batch_size": 256, "rows_per_task": 1_500, "emb_dim": 4}


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(4_000).select(
        F.col("id").alias("impression_id"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("int").alias("a_idx"),
        (F.col("id") % 7).cast("int").alias("b_idx"), (F.pmod(F.hash("id"), F.lit(100)) / 50.0 - 1).alias("x"),
        (F.col("id") % 7 < 3).cast("int").alias("y1"), F.lit(1.0).alias("w1")).cache()


@pytest.mark.parametrize("kind", ["trunk", "machine"])
def test_wide_networks_equal_narrow_ones(spark, table, monkeypatch, kind):
    job = Job(Shape(kind, (997, 7), 1, 4, (8,), 1), SETTINGS, 5)
    narrow = trainer.train_many(table, [job], LAYOUT)[0]
    monkeypatch.setattr(trainer, "NARROW_CELLS", 100)
    wide = trainer.train_many(table, [job], LAYOUT)[0]
    assert narrow.rows is not None and wide.rows is None
    assert np.allclose(narrow.dense, wide.dense, atol=1e-6)
    held = wide.table.toPandas().set_index("row").state
    assert len(held) == table.select("a_idx").distinct().count() + 7
    assert np.allclose(np.stack(held.to_list())[:, :job.shape.row_width], narrow.rows[held.index], atol=1e-6)
    z = [dict(f.logits(table.select("impression_id", "a_idx", "b_idx", "x")).select("impression_id", "z1").collect()) for f in (narrow, wide)]
    assert z[0].keys() == z[1].keys() and max(abs(z[0][i] - z[1][i]) for i in z[0]) < 1e-5


def test_training_a_wide_network_does_not_move_its_rows(spark, table, monkeypatch):
    monkeypatch.setattr(trainer, "NARROW_CELLS", 100)
    job = Job(Shape("trunk", (997, 7), 1, 4, (8,), 1), SETTINGS, 5)
    kept = session.store_in_buckets(table.select(
        F.pmod(F.hash("impression_id"), F.lit(3)).cast("int").alias("part"), F.xxhash64("impression_id").alias("_order"),
        "a_idx", "b_idx", "x", "y1", "w1"), 3, "part")
    met = session.store(trainer._met_rows(kept, job.shape, LAYOUT))
    plan = trainer._Wide(0, job, LAYOUT, kept, met).epoch(0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # that of the category rows


def test_twenty_million_cells(spark):
    """Only rows that occur are stepped, stored or sent; none of them reaches the driver."""
    n = 5_000_000
    rows = spark.range(12_000).select(
        F.col("id").alias("impression_id"), F.pmod(F.xxhash64(F.col("id") % 3_000), F.lit(n)).cast("int").alias("a_idx"),
        F.lit(0).alias("b_idx"), F.lit(0.0).alias("x"), F.lit(1.0).alias("w1"),
        (F.xxhash64(F.col("id") % 3_000) % 2 == 0).cast("int").alias("y1")).cache()
    shape = Shape("trunk", (n, 1), 1, 4, (8,), 1)
    assert shape.n_parameters() > 20_000_000 and trainer.is_wide(shape)
    settings = {**SETTINGS, "epochs": 12, "learning_rate": 3e-2, "rows_per_task": 4_000, "dropout_rate": 0.0}
    fitted = trainer.train_many(rows, [Job(shape, settings, 1)], LAYOUT)[0]
    assert fitted.rows is None and len(fitted.dense) < 200
    assert fitted.table.count() == rows.select("a_idx").distinct().count() + 1
    scored = fitted.logits(rows).select("impression_id", F.col("y1").alias("y"), (1 / (1 + F.exp(-F.col("z1")))).alias("p"))
    assert metrics.loss_metrics(scored).first().rce > 15
    unseen = fitted.logits(rows.limit(5).withColumn("a_idx", F.lit(n - 1)))
    assert unseen.where("z1 IS NULL").isEmpty()


def test_rows_start_from_their_number_alone():
    shape = Shape("trunk", (50,), 0, 3, (2,), 1)
    whole = initial_rows(shape, 3, np.arange(50))
    assert np.array_equal(whole[[7, 41]], initial_rows(shape, 3, np.array([7, 41])))
    assert abs(initial_rows(shape, 3, np.arange(4000)).std() - 1) < 0.05 and not np.array_equal(whole, initial_rows(shape, 4, np.arange(50)))


def test_networks_trained_together_equal_networks_trained_alone(spark, table):
    jobs = [Job(Shape("trunk", (997, 7), 1, e, h, 1), {**SETTINGS, "epochs": n, "learning_rate": r}, 5)
            for e, h, n, r in ((4, (8,), 1, 1e-2), (2, (4, 4), 2, 1e-3))]
    together = trainer.train_many(table, jobs, LAYOUT)
    for job, found in zip(jobs, together):
        alone = trainer.train_many(table, [job], LAYOUT)[0]
        assert np.allclose(alone.dense, found.dense) and np.allclose(alone.rows, found.rows)


def test_an_epoch_is_one_job_for_all_networks(spark, table):
    def jobs_of(n):
        group = f"epochs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        jobs = [Job(Shape("trunk", (997, 7), 1, 2, (4,), 1), {**SETTINGS, "epochs": 2, "learning_rate": 1e-3 * (i + 1)}, 5) for i in range(n)]
        trainer.train_many(table, jobs, LAYOUT)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert jobs_of(1) == jobs_of(4)


@pytest.mark.parametrize("model", ["mlp", "rf"])
def test_trials_read_folds_encoded_once(clean, model):  # noqa: F811
    def stored(n):
        mark = session.stored_mark()
        settings = {"epochs": 1, "deep_hidden": (4,), "n_trees": 2, "max_depth": 3}
        scorer = Scorer(clean.rows, FOLD, clean.cuts, spec(aux=None, params=settings), model, (16, 2, 2))
        assert len(scorer.folds) == 2
        trials = scorer.score([{"learning_rate": 1e-3 * (i + 1), "min_samples_leaf": 10 * (i + 1)} for i in range(n)])
        assert len(trials) == n and all(np.isfinite(t.score) for t in trials)
        return session.stored_mark() - mark, len(scorer.folds)

    few, n_folds = stored(2)
    many, _ = stored(5)
    assert few == many == (n_folds if model == "mlp" else 0)


def test_forests_in_groups(rows):  # noqa: F811
    def fitted(at_once):
        params = {"n_trees": 9, "min_samples_leaf": 20, "max_depth": 4, "trees_at_once": at_once}
        return Candidates("rf", rows, FOLD, spec(params=params)).predictions([spec(params=params)])

    whole, groups = fitted(9), fitted(4)
    assert groups.count() == whole.count() and groups.filter("p <= 0 OR p >= 1").isEmpty()
    assert abs(metrics.loss_metrics(groups).first().rce - metrics.loss_metrics(whole).first().rce) < 5


def test_rows_keep_their_nodes_while_trees_grow(rows, monkeypatch):  # noqa: F811
    plan = benchmarks.plan_forest(rows, FOLD, spec())
    settings = {**benchmarks.RF_DEFAULTS, "max_depth": 12, "min_samples_leaf": 5}
    kept = benchmarks._grow(plan, settings, 4, 7)
    assert kept.getCacheNodeIds()
    walked = benchmarks.RandomForestClassifier
    monkeypatch.setattr(benchmarks, "RandomForestClassifier", lambda **options: walked(**{**options, "cacheNodeIds": False}))
    trees = [model.toDebugString.split("\n", 1)[1] for model in (kept, benchmarks._grow(plan, settings, 4, 7))]
    assert trees[0] == trees[1] and kept.totalNumNodes > 40
