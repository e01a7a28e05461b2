"""Folds, tuning rules, table layout and small experiments."""

import datetime as dt

import numpy as np
import pytest

from ripen.models import ModelSpec, fit_predict
from ripen.models.common import late_splits
from ripen.plans import folds, tuning
from ripen.sources import read_table, rename_columns, write_days, write_table
from ripen.operators.splits import require_rows, window_slice

D = dt.date


def test_outer_folds_stop_with_the_last_impression_day():
    found = folds.outer_folds(D(2024, 1, 1), dt.datetime(2024, 1, 30, 23), (15, 2, 2))
    assert len(found) == 7 and found[0].train_end == D(2024, 1, 16) and found[-1].test_end == D(2024, 1, 30)
    assert all(b.train_start - a.train_start == dt.timedelta(days=2) for a, b in zip(found, found[1:]))
    assert len(folds.outer_folds(D(2024, 1, 4), dt.datetime(2024, 1, 30, 23), (25, 1, 1))) == 1
    with pytest.raises(ValueError):
        folds.outer_folds(D(2024, 1, 1), D(2024, 2, 1), (5, 0, 1))


def test_inner_folds_end_inside_the_outer_window():
    outer = folds.Fold(1, D(2024, 1, 1), D(2024, 1, 26), D(2024, 1, 27))
    inner = folds.inner_folds(outer, (23, 1, 1))
    assert [f.test_end for f in inner] == [D(2024, 1, 25), D(2024, 1, 26)]


def test_leaf_candidates():
    grid = tuning.grid_leaves()
    assert [c["min_samples_leaf"] for c in grid] == list(tuning.LEAF_GRID)
    warm = tuning.warm_first(grid, {"min_samples_leaf": 77})
    assert warm[0] == {"min_samples_leaf": 77} and len(warm) == 7
    assert len(tuning.warm_first(grid, {"min_samples_leaf": 50})) == 6
    drawn = [c["min_samples_leaf"] for c in tuning.drawn_leaves(np.random.default_rng(4))]
    assert len(drawn) == 8 and drawn == sorted(drawn) and min(drawn) >= 50 and max(drawn) <= 300


def test_warm_start_budget():
    assert tuning.trials_left(None, None) == 32
    assert tuning.trials_left(5.0, 5.9) == 12
    assert tuning.trials_left(5.0, 6.1) == 31


def test_draws_stay_in_the_space():
    rng = np.random.default_rng(1)
    for _ in range(100):
        p = tuning.draw_network(rng, True)
        assert 1e-4 <= p["learning_rate"] <= 5e-3 and 1e-7 <= p["l2_weight_decay"] <= 1e-3
        assert 0 <= p["dropout_rate"] <= 0.5 and 10 <= p["epochs"] <= 25 and 0.05 <= p["aux_weight"] <= 1.5
    assert "aux_weight" not in tuning.draw_network(rng, False)


def test_calibration_needs_two_test_days(spark):
    one_day = folds.Fold(1, D(2024, 1, 1), D(2024, 1, 16), D(2024, 1, 17))
    with pytest.raises(ValueError, match="two days"):
        late_splits(spark.range(1), one_day, True)


def test_model_guards(spark):
    fold = folds.Fold(1, D(2024, 1, 1), D(2024, 1, 16), D(2024, 1, 18))
    spec = dict(categorical=(), numeric=())
    for name, options, match in (
        ("esmm", {"n_heads": 4}, "single head"), ("esmm", {"aux": None}, "click column"),
        ("fsiw", {"n_heads": 4}, "single head"), ("fsiw", {}, "second task"),
        ("fsiw", {"aux": None, "max_delay_days": 2}, "tau_days"), ("other", {}, "Unknown model"),
    ):
        with pytest.raises(ValueError, match=match):
            fit_predict(name, spark.range(1), fold, ModelSpec(**spec, **options))


def test_empty_splits_raise(spark):
    with pytest.raises(ValueError, match="train"):
        require_rows(train=spark.range(0), test=spark.range(1))


def test_written_tables_prune_by_day(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1 + i, 5)) for i in range(10)], "impression_id int, timestamp_dt timestamp")
    write_table(df, str(tmp_path / "t"), time_column="timestamp_dt")
    back = read_table(spark, str(tmp_path / "t"), fmt="parquet", required=["timestamp_dt"])
    kept = window_slice(back, D(2024, 1, 3), D(2024, 1, 5))
    assert sorted(r.impression_id for r in kept.collect()) == [2, 3]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    write_table(df.limit(1), str(tmp_path / "t"), time_column="timestamp_dt")
    assert read_table(spark, str(tmp_path / "t"), fmt="parquet").count() == 1


def test_one_of_three_days_is_rewritten(spark, tmp_path):
    """The other days keep their very files; a named day without rows becomes empty; rows elsewhere are refused."""
    folder = tmp_path / "t"
    df = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1 + i % 3, 5)) for i in range(9)], "impression_id int, timestamp_dt timestamp")
    write_table(df, str(folder), time_column="timestamp_dt")

    def files(day):
        return sorted(p.name for p in (folder / f"event_date=2024-01-0{day}").glob("*.parquet"))

    before = files(1), files(3)
    reader = read_table(spark, str(folder), fmt="parquet").filter("event_date <> date'2024-01-02'")
    write_days(df.filter("impression_id = 4"), str(folder), time_column="timestamp_dt")
    assert (files(1), files(3)) == before and reader.count() == 6
    assert sorted(r.impression_id for r in read_table(spark, str(folder), fmt="parquet").collect()) == [0, 2, 3, 4, 5, 6, 8]
    days = [D(2024, 1, 2), D(2024, 1, 3)]
    with pytest.raises(Exception, match="outside the days"):
        write_days(df, str(folder), time_column="timestamp_dt", days=days)
    assert (files(1), files(3)) == before
    write_days(df.filter("impression_id = 5"), str(folder), time_column="timestamp_dt", days=days)
    assert sorted(r.impression_id for r in read_table(spark, str(folder), fmt="parquet").collect()) == [0, 3, 5, 6]
    assert files(1) == before[0]


def test_renames_and_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "seen_at int")
    assert rename_columns(df, {"seen_at": "timestamp_dt"}).columns == ["timestamp_dt"]
    with pytest.raises(ValueError, match="Missing"):
        rename_columns(df, {"other": "x"})


def test_stored_tables_are_pruned_and_dropped(spark):
    import os

    from pyspark.sql import functions as F

    from ripen.session import drop_stored, store, stored_mark

    mark = stored_mark()
    kept = store(spark.range(100).select("id", (F.col("id") * 2).alias("a"), F.array("id").alias("b")))
    plan = kept.filter("id > 90").select("a")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,a:bigint>" in plan and "GreaterThan(id,90)" in plan
    folder = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    drop_stored(spark, mark)
    assert not os.path.isdir(folder) and stored_mark() == mark


def test_a_session_names_its_checkpoint_folder(spark):
    from ripen.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    first = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == first
