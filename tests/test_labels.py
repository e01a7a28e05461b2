"""Delay buckets, maturity masks, heads and importance-weight tables on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ripen.functions import hash_keep
from ripen.operators import conform, delays, heads, history, maturity, shift, splits, vocabulary
from ripen.plans.folds import Fold
from ripen.plans.prepare import PreprocessConfig, Sampling, prepare_fold, preprocess

DAY = 86_400
EDGES = (0.0, DAY, 4 * DAY, 8 * DAY, 12 * DAY)
END = dt.date(2024, 1, 16)


def ts(days, seconds=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=days, seconds=seconds)


def test_bucket_edges_are_half_open_and_the_last_is_closed(spark):
    delays_ = [-1, 0, DAY - 1, DAY, 4 * DAY, 8 * DAY - 1, 8 * DAY, 12 * DAY, 12 * DAY + 1]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(delays_)], "i int, conversion_delay long")
    rows = delays.add_delay_buckets(df, EDGES).orderBy("i").collect()
    assert [r.bucket and r.bucket.bucket_id for r in rows] == [None, 1, 1, 2, 3, 3, 4, 4, None]
    assert rows[0].bucket_vec == [0, 0, 0, 0] and rows[3].bucket_vec == [0, 1, 0, 0]
    assert rows[7].bucket.upper_bound == 12 * DAY and rows[8].bucket_vec == [0, 0, 0, 0]


def test_edges_must_increase():
    with pytest.raises(ValueError, match="increase"):
        delays.bucket_edges(7 * DAY)
    assert delays.bucket_edges(10 * DAY)[-1] == 10 * DAY


def test_late_cutoff_keeps_the_boundary_and_all_non_converters(spark):
    df = spark.createDataFrame(
        [(1, 1, delays.LATE_CUTOFF), (2, 1, delays.LATE_CUTOFF + 1), (3, 0, -1)],
        "impression_id int, conversion int, conversion_delay long")
    assert {r[0] for r in delays.drop_late_conversions(df).collect()} == {1, 3}


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("impression_id"), (F.col("id") % 3 == 0).cast("int").alias("conversion"))
    kept = [
        sorted(r[0] for r in delays.downsample(df.repartition(n), row_share=0.5).select("impression_id").collect())
        for n in (1, 8)
    ]
    assert kept[0] == kept[1]
    negatives = delays.downsample(df, row_share=1.0).filter("conversion = 0").count()
    assert abs(negatives / (5000 * 2 / 3) - 0.75) < 0.03
    assert delays.downsample(df, row_share=1.0).filter("conversion = 1").count() == 1667


def test_horizon_and_cuts(spark):
    df = delays.add_delay_buckets(
        spark.createDataFrame([(d,) for d in (5, 2 * DAY, 5 * DAY, 9 * DAY)], "conversion_delay long"),
        (0.0, DAY, 4 * DAY, 8 * DAY, 9 * DAY))
    assert delays.horizon(df) == 9 * DAY
    assert delays.read_cuts(df, 4) == (DAY, 4 * DAY, 8 * DAY, 9 * DAY)
    with pytest.raises(ValueError, match="Buckets 1 to 4"):
        delays.read_cuts(df.filter("conversion_delay > 10"), 4)
    with pytest.raises(ValueError, match="horizon"):
        delays.horizon(df.filter("conversion_delay > 1e9"))


def masks(spark, rows):
    df = spark.createDataFrame(rows, "conversion int, timestamp_dt timestamp, conversion_timestamp_dt timestamp")
    return [list(r[0]) for r in maturity.add_masks(df, END, EDGES[1:]).select("mask_train").collect()]


def test_mask_edges(spark):
    found = masks(spark, [
        (1, ts(14), ts(15)),            # known exactly at the end of training
        (1, ts(14), ts(15, 1)),         # one second later
        (0, ts(14), None),              # exactly one day old
        (0, ts(14, 1), None),           # a second younger
        (0, ts(3), None),               # twelve days old
        (1, ts(16), ts(17)),            # in the future
    ])
    assert found == [[1, 1, 1, 1], [1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1], [0, 0, 0, 0]]
    for mask in found:
        assert mask == sorted(mask, reverse=True)


def test_mask_needs_cuts(spark):
    with pytest.raises(ValueError):
        maturity.add_masks(spark.range(1), END, ())


def test_supervised_modes(spark):
    df = spark.createDataFrame(
        [(1, 0, ts(3), None), (2, 0, ts(10), None), (3, 0, ts(14, 1), None), (4, 0, ts(15), None)],
        "impression_id int, conversion int, timestamp_dt timestamp, conversion_timestamp_dt timestamp")
    masked = maturity.add_masks(df, END, EDGES[1:])
    assert {r[0] for r in maturity.supervised(masked, END).collect()} == {1}
    assert {r[0] for r in maturity.supervised(masked, END, any_head=True).collect()} == {1, 2}
    assert {r[0] for r in splits.train_all(masked, END).collect()} == {1, 2, 3}
    stats = maturity.mask_stats(masked, END).first()
    assert (stats.n_rows, stats.n_train, stats.n_immature, stats.n_test) == (4, 3, 2, 1)


def test_null_category_differs_from_unseen(spark):
    df = spark.createDataFrame(
        [(1, 0), (2, 5), (3, 7)], "impression_id int, c int")
    train = df.filter("impression_id < 3")
    for small in (0, 1_000_000):
        mapped = vocabulary.map_unseen(df, train, ["c"], small=small).orderBy("impression_id")
        assert [r.c for r in mapped.collect()] == [0, 5, -1]


def test_category_index_slots(spark):
    df = spark.createDataFrame([(1, 5), (2, 2), (3, None)], "impression_id int, c int")
    kept = {(r["value"], r["index"]) for r in vocabulary.category_index(df, ["c"]).collect()}
    assert kept == {(-1, 0), (2, 1), (5, 2)}
    zero = {(r["value"], r["index"]) for r in vocabulary.category_index(df, ["c"], keep_unseen=False).collect()}
    assert zero == {(0, 0), (2, 1), (5, 2)}


def test_unseen_values_raise_or_become_zero(spark):
    train = spark.createDataFrame([(1, 5)], "impression_id int, c int")
    other = spark.createDataFrame([(2, 9)], "impression_id int, c int")
    index = vocabulary.category_index(train, ["c"])
    with pytest.raises(Exception, match="Unseen value in 'c': 9"):
        vocabulary.encode_categories(other, index, ["c"]).collect()
    assert vocabulary.encode_categories(other, index, ["c"], unseen="zero").first()["c_idx"] == 0


def test_risk_set_and_person_period(spark):
    df = spark.createDataFrame([(1, [0, 1, 0, 0], [1, 1, 1, 0]), (2, [0, 0, 0, 0], [1, 0, 0, 0])],
                               "impression_id int, bucket_vec array<int>, mask_train array<int>")
    rows = heads.person_period(df, 4).orderBy("impression_id", "head").collect()
    assert [r.at_risk for r in rows] == [1, 1, 0, 0, 1, 1, 1, 1]
    assert [r.weight for r in rows] == [1, 1, 0, 0, 1, 0, 0, 0]
    plain = heads.person_period(df, 4, risk_set=False).orderBy("impression_id", "head").collect()
    assert [r.weight for r in plain] == [1, 1, 1, 0, 1, 0, 0, 0]


def test_hazard_is_at_least_each_head(spark):
    df = spark.createDataFrame([(-1.0, 0.5, 2.0), (-30.0, -30.0, -30.0)], "a double, b double, c double")
    row = df.select(
        heads.hazard_probability([F.col("a"), F.col("b"), F.col("c")]).alias("p"),
        F.greatest(*[1 / (1 + F.exp(-F.col(x))) for x in "abc"]).alias("top")).collect()
    assert all(r.p >= r.top - 1e-12 for r in row)


def test_importance_tables(spark):
    # deadline two days before the end: 2024-01-14
    df = spark.createDataFrame([
        (1, 1, ts(5), ts(6)),       # converted before the deadline
        (2, 1, ts(5), ts(13)),      # exactly at the deadline
        (3, 1, ts(5), ts(15)),      # exactly at the end: observed
        (4, 1, ts(5), ts(15, 1)),   # after the end: not observed
        (5, 0, ts(5), None),
        (6, 0, ts(13), None),       # starts at the deadline: too young
    ], "impression_id int, conversion int, timestamp_dt timestamp, conversion_timestamp_dt timestamp")
    seen = shift.observe(df, END, 2)
    assert {r.impression_id: r.y_obs for r in seen.collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    d1 = {r.impression_id: r.s for r in shift.positive_table(seen, END, 2).collect()}
    d0 = {r.impression_id: r.s for r in shift.negative_table(seen, END, 2).collect()}
    assert d1 == {1: 1, 2: 0, 3: 0}
    assert d0 == {2: 0, 3: 0, 4: 1, 5: 1}
    weights = seen.select("y_obs", shift.importance_weight(F.lit(0.25), F.lit(0.5)).alias("w")).collect()
    assert all(r.w == (4.0 if r.y_obs else 0.5) for r in weights)
    with pytest.raises(ValueError, match="tau"):
        shift.check_tau(12, 12)


def conformed_rows(spark):
    return spark.createDataFrame([
        (1, 1, ts(0), ts(1), 1, 3, None, [1, 0, 0, 0]),
        (2, 0, ts(1), None, 0, None, 2.0, None),
        (3, 0, ts(16), None, 0, 9, 1.0, [0, 0, 0, 0]),
    ], "impression_id int, conversion int, timestamp_dt timestamp, conversion_timestamp_dt timestamp,"
       " click int, cat1 int, impression_number double, bucket_vec array<int>").withColumn(
        "bucket", F.explode(F.array(*[
            F.struct(F.lit(k).alias("bucket_id"), F.lit(float(u)).alias("upper_bound"))
            for k, u in enumerate(EDGES[1:], 1)]))).filter(
        "bucket.bucket_id = impression_id or (impression_id = 3 and bucket.bucket_id = 4)")


def test_conform_checks_and_fills(spark):
    clean = conform.conform(conformed_rows(spark))
    assert clean.categorical == ("cat1",) and clean.numeric == ("impression_number",)
    assert clean.horizon == 12 * DAY
    rows = {r.impression_id: r for r in clean.rows.collect()}
    assert rows[2].cat1 == 0 and rows[2].bucket_vec == [0, 0, 0, 0] and rows[1].impression_number is None
    with pytest.raises(ValueError, match="Missing columns"):
        conform.conform(conformed_rows(spark).drop("click"))
    assert "click" not in conform.conform(conformed_rows(spark).drop("click"), aux=None).rows.columns


def test_prepare_fold(spark):
    clean = conform.conform(conformed_rows(spark))
    fold = Fold(1, dt.date(2024, 1, 1), END, dt.date(2024, 1, 18))
    rows = {r.impression_id: r for r in prepare_fold(clean.rows, fold, clean.cuts, clean.categorical).collect()}
    assert rows[3].cat1 == -1 and rows[2].cat1 == 0 and rows[1].cat1 == 3
    assert rows[1].mask_eval == [1, 1, 1, 1] and rows[1].aux_mask == 1


def test_history_of_a_first_impression_and_ties(spark):
    df = spark.createDataFrame([
        (2, "u", 10, 50, 1), (1, "u", 10, -1, 0), (3, "u", 30, -1, 0), (4, "v", 5, -1, 0),
    ], "impression_id int, uid string, timestamp long, conversion_timestamp long, conversion int")
    timed = history.add_delay_and_times(df, 1_704_067_200)
    rows = {r.impression_id: r for r in history.add_user_history(timed).collect()}
    assert [rows[i].impression_number for i in (1, 2, 3, 4)] == [1, 2, 3, 1]
    assert rows[1].time_since_last_impression is None and rows[2].time_since_last_impression == 0
    assert rows[3].n_previous_conversions == 1 and rows[2].n_previous_conversions == 0
    assert rows[2].conversion_delay == 40 and rows[1].conversion_delay == -1
    known = {r.impression_id: r.n_known_conversions for r in history.add_known_conversions(timed).collect()}
    assert known == {1: 0, 2: 0, 3: 0, 4: 0}  # it converts at 50, after the third impression


def test_content_id_is_repeatable(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    first = [r[0] for r in df.select(history.content_id("x", "y")).collect()]
    again = [r[0] for r in df.repartition(3).select(history.content_id("x", "y")).collect()]
    assert sorted(first) == sorted(again) and len(set(first)) == 2


def test_small_shares_are_kept_exactly(spark):
    rows = spark.range(1_000_000)
    kept = rows.where(hash_keep(F.col("id"), 4e-5, 1)).count()
    assert 15 <= kept <= 70
    assert rows.where(hash_keep(F.col("id"), 0.0, 1)).count() == 0
    assert rows.where(hash_keep(F.col("id"), 1.0, 1)).count() == 1_000_000
    with pytest.raises(ValueError):
        hash_keep(F.col("id"), 1.5, 1)


def test_preprocessing_keeps_all_rows_unless_asked(spark):
    day = 86_400
    raw = spark.range(400).selectExpr(
        "id AS impression_id", "id % 40 AS uid", f"id * {day // 10} AS timestamp", "cast(id % 4 = 0 AS int) AS conversion",
        f"CASE WHEN id % 4 = 0 THEN id * {day // 10} + (1 + id % 11) * {day} ELSE -1 END AS conversion_timestamp")
    config = PreprocessConfig(log_start_epoch=1_700_000_000)
    assert preprocess(raw, config).count() == 400
    assert preprocess(raw, config, sampling=Sampling(row_share=0.5)).count() < 300


def test_text_and_mixed_categories(spark):
    rows = spark.createDataFrame(
        [(1, "a", 5), (2, "b", 6), (3, None, None), (4, "a", 7)], "impression_id long, site string, place int")
    train = rows.where("impression_id in (1, 2)")
    for small in (1_000_000, 0):
        mapped = vocabulary.map_unseen(rows, train, ["site", "place"], small=small)
        assert sorted(map(tuple, mapped.collect())) == [
            (1, "a", 5), (2, "b", 6), (3, "__MISSING__", -1), (4, "a", -1)]
        index = vocabulary.category_index(train, ["site", "place"])
        coded = vocabulary.encode_categories(mapped, index, ["site", "place"], small=small)
        found = {r["impression_id"]: (r["site_idx"], r["place_idx"]) for r in coded.collect()}
        assert found == {1: (1, 1), 2: (2, 2), 3: (0, 0), 4: (1, 0)}


def test_the_day_survives_conforming(spark, tmp_path):
    rows = spark.range(40).selectExpr(
        "id AS impression_id", "cast(id % 4 = 0 AS int) AS conversion", "timestamp'2024-01-01' + make_dt_interval(cast(id AS int)) AS timestamp_dt",
        "timestamp'2024-02-01' AS conversion_timestamp_dt", "0 AS click", "array(0, 0, 0, 0) AS bucket_vec",
        "named_struct('bucket_id', cast(1 + id % 4 AS int), 'lower_bound', 0D, 'upper_bound', cast(1 + id % 4 AS double)) AS bucket")
    rows.withColumn("event_date", F.to_date("timestamp_dt")).write.partitionBy("event_date").parquet(str(tmp_path / "t"))
    clean = conform.conform(spark.read.parquet(str(tmp_path / "t")))
    sliced = splits.window_slice(clean.rows, dt.date(2024, 1, 3), dt.date(2024, 1, 5))
    plan = sliced._jdf.queryExecution().toString()
    assert sliced.count() == 2 and "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_numbers_keep_their_order_beside_texts(spark):
    from ripen.operators import vocabulary

    df = spark.createDataFrame([(10, "b", "10"), (2, "a", "9"), (1, None, "2")], "a int, t string, d string")
    alone = vocabulary.category_index(df, ["a"]).collect()
    for max_rows in (1_000_000, 2):
        both = vocabulary.category_index(df, ["a", "t", "d"], max_rows=max_rows).collect()
        index = {(r["column"], r["value"]): r["index"] for r in both}
        assert [index["a", str(v)] for v in (-1, 1, 2, 10)] == [0, 1, 2, 3] == [
            {r["value"]: r["index"] for r in alone}[v] for v in (-1, 1, 2, 10)]
        assert [index["d", v] for v in ("10", "2", "9", "__MISSING__")] == [0, 1, 2, 3]


def test_two_million_texts_are_indexed_in_few_jobs(spark):
    from ripen.operators import vocabulary
    from ripen.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    n = 2_000_000
    df = spark.range(n).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("c"))
    spark.sparkContext.setJobGroup("index", "index")
    index = vocabulary.category_index(df, ["c"])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("index"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8
    wrong = index.where("value <> '__MISSING__' AND index <> cast(substr(value, 2) AS int) + 1")
    assert wrong.isEmpty() and index.agg(F.count("*"), F.max("index")).first()[:] == (n + 1, n)


def test_only_heavy_values_are_salted(spark):
    from ripen.operators import vocabulary

    n = 30_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, -5).when(F.col("id") % 31 == 1, None).otherwise(F.col("id")).alias("c"))
    entries = df.select(F.col("c").alias("value")).distinct().where("value IS NOT NULL").withColumn("w", F.col("value") * 2)
    assert vocabulary.heavy_values(df, ["c"]) == {"c": [-5]}
    left, salted = vocabulary.salted_sides(df, "c", entries, [-5], "id")
    assert salted.count() == entries.count() - 1 + vocabulary.SALTS
    dealt = {r["_salt"]: r["count"] for r in left.where("c = -5").groupBy("_salt").count().collect()}
    assert len(dealt) == vocabulary.SALTS and max(dealt.values()) < 2 * n / 3 / vocabulary.SALTS
    out = vocabulary.lookup(df, "c", entries, entries.count(), small=10, row_key="id")
    assert out.count() == n and out.where("NOT (w <=> c * 2)").isEmpty()


def test_text_categories_pass_through_conforming(spark):
    from ripen.operators.conform import conform
    from ripen.plans.prepare import prepare_fold
    from ripen.plans.folds import Fold

    rows = [(i, dt.datetime(2024, 1, 1 + i), 0, None, 0, [0, 0, 0, 0], [None, "shop", "news"][i % 3], 7) for i in range(6)]
    df = spark.createDataFrame(rows, "impression_id int, timestamp_dt timestamp, conversion int, conversion_timestamp_dt timestamp, "
                                     "click int, bucket_vec array<int>, cat1 string, campaign int")
    df = df.withColumn("bucket", F.expr("named_struct('bucket_id', 1 + pmod(impression_id, 4), 'lower_bound', 0.0D, 'upper_bound', 1.0D * (1 + pmod(impression_id, 4)))"))
    clean = conform(df, texts=["cat1"])
    assert dict(clean.rows.dtypes)["cat1"] == "string"
    fold = Fold(1, dt.date(2024, 1, 1), dt.date(2024, 1, 3), dt.date(2024, 1, 7))
    found = {r.impression_id: r.cat1 for r in prepare_fold(clean.rows, fold, clean.cuts, clean.categorical).collect()}
    assert found[0] == "" and found[1] == "shop" and found[2] == "__MISSING__" and found[4] == "shop"
