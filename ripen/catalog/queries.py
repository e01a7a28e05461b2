"""Named queries.  Each takes (spark, sf_dir) and reads the event log; those of one fold go on with the
fold's window of it.

Arrays are flattened and doubles rounded to six places, so that results can be compared
with SQL value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import any_one, epoch_seconds, exploded_positions, sigmoid
from ..operators import (
    calibration, delays, heads, history, maturity, metrics, numerics, ranking, shift, splits, vocabulary,
)
from ..plans import folds as fold_plans
from ..sources.events import LOG_START_EPOCH
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    from . import model_queries  # noqa: F401  (registers the model and streaming queries)

    return dict(_QUERIES)


def r6(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Round every double column that is not in ``keep``."""
    return df.select(*[
        r6(c).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes
    ])


def ids(df: DataFrame) -> DataFrame:
    return df.select("impression_id")


def _epoch(name: str) -> Column:
    return epoch_seconds(F.col(name))


# --- ingest and features -------------------------------------------------------------

@query
def attribution(spark, sf_dir):
    return t.raw(spark, sf_dir)


@query
def conversion_delay(spark, sf_dir):
    return history.add_delay_and_times(t.raw(spark, sf_dir), LOG_START_EPOCH).select(
        "impression_id", "conversion_delay")


@query
def timestamps(spark, sf_dir):
    timed = history.add_delay_and_times(t.raw(spark, sf_dir), LOG_START_EPOCH)
    return timed.select(
        "impression_id",
        _epoch("timestamp_dt").alias("start_s"),
        _epoch("conversion_timestamp_dt").alias("event_s"),
        epoch_seconds(F.date_trunc("day", "timestamp_dt")).alias("day_s"),
        F.date_add("timestamp_dt", 15).cast("string").alias("plus_15_days"),
        F.date_sub(F.to_date("timestamp_dt"), 1).cast("string").alias("minus_1_day"),
    )


_FEATURES = ("impression_id", "n_previous_conversions", "time_since_last_impression",
             "impression_number", "time_since_last_click")


@query
def user_features(spark, sf_dir):
    return t.history(spark, sf_dir).select(*_FEATURES)


@query
def user_features_split(spark, sf_dir):
    """The same features with every busy user cut into time slices."""
    return t.history(spark, sf_dir, hot_rows=20).select(*_FEATURES)


@query
def user_features_asof(spark, sf_dir):
    return _known(spark, sf_dir, t.CONFIG.hot_rows)


@query
def user_features_asof_split(spark, sf_dir):
    """The same count with every busy user cut into time slices."""
    return _known(spark, sf_dir, 20)


def _known(spark, sf_dir, hot_rows):
    events = t.read_events(t.prepare_session(spark), sf_dir)
    hot = t.hot_users(events, hot_rows)
    timed = history.add_delay_and_times(t.raw_impressions(events, hot=hot), LOG_START_EPOCH)
    return history.add_known_conversions(timed, hot=hot).select("impression_id", "n_known_conversions")


@query
def content_ids(spark, sf_dir):
    return t.raw(spark, sf_dir).select(
        "impression_id", history.content_id("uid", "timestamp", "cat1").alias("row_key"))


# --- buckets ---------------------------------------------------------------------------

@query
def late_cutoff(spark, sf_dir):
    return delays.drop_late_conversions(t.history(spark, sf_dir)).select(
        "impression_id", "conversion", "conversion_delay")


@query
def hash_downsample(spark, sf_dir):
    kept = delays.drop_late_conversions(t.history(spark, sf_dir))
    return delays.downsample(kept).select("impression_id", "conversion")


@query
def horizon(spark, sf_dir):
    kept = delays.drop_late_conversions(t.history(spark, sf_dir))
    return kept.agg(F.max("conversion_delay").alias("horizon")).withColumn(
        "max_delay_days", F.ceil(F.col("horizon") / 86400).cast("long"))


@query
def delay_buckets(spark, sf_dir):
    return t.bucketed(spark, sf_dir).select(
        "impression_id", "bucket.bucket_id", "bucket.lower_bound", "bucket.upper_bound",
        *exploded_positions(F.col("bucket_vec"), t.N_HEADS, "b"))


@query
def bucket_counts(spark, sf_dir):
    return t.bucketed(spark, sf_dir).groupBy(F.col("bucket.bucket_id").alias("bucket_id")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def bucket_cuts(spark, sf_dir):
    return delays.bucket_cuts(t.bucketed(spark, sf_dir)).select("bucket_id", "upper_bound")


@query
def conform(spark, sf_dir):
    rows = t.conformed(spark, sf_dir).rows
    return rows.withColumns({
        "start_s": _epoch("timestamp_dt"), "event_s": _epoch("conversion_timestamp_dt"),
        **{f"b{k}": F.element_at("bucket_vec", k) for k in range(1, t.N_HEADS + 1)},
    }).drop("timestamp_dt", "conversion_timestamp_dt", "bucket_vec")


@query
def span(spark, sf_dir):
    found = delays.time_span(t.bucketed(spark, sf_dir))
    return found.select(*[_epoch(c).alias(c) for c in found.columns])


# --- folds -------------------------------------------------------------------------------

def _outer(rows: DataFrame) -> list[fold_plans.Fold]:
    last = rows.agg(F.max("timestamp_dt")).first()[0]
    return fold_plans.outer_folds(t.FIRST_DAY, last, t.FOLD_LENGTHS)


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes
    ])


@query
def outer_folds(spark, sf_dir):
    return _dates_as_text(fold_plans.folds_frame(spark, _outer(t.bucketed(spark, sf_dir))))


@query
def inner_folds(spark, sf_dir):
    outer = _outer(t.bucketed(spark, sf_dir))
    frames = [
        fold_plans.folds_frame(spark, fold_plans.inner_folds(f, t.INNER_LENGTHS))
        .withColumn("outer_fold", F.lit(f.fold_id))
        for f in outer
    ]
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame)
    return _dates_as_text(combined)


@query
def fold_rows(spark, sf_dir):
    """Rows per outer fold and phase, all folds in one job."""
    rows = t.conformed(spark, sf_dir).rows
    folds = _outer(rows)
    exploded = fold_plans.explode_folds(rows, folds)
    train_end = fold_plans.by_fold(folds, lambda f: F.lit(f.train_end).cast("timestamp"))
    return exploded.groupBy("fold_id", (F.col("timestamp_dt") < train_end).cast("int").alias("is_train")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def window_slice(spark, sf_dir):
    rows = t.conformed(spark, sf_dir).rows
    return ids(splits.window_slice(rows, t.FOLD.train_start, t.FOLD.test_end))


def _masked(spark, sf_dir):
    clean = t.conformed(spark, sf_dir)
    sliced = splits.window_slice(clean.rows, t.FOLD.train_start, t.FOLD.test_end)
    return maturity.add_masks(sliced, t.FOLD.train_end, clean.cuts, "click")


@query
def train_mask(spark, sf_dir):
    return _masked(spark, sf_dir).select(
        "impression_id", "aux_mask",
        *exploded_positions(F.col("mask_train"), t.N_HEADS, "m"),
        *exploded_positions(F.col("mask_eval"), t.N_HEADS, "e"))


@query
def row_age(spark, sf_dir):
    from ..functions import seconds_since

    return _masked(spark, sf_dir).select(
        "impression_id", seconds_since(F.col("timestamp_dt"), t.FOLD.train_end).alias("age"))


@query
def supervised(spark, sf_dir):
    return ids(maturity.supervised(_masked(spark, sf_dir), t.FOLD.train_end))


@query
def unknown_categories(spark, sf_dir):
    return t.prepared(spark, sf_dir)[0].select("impression_id", *t.CATS)


@query
def unknown_categories_shuffled(spark, sf_dir):
    """The same mapping as if every vocabulary were too large to broadcast."""
    clean = t.conformed(spark, sf_dir)
    rows = t.prepare_fold(clean.rows, t.FOLD, clean.cuts, clean.categorical, small=0)
    return rows.select("impression_id", *t.CATS)


@query
def unknown_strings(spark, sf_dir):
    rows = _masked(spark, sf_dir).withColumn("place", F.concat(F.lit("k"), F.col("cat1")))
    train = maturity.supervised(rows, t.FOLD.train_end)
    mapped = vocabulary.map_unseen(rows, train, ["place"], unknown=vocabulary.UNSEEN_TEXT)
    return mapped.select("impression_id", "place")


@query
def category_vocabulary(spark, sf_dir):
    train = maturity.supervised(_masked(spark, sf_dir), t.FOLD.train_end)
    return vocabulary.vocabulary(train, t.CATS)


@query
def mask_stats(spark, sf_dir):
    """Mask statistics of every outer fold, from one scan."""
    clean = t.conformed(spark, sf_dir)
    folds = _outer(clean.rows)
    exploded = fold_plans.explode_folds(clean.rows, folds)
    train_end = fold_plans.by_fold(folds, lambda f: F.lit(f.train_end).cast("timestamp"))
    masked = maturity.add_masks(exploded.withColumn("train_end", train_end), F.col("train_end"), clean.cuts)
    return rounded(maturity.mask_stats(masked, F.col("train_end"), ["fold_id"]))


# --- splits ------------------------------------------------------------------------------

@query
def train_single(spark, sf_dir):
    return ids(splits.train_single(t.prepared(spark, sf_dir)[0], t.FOLD.train_end))


@query
def train_multi(spark, sf_dir):
    return ids(splits.train_multi(t.prepared(spark, sf_dir)[0], t.FOLD.train_end))


@query
def test_split(spark, sf_dir):
    rows = t.prepared(spark, sf_dir)[0]
    return ids(splits.test_split(rows, t.FOLD.test_start, t.FOLD.test_end, mature_only=True))


@query
def cal_after(spark, sf_dir):
    start, end = splits.calibration_bounds_after(t.FOLD.train_end)
    return ids(splits.window_slice(t.prepared(spark, sf_dir)[0], start, end))


@query
def cal_before(spark, sf_dir):
    start, end = splits.calibration_bounds_before(t.FOLD.train_end, 1)
    return ids(splits.window_slice(t.prepared(spark, sf_dir)[0], start, end))


@query
def fsiw_train(spark, sf_dir):
    return ids(splits.train_all(t.prepared(spark, sf_dir)[0], t.FOLD.train_end))


def _test_rows(spark, sf_dir):
    rows = t.prepared(spark, sf_dir)[0]
    return splits.test_split(rows, t.FOLD.test_start, t.FOLD.test_end)


@query
def base_rate(spark, sf_dir):
    return rounded(splits.label_balance(_test_rows(spark, sf_dir)))


# --- encoding ----------------------------------------------------------------------------

@query
def cat_index(spark, sf_dir):
    rows = t.prepared(spark, sf_dir)[0]
    index = vocabulary.category_index(splits.train_single(rows, t.FOLD.train_end), t.CATS)
    coded = vocabulary.encode_categories(rows, index, t.CATS)
    return coded.select("impression_id", *[f"{c}_idx" for c in t.CATS])


@query
def cat_index_zero(spark, sf_dir):
    rows = t.prepared(spark, sf_dir)[0]
    train = splits.train_single(rows, t.FOLD.train_end)
    index = vocabulary.category_index(train, t.CATS, keep_unseen=False)
    coded = vocabulary.encode_categories(rows, index, t.CATS, unseen="zero")
    return coded.select("impression_id", *[f"{c}_idx" for c in t.CATS])


def _scaled(spark, sf_dir, kind):
    rows, clean = t.prepared(spark, sf_dir)
    train = splits.train_single(rows, t.FOLD.train_end)
    scales = numerics.fit_scales(train, clean.numeric, kind=kind)
    coded = numerics.add_scaled(rows, scales)
    return rounded(coded.select(
        "impression_id", *[f"{c}_{s}" for c in clean.numeric for s in ("z", "miss")]))


@query
def num_log1p_z(spark, sf_dir):
    return _scaled(spark, sf_dir, "log1p")


@query
def num_auto_z(spark, sf_dir):
    return _scaled(spark, sf_dir, "auto")


@query
def train_stats(spark, sf_dir):
    rows, clean = t.prepared(spark, sf_dir)
    return rounded(numerics.numeric_stats(splits.train_single(rows, t.FOLD.train_end), clean.numeric))


@query
def organic_share(spark, sf_dir):
    rows = t.prepared(spark, sf_dir)[0]
    return rounded(numerics.organic_share(splits.train_single(rows, t.FOLD.train_end)))


# --- heads -------------------------------------------------------------------------------

def _multi_train(spark, sf_dir):
    return t.scored(splits.train_multi(t.prepared(spark, sf_dir)[0], t.FOLD.train_end))


@query
def person_period(spark, sf_dir):
    return heads.person_period(_multi_train(spark, sf_dir), t.N_HEADS)


@query
def risk_set(spark, sf_dir):
    rows = _multi_train(spark, sf_dir)
    return rows.select("impression_id", *[
        c.alias(f"r{k}") for k, c in enumerate(heads.at_risk(F.col("bucket_vec"), t.N_HEADS), 1)])


@query
def any_head_label(spark, sf_dir):
    rows = _multi_train(spark, sf_dir)
    return rows.select(
        "impression_id", any_one(F.col("bucket_vec")).cast("int").alias("y_any"),
        heads.clipped_label(F.col("click")).alias("click_clipped"))


@query
def hazard(spark, sf_dir):
    rows = t.scored(_test_rows(spark, sf_dir))
    return rows.select("impression_id", r6(heads.hazard_probability(t.head_logits())).alias("p"))


@query
def masked_bce(spark, sf_dir):
    rows = heads.person_period(_multi_train(spark, sf_dir), t.N_HEADS, keep=("impression_id", "z"))
    logit = F.col("z") - F.lit(0.5) * F.col("head")
    return rows.groupBy("head").agg(
        r6(heads.masked_cross_entropy(F.col("label"), logit, F.col("weight"))).alias("loss"),
        F.sum("weight").alias("weight"))


def _click_logit():
    return F.lit(-0.1) + F.lit(0.02) * F.col("cat1")


@query
def ctcvr(spark, sf_dir):
    rows = t.scored(_test_rows(spark, sf_dir))
    return rows.select("impression_id", r6(
        heads.click_and_convert_probability(_click_logit(), F.col("z"))).alias("p"))


# --- importance weighting ----------------------------------------------------------------

def _observed(spark, sf_dir):
    rows = splits.train_all(t.prepared(spark, sf_dir)[0], t.FOLD.train_end)
    return shift.observe(rows, t.FOLD.train_end, t.TAU_DAYS)


@query
def fsiw_observed(spark, sf_dir):
    return _observed(spark, sf_dir).select("impression_id", "y_obs", "elapsed", "elapsed_deadline")


@query
def fsiw_d1(spark, sf_dir):
    return shift.positive_table(_observed(spark, sf_dir), t.FOLD.train_end, t.TAU_DAYS).select(
        "impression_id", "elapsed_deadline", "s")


@query
def fsiw_d0(spark, sf_dir):
    return shift.negative_table(_observed(spark, sf_dir), t.FOLD.train_end, t.TAU_DAYS).select(
        "impression_id", "elapsed_deadline", "s")


@query
def fsiw_weights(spark, sf_dir):
    rows = t.scored(_observed(spark, sf_dir))
    p_positive = sigmoid(F.col("z") + F.col("elapsed") / 432000.0)
    p_negative = sigmoid(F.col("elapsed") / 432000.0 - F.col("z"))
    return rows.select(
        "impression_id", "y_obs", r6(shift.importance_weight(p_positive, p_negative)).alias("weight"))


# --- calibration -------------------------------------------------------------------------

def _cal_and_test(spark, sf_dir):
    rows = t.scored(t.prepared(spark, sf_dir)[0])
    start, end = splits.calibration_bounds_after(t.FOLD.train_end)
    return splits.window_slice(rows, start, end), splits.test_split(rows, end, t.FOLD.test_end)


def _platt_row(spark, platt):
    return spark.createDataFrame(
        [(float(platt.slope), float(platt.intercept))], "slope double, intercept double")


@query
def platt_intercept(spark, sf_dir):
    cal, _ = _cal_and_test(spark, sf_dir)
    return rounded(_platt_row(spark, calibration.fit_platt(cal, "z", "y")))


@query
def platt_slope(spark, sf_dir):
    cal, _ = _cal_and_test(spark, sf_dir)
    return rounded(_platt_row(spark, calibration.fit_platt(cal, "z", "y", slope=True)))


@query
def platt_apply(spark, sf_dir):
    cal, test = _cal_and_test(spark, sf_dir)
    calibrated, _ = calibration.calibrate(cal, test, F.col("z"), F.col("y"))
    return rounded(calibrated.select("impression_id", "p"))


@query
def calibrate_multi(spark, sf_dir):
    cal, test = _cal_and_test(spark, sf_dir)
    label = any_one(F.col("bucket_vec")).cast("int")
    calibrated, _ = calibration.calibrate(
        cal, test, calibration.hazard_logit(t.head_logits()), label, slope=True)
    return rounded(calibrated.select("impression_id", "p"))


@query
def calibrate_ctcvr(spark, sf_dir):
    cal, test = _cal_and_test(spark, sf_dir)
    x = calibration.click_and_convert_logit(_click_logit(), F.col("z"))
    calibrated, _ = calibration.calibrate(cal, test, x, F.col("y"))
    return rounded(calibrated.select("impression_id", "p"))


# --- evaluation --------------------------------------------------------------------------

def _predictions(spark, sf_dir):
    return t.scored(_test_rows(spark, sf_dir)).select("impression_id", "y", "p", "click")


@query
def nll_rce(spark, sf_dir):
    return rounded(metrics.loss_metrics(_predictions(spark, sf_dir)))


def _curve(spark, sf_dir, *names):
    table = ranking.score_table(_predictions(spark, sf_dir))
    return rounded(metrics.curve_metrics(table).select(*names))


@query
def avg_precision(spark, sf_dir):
    return _curve(spark, sf_dir, "ap")


@query
def pr_auc(spark, sf_dir):
    return _curve(spark, sf_dir, "pr_auc")


@query
def topk(spark, sf_dir):
    predictions = _predictions(spark, sf_dir)
    table = ranking.score_table(predictions)
    return rounded(metrics.top_metrics(predictions, table))


@query
def topk_ties(spark, sf_dir):
    """Scores of one decimal: the cuts fall inside large groups of equal scores."""
    predictions = _predictions(spark, sf_dir).withColumn("p", F.round("p", 1))
    hits = metrics.top_hits(predictions, ranking.score_table(predictions))
    return hits.select("share", "k", "tp")


@query
def eval_all(spark, sf_dir):
    return rounded(metrics.evaluate(_predictions(spark, sf_dir)))


@query
def eval_all_split(spark, sf_dir):
    """The same metrics with the score table cut into small pieces."""
    return rounded(metrics.evaluate(_predictions(spark, sf_dir), max_rows=40))


@query
def reliability(spark, sf_dir):
    return rounded(metrics.reliability(_predictions(spark, sf_dir)))


@query
def ece(spark, sf_dir):
    return rounded(metrics.calibration_error(_predictions(spark, sf_dir)))


@query
def box_stats(spark, sf_dir):
    return rounded(metrics.box_stats(_predictions(spark, sf_dir)))


@query
def box_stats_click(spark, sf_dir):
    return rounded(metrics.box_stats(_predictions(spark, sf_dir), label="click"))


@query
def eval_summary(spark, sf_dir):
    cal, test = _cal_and_test(spark, sf_dir)
    calibrated, _ = calibration.calibrate(cal, test.withColumnRenamed("p", "p_raw"), F.col("z"), F.col("y"))
    return rounded(metrics.summary(calibrated, raw="p_raw"))


def _fold_predictions(spark, sf_dir):
    """Formula scores of the test window of every outer fold, in one job."""
    rows = t.conformed(spark, sf_dir).rows
    folds = _outer(rows)
    return t.scored(fold_plans.explode_folds(rows, folds, part="test"))


def _folds_cal_and_test(spark, sf_dir):
    """The first test day and the rest of the test window of every outer fold."""
    rows = t.conformed(spark, sf_dir).rows
    folds = _outer(rows)
    late = t.scored(fold_plans.explode_folds(rows, folds, part="test"))
    cal_end = fold_plans.by_fold(folds, lambda f: F.lit(splits.calibration_bounds_after(f.train_end)[1]).cast("timestamp"))
    return late.filter(F.col("timestamp_dt") < cal_end), late.filter(F.col("timestamp_dt") >= cal_end)


def _platt_by_fold(spark, sf_dir, slope):
    cal, _ = _folds_cal_and_test(spark, sf_dir)
    cal = cal.select("fold_id", "z", "y")
    return rounded(calibration.platt_frame(cal, calibration.fit_platt_groups(cal, "z", "y", ["fold_id"], slope=slope), ["fold_id"]))


@query
def platt_intercept_folds(spark, sf_dir):
    """Calibration of every outer fold, all folds side by side."""
    return _platt_by_fold(spark, sf_dir, False)


@query
def platt_slope_folds(spark, sf_dir):
    return _platt_by_fold(spark, sf_dir, True)


@query
def calibrate_folds(spark, sf_dir):
    cal, test = _folds_cal_and_test(spark, sf_dir)
    found = calibration.calibrate_groups(cal, test.drop("p"), "z", "y", ["fold_id"])
    return rounded(found.select("fold_id", "impression_id", "p"))


@query
def platt_heads_folds(spark, sf_dir):
    """Calibration of every head of every outer fold: one aggregate per step for all of them."""
    cal, _ = _folds_cal_and_test(spark, sf_dir)
    heads_of = F.explode(F.array(*[
        F.struct(F.lit(k).alias("head"), (F.col("z") - F.lit(0.5) * k).alias("x"), F.element_at("bucket_vec", k).alias("label"))
        for k in range(1, t.N_HEADS + 1)]))
    rows = cal.select("fold_id", heads_of.alias("h")).select("fold_id", "h.*")
    by = ["fold_id", "head"]
    return rounded(calibration.platt_frame(rows, calibration.fit_platt_groups(rows, "x", "label", by, slope=True), by))


@query
def fold_average(spark, sf_dir):
    predictions = _fold_predictions(spark, sf_dir).select("fold_id", "impression_id", "y", "p")
    return rounded(metrics.average_folds(metrics.evaluate(predictions, by=["fold_id"])))


@query
def candidate_scores(spark, sf_dir):
    """Relative cross entropy of three steepness values, averaged over the folds."""
    candidates = F.explode(F.array(*[F.lit(c) for c in (0.5, 1.0, 2.0)]))
    predictions = _fold_predictions(spark, sf_dir).withColumn("candidate", candidates).withColumn(
        "p", sigmoid(F.col("z") * F.col("candidate")))
    per_fold = metrics.loss_metrics(predictions, by=["candidate", "fold_id"])
    return rounded(metrics.candidate_scores(per_fold), "candidate")


@query
def candidate_medians(spark, sf_dir):
    candidates = F.explode(F.array(*[F.lit(c) for c in (0.5, 1.0, 2.0)]))
    predictions = _fold_predictions(spark, sf_dir).withColumn("candidate", candidates).withColumn(
        "p", sigmoid(F.col("z") * F.col("candidate")))
    per_fold = metrics.loss_metrics(predictions, by=["candidate", "fold_id"])
    return rounded(metrics.candidate_scores(per_fold, "median"), "candidate")

