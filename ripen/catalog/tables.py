"""The stages the catalog's queries start from, built on the event log."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sigmoid
from ..operators.conform import Conformed, conform
from ..operators.running import HotKeys, find_hot_keys
from ..plans.folds import Fold
from ..plans.prepare import PreprocessConfig, prepare_fold, with_buckets, with_history
from ..session import prepare_session, store
from ..sources.events import IMPRESSION_TYPES, LOG_START_EPOCH, raw_impressions, read_events

CONFIG = PreprocessConfig(log_start_epoch=LOG_START_EPOCH)
FOLD_LENGTHS = (15, 2, 2)
INNER_LENGTHS = (12, 1, 1)
FIRST_DAY = dt.date(2024, 1, 1)
FOLD = Fold(1, FIRST_DAY, dt.date(2024, 1, 16), dt.date(2024, 1, 18))
CATS = ("campaign", "cat1", "cat2", "cat3", "cat4")
N_HEADS = 4
TAU_DAYS = 2


def hot_users(events: DataFrame, hot_rows: int = CONFIG.hot_rows) -> HotKeys:
    """Busy users of the relevant events, which serve every running aggregate over them."""
    relevant = events.filter(F.col("event_type").isin(*IMPRESSION_TYPES, "purchase"))
    return find_hot_keys(relevant.withColumnRenamed("user_id", "uid"), "uid", hot_rows)


def raw(spark: SparkSession, sf_dir: str, *, hot_rows: int = CONFIG.hot_rows) -> DataFrame:
    events = read_events(prepare_session(spark), sf_dir)
    return raw_impressions(events, hot=hot_users(events, hot_rows))


def history(spark: SparkSession, sf_dir: str, *, hot_rows: int = CONFIG.hot_rows) -> DataFrame:
    events = read_events(prepare_session(spark), sf_dir)
    hot = hot_users(events, hot_rows)
    return with_history(raw_impressions(events, hot=hot), CONFIG, hot=hot)


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preprocessed rows; the intermediate table is written once, as later stages scan it
    several times (horizon, cut-offs, vocabularies)."""
    return with_buckets(store(history(spark, sf_dir)), CONFIG)


def conformed(spark: SparkSession, sf_dir: str) -> Conformed:
    return conform(bucketed(spark, sf_dir), n_buckets=N_HEADS)


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Conformed]:
    """The first outer fold, ready for splitting; written once, as its readers take several
    splits of it."""
    clean = conformed(spark, sf_dir)
    return store(prepare_fold(clean.rows, FOLD, clean.cuts, clean.categorical)), clean


def formula_logit():
    """A closed-form score that stands in for a fitted model where results are compared
    with SQL."""
    return (
        F.lit(-0.2)
        + F.lit(0.3) * F.ln(F.lit(1.0) + F.col("n_previous_conversions"))
        - F.lit(0.05) * (F.col("campaign") - 4)
        + F.lit(0.4) * F.col("click")
        - F.lit(0.1) * F.ln(F.lit(1.0) + F.col("impression_number"))
    )


def head_logits():
    return [F.col("z") - F.lit(0.5) * k for k in range(1, N_HEADS + 1)]


def scored(rows: DataFrame) -> DataFrame:
    """Add the score ``z``, its probability ``p`` and the label ``y``."""
    return rows.withColumn("z", formula_logit()).withColumns({
        "p": sigmoid(F.col("z")), "y": F.col("conversion"),
    })


def materialised(spark: SparkSession, sf_dir: str) -> Conformed:
    """The conformed rows written once, as an experiment reads them fold after fold."""
    clean = conformed(spark, sf_dir)
    return replace(clean, rows=store(clean.rows))
