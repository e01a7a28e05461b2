"""Feedback-shift importance weighting (Yasui et al., 2020): tables and weights.

A counterfactual deadline tau days before the end of training tells, for impressions old
enough, whether a label read at the deadline would have been right.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_timestamp, clip_probability
from .conform import EVENT, START
from .maturity import known_by

WEIGHT_EPS = 1e-6
DEFAULT_TAU_DAYS = 2
OBSERVED, ELAPSED, ELAPSED_DEADLINE = "y_obs", "elapsed", "elapsed_deadline"


def _seconds_to(moment) -> Column:
    return (F.unix_micros(as_timestamp(moment)) - F.unix_micros(START)) / F.lit(1e6)


def check_tau(tau_days: int, max_delay_days: int | None) -> None:
    if max_delay_days is not None and tau_days >= max_delay_days:
        raise ValueError(
            f"tau_days={tau_days} must be smaller than the longest delay ({max_delay_days} days)."
        )


def observe(df: DataFrame, train_end: dt.date, tau_days: int = DEFAULT_TAU_DAYS) -> DataFrame:
    """Label as of ``train_end`` and the time elapsed to it and to the deadline."""
    deadline = train_end - dt.timedelta(days=tau_days)
    return df.withColumns({
        OBSERVED: known_by(train_end).cast("int"),
        ELAPSED: _seconds_to(train_end),
        ELAPSED_DEADLINE: _seconds_to(deadline),
    })


def _event_before(deadline: dt.date) -> Column:
    return F.coalesce(F.col(EVENT) < as_timestamp(deadline), F.lit(False))


def positive_table(observed: DataFrame, train_end: dt.date, tau_days: int = DEFAULT_TAU_DAYS) -> DataFrame:
    """Observed converters older than the deadline; ``s`` = converted before the deadline."""
    deadline = train_end - dt.timedelta(days=tau_days)
    return observed.filter(
        (F.col(START) < as_timestamp(deadline)) & (F.col(OBSERVED) == 1)
    ).withColumn("s", _event_before(deadline).cast("int"))


def negative_table(observed: DataFrame, train_end: dt.date, tau_days: int = DEFAULT_TAU_DAYS) -> DataFrame:
    """Rows that looked negative at the deadline; ``s`` = still negative at ``train_end``."""
    deadline = train_end - dt.timedelta(days=tau_days)
    late = F.coalesce(F.col(EVENT) >= as_timestamp(deadline), F.lit(False))
    return observed.filter(
        (F.col(START) < as_timestamp(deadline)) & ((F.col(OBSERVED) == 0) | late)
    ).withColumn("s", (F.col(OBSERVED) == 0).cast("int"))


def importance_weight(p_positive: Column, p_negative: Column) -> Column:
    """1/p for observed converters, p for the rest, with p kept off 0 and 1."""
    return F.when(
        F.col(OBSERVED) == 1, F.lit(1.0) / clip_probability(p_positive, WEIGHT_EPS)
    ).otherwise(clip_probability(p_negative, WEIGHT_EPS))
