"""What was knowable at a point in time: maturity masks and supervised rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import all_ones, any_one, as_timestamp, last_element, seconds_since
from .conform import EVENT, START, TARGET

MASK_TRAIN, MASK_EVAL, MASK_AUX = "mask_train", "mask_eval", "aux_mask"


def known_by(moment) -> Column:
    """The conversion had happened at ``moment`` (inclusive); false, never null."""
    return F.coalesce(
        (F.col(TARGET) == 1) & F.col(EVENT).isNotNull() & (F.col(EVENT) <= as_timestamp(moment)),
        F.lit(False),
    )


def train_mask(moment, cuts: Sequence[float]) -> Column:
    """Element k is 1 if the label of delay bucket k is final at ``moment``: the conversion
    is known, or the impression is at least ``cuts[k]`` seconds old."""
    age = seconds_since(F.col(START), moment).cast("double")
    known = known_by(moment)
    return F.array(*[
        F.when(known, F.lit(1)).otherwise((age >= F.lit(float(c))).cast("int")) for c in cuts
    ])


def add_masks(df: DataFrame, train_end, cuts: Sequence[float], aux: str | None = None) -> DataFrame:
    if not cuts:
        raise ValueError("At least one bucket cut-off (seconds) is needed.")
    columns = {
        MASK_TRAIN: train_mask(train_end, cuts),
        MASK_EVAL: F.array(*[F.lit(1) for _ in cuts]),
    }
    if aux:
        columns[MASK_AUX] = F.lit(1)
    return df.withColumns(columns)


def supervised(df: DataFrame, train_end, *, any_head: bool = False) -> DataFrame:
    """Rows before ``train_end`` whose last (or, with ``any_head``, any) label is final."""
    mature = any_one(F.col(MASK_TRAIN)) if any_head else last_element(F.col(MASK_TRAIN)) == 1
    return df.filter((F.col(START) < as_timestamp(train_end)) & mature)


def mask_counts(train_end) -> list[Column]:
    """Row, conversion, train, immature-train and test counts, as one set of aggregates."""
    before = F.col(START) < as_timestamp(train_end)
    immature = before & ~all_ones(F.col(MASK_TRAIN))
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(TARGET).cast("long").alias("n_conversions"),
        F.count_if(before).alias("n_train"),
        F.count_if(immature).alias("n_immature"),
        F.count_if(~before).alias("n_test"),
    ]


def mask_stats(df: DataFrame, train_end, group: Sequence[str] = ()) -> DataFrame:
    """Mask statistics in one pass; the share of immature training rows is in percent."""
    counted = df.groupBy(*group).agg(*mask_counts(train_end))
    return counted.withColumn(
        "pct_immature", F.when(F.col("n_train") > 0, F.col("n_immature") / F.col("n_train") * 100)
    )
