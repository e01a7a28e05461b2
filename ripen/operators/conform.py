"""Conform a preprocessed table to the modelling schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import zeros
from ..sources.tables import present, require_columns
from .delays import read_cuts

TARGET = "conversion"
START = "timestamp_dt"
EVENT = "conversion_timestamp_dt"
ROW_ID = "impression_id"
HEADS = "bucket_vec"
DAY_COLUMN = "event_date"

# The column roles of the impression log.
CATEGORICAL = ("campaign", *(f"cat{i}" for i in range(1, 10)))
NUMERIC = (
    "time_since_last_impression",
    "time_since_last_click",
    "n_previous_conversions",
    "impression_number",
)


@dataclass(frozen=True)
class Conformed:
    """The typed table, its horizon and cut-offs, and the feature columns it really has."""

    rows: DataFrame
    horizon: float
    cuts: tuple[float, ...]
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]


def _category(df: DataFrame, column: str, is_text: bool) -> Column:
    kind, missing = ("string", "") if is_text else ("int", 0)
    return F.coalesce(F.col(column).cast(kind), F.lit(missing)).alias(column)


def conform(
    df: DataFrame,
    *,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    aux: str | None = "click",
    n_buckets: int = 4,
    heads: Sequence[str] = (HEADS,),
    texts: Sequence[str] = (),
) -> Conformed:
    """Required columns are checked, optional features intersected with the schema; casts
    and null handling (category -> 0, head vector -> zeros, numerics stay null) are one
    projection, so unused columns never leave the scan.  Categories named in ``texts`` stay
    texts, null as an empty one."""
    needed = [TARGET, START, ROW_ID, EVENT, *heads] + ([aux] if aux else [])
    require_columns(df, needed)
    cats, nums = present(df, categorical), present(df, numeric)
    cuts = read_cuts(df, n_buckets)
    columns = [
        F.col(TARGET).cast("int").alias(TARGET),
        F.col(START).cast("timestamp").alias(START),
        F.col(ROW_ID),
        F.col(EVENT).cast("timestamp").alias(EVENT),
    ]
    if aux:
        columns.append(F.col(aux).cast("int").alias(aux))
    columns += [_category(df, c, c in texts) for c in cats]
    columns += [F.col(c).cast("double").alias(c) for c in nums]
    columns += [F.coalesce(F.col(h), zeros(n_buckets)).alias(h) for h in heads]
    if DAY_COLUMN in df.columns:  # not a feature: it prunes files of a table laid out by day
        columns.append(F.col(DAY_COLUMN))
    return Conformed(df.select(*columns), cuts[-1], cuts, tuple(cats), tuple(nums))
