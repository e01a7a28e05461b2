"""Numeric feature scaling, fitted on training rows and applied to every split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clipped_log1p


@dataclass(frozen=True)
class Scale:
    """Transform kind, mean and population deviation of one column."""

    kind: str
    mean: float
    deviation: float


def _transformed(column: str, kind: str) -> Column:
    return F.ln(F.col(column).cast("double")) if kind == "log" else clipped_log1p(F.col(column))


def numeric_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum of the raw values and mean / deviation of both transforms, per column.

    All columns are aggregated in one pass; the ``log`` statistics are only meaningful where
    the minimum is positive.
    """
    positive = {c: F.when(F.col(c) > 0, F.ln(F.col(c).cast("double"))) for c in columns}
    wide = train.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.min(c).cast("double").alias("minimum"),
            F.avg(clipped_log1p(F.col(c))).alias("log1p_mean"),
            F.stddev_pop(clipped_log1p(F.col(c))).alias("log1p_sd"),
            F.avg(positive[c]).alias("log_mean"),
            F.stddev_pop(positive[c]).alias("log_sd"),
        ).alias(c)
        for c in columns
    ])
    return wide.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def fit_scales(train: DataFrame, columns: Sequence[str], *, kind: str = "log1p") -> dict[str, Scale]:
    """``kind`` is "log1p" for every column, or "auto": log where the training minimum is
    positive.  No values: mean 0; no spread: deviation 1."""
    scales = {}
    if not columns:
        return scales
    for row in numeric_stats(train, columns).collect():
        use_log = kind == "auto" and row["minimum"] is not None and row["minimum"] > 0
        prefix = "log" if use_log else "log1p"
        mean, sd = row[f"{prefix}_mean"], row[f"{prefix}_sd"]
        scales[row["column"]] = Scale(prefix, mean if mean is not None else 0.0, sd or 1.0)
    return scales


def scaled(column: str, scale: Scale) -> Column:
    """Standardised value; missing (or outside the logarithm's domain) becomes 0."""
    value = (_transformed(column, scale.kind) - F.lit(scale.mean)) / F.lit(scale.deviation)
    return F.coalesce(value, F.lit(0.0))


def add_scaled(df: DataFrame, scales: dict[str, Scale], *, suffix: str = "_z") -> DataFrame:
    """Add ``{column}_z`` and the missing flag ``{column}_miss``."""
    columns = {}
    for c, scale in scales.items():
        columns[f"{c}{suffix}"] = scaled(c, scale)
        columns[f"{c}_miss"] = F.col(c).isNull().cast("int")
    return df.withColumns(columns)


def organic_share(train: DataFrame, *, target: str = "conversion", aux: str = "click") -> DataFrame:
    """Share of converters without a click; 0 if there are no converters."""
    share = F.avg(F.when(F.col(target) == 1, (F.col(aux) == 0).cast("double")))
    return train.agg(F.coalesce(share, F.lit(0.0)).alias("organic_share"))
