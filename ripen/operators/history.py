"""Delay, timestamps and per-user behaviour features of each impression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_seconds
from .running import HotKeys, Measure, running_by_key

NO_CONVERSION = -1


def add_delay_and_times(df: DataFrame, log_start_epoch: int) -> DataFrame:
    """Conversion delay in seconds (-1 if none) and absolute timestamps.

    ``timestamp`` and ``conversion_timestamp`` are seconds since the start of the log.
    """
    converted = F.col("conversion_timestamp") != NO_CONVERSION
    start = F.lit(int(log_start_epoch)).cast("long")
    return df.withColumns({
        "conversion_delay": F.when(
            converted, F.col("conversion_timestamp").cast("long") - F.col("timestamp").cast("long")
        ).otherwise(F.lit(NO_CONVERSION).cast("long")),
        "timestamp_dt": F.timestamp_seconds(start + F.col("timestamp")),
        "conversion_timestamp_dt": F.when(
            converted, F.timestamp_seconds(start + F.col("conversion_timestamp"))
        ),
    })


def add_user_history(df: DataFrame, *, hot: HotKeys | None = None) -> DataFrame:
    """Earlier conversions, seconds since the last impression and position in the history.

    All three share one sort and one shuffle on the user; ties in time are broken by the
    impression id so that a recomputed task gives the same answer.
    """
    ranked = df.withColumn("_one", F.lit(1))
    ranked = running_by_key(
        ranked, "uid", ["timestamp_dt", "impression_id"],
        [Measure("_conversions", "conversion", "sum"),
         Measure("_previous", "timestamp_dt", "max"),
         Measure("_position", "_one", "sum", inclusive=True)],
        hot=hot,
    )
    return ranked.withColumns({
        "n_previous_conversions": F.coalesce(F.col("_conversions"), F.lit(0)).cast("long"),
        "time_since_last_impression":
            epoch_seconds(F.col("timestamp_dt")) - epoch_seconds(F.col("_previous")),
        "impression_number": F.col("_position").cast("int"),
    }).drop("_one", "_conversions", "_previous", "_position")


def add_known_conversions(df: DataFrame, *, hot: HotKeys | None = None) -> DataFrame:
    """``n_known_conversions``: the user's conversions that had happened by this impression.

    ``n_previous_conversions`` also counts conversions of earlier impressions that
    happened later.  Here each impression adds a second row at its conversion time and a
    running sum over both kinds counts those strictly before the impression.
    """
    moments = F.array(
        F.struct(F.col("timestamp_dt").alias("moment"), F.lit(0).alias("happened")),
        F.struct(F.col("conversion_timestamp_dt").alias("moment"), F.lit(1).alias("happened")),
    )
    rows = (
        df.withColumn("_m", F.explode(moments))
        .withColumns({"_moment": F.col("_m.moment"), "_happened": F.col("_m.happened")})
        .drop("_m")
        .filter(F.col("_moment").isNotNull())
    )
    counted = running_by_key(
        rows, "uid", ["_moment", "_happened", "impression_id"],
        [Measure("_known", "_happened", "sum")], hot=hot,
    )
    return (
        counted.filter(F.col("_happened") == 0)
        .withColumn("n_known_conversions", F.coalesce(F.col("_known"), F.lit(0)).cast("long"))
        .drop("_moment", "_happened", "_known")
    )


def content_id(*columns: str):
    """A repeatable row id from the row's own key columns (a random id is re-drawn when a
    lost partition is recomputed)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
