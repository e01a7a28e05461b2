"""Table scans and sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail on the driver, before any job, when a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}; the table has {sorted(df.columns)}")
    return df


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The optional columns that the table really has, in the given order."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Map the source's own column names to the canonical ones at ingest."""
    require_columns(df, names)
    return df.withColumnsRenamed(dict(names))


def read_table(
    spark: SparkSession,
    source: str,
    *,
    fmt: str | None = None,
    required: Iterable[str] = (),
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read a catalog table, or files when ``fmt`` (parquet, orc, delta, ...) is given."""
    df = spark.read.format(fmt).load(source) if fmt else spark.table(source)
    if names:
        df = rename_columns(df, names)
    return require_columns(df, required)


def write_table(
    df: DataFrame,
    target: str,
    *,
    fmt: str = "parquet",
    time_column: str | None = None,
    as_table: bool = False,
) -> None:
    """Overwrite a table or a folder.

    With ``time_column`` the rows are laid out by day, so that every later time-window
    read prunes to the days it needs.  Delta also replaces the stored schema.
    """
    if time_column:
        df = df.withColumn("event_date", F.to_date(time_column))
    writer = df.write.format(fmt).mode("overwrite")
    if fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    if time_column:
        writer = writer.partitionBy("event_date")
    if as_table:
        writer.saveAsTable(target)
    else:
        writer.save(target)


def write_days(
    df: DataFrame, target: str, *, time_column: str, days: Iterable[dt.date] | None = None, fmt: str = "parquet",
) -> None:
    """Replace the days that ``df`` has rows of, in a folder laid out by day as ``write_table`` does.

    Other days keep their files, so readers of those are not disturbed, and a run that touches a few days
    of a large table writes those alone.  With ``days`` the rows must lie within them, and a day among
    them without rows becomes empty.
    """
    spark = df.sparkSession
    df = df.withColumn("event_date", F.to_date(time_column))
    if days is not None:
        days = sorted(set(days))
        outside = F.col("event_date").isNull() | ~F.col("event_date").isin(days)
        # Checked by the writing job itself, before anything is replaced.
        df = df.withColumn("event_date", F.when(
            outside, F.raise_error(F.concat(F.lit("A row lies outside the days: "), F.coalesce(F.col("event_date").cast("string"), F.lit("null")))).cast("date")
        ).otherwise(F.col("event_date")))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def held(day):
        folder = path(f"{target}/event_date={day}")
        return {f.getPath().getName() for f in files.listStatus(folder)} if files.exists(folder) else set()

    before = {day: held(day) for day in days or ()}
    df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").save(target)
    for day, names in before.items():
        if names and held(day) == names:  # not written anew: no rows came
            files.delete(path(f"{target}/event_date={day}"), True)
