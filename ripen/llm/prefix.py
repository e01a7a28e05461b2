"""Running totals over a global order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, store

ROWS_PER_PART = 500_000


def parts_for(df: DataFrame, n_rows: int, rows_per_part: int = ROWS_PER_PART) -> int:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n_rows // rows_per_part))


def running_totals(df: DataFrame, by: list[str], order: list[str], value: str, n_rows: int) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of its group that come earlier in ``order``.

    Rows are range-partitioned by (by, order) and stored, so the partition of a row is fixed; sums of the
    partitions are accumulated per group (one row per partition and group) and added to running sums
    within partitions.  A group of any size spreads over many partitions.  Rows equal in ``order`` come
    in any order.
    """
    n_parts = parts_for(df, n_rows)
    parts = store(
        df.repartitionByRange(n_parts, *by, *order).withColumn("_part", F.spark_partition_id())
    )
    earlier = (Window.partitionBy(*by) if by else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(
        parts.groupBy("_part", *by).agg(F.sum(value).alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    )
    side = bases.select([F.col(c).alias(f"_side_{c}") for c in bases.columns])
    same = F.col("_part") == F.col("_side__part")
    for column in by:
        same = same & F.col(column).eqNullSafe(F.col(f"_side_{column}"))
    joined = parts.join(small_side(side, bases.count()), same)
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_side__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.select(*[c for c in parts.columns if c != "_part"], before.alias("before"))
