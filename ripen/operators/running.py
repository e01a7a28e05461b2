"""Running aggregates per key that survive a key holding a third of all rows.

A plain window puts all rows of a key into one task.  Here the rows of keys with more than
``max_rows`` rows are cut into ranges of their order, of at most ``max_rows`` rows each, also
where they share a moment; windows run inside (key, slice), and the slice totals, one row per
hot key and slice, are accumulated and added back.  Sum, minimum and maximum combine exactly, so
the result equals the plain window's.  Neither keys nor slices are collected, and no number of
hot keys is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small_side
from .ranking import PIECE, range_pieces


@dataclass(frozen=True)
class Measure:
    """``how`` (sum, min or max) of ``column`` over the rows before the current one.

    ``descending`` reads the order backwards; ``inclusive`` adds the current row.
    """

    name: str
    column: str
    how: str
    descending: bool = False
    inclusive: bool = False


@dataclass(frozen=True)
class HotKeys:
    """``places``: the hot keys, one column; None if there are none.  ``n``: their number; ``n_rows``: their
    rows; ``max_rows``: what a slice may hold."""

    places: DataFrame | None
    n: int = 0
    n_rows: int = 0
    max_rows: int = 0


def find_hot_keys(df: DataFrame, key: str, max_rows: int = 5_000_000) -> HotKeys:
    """The keys to slice: one aggregate with a partial count per key and task."""
    counts = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_rows))
    n, n_rows = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    return HotKeys(counts.select(key) if n else None, n, n_rows or 0, max_rows)


_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def slices(rows: DataFrame, key: str, order: list[str], measures: list[Measure], hot: HotKeys) -> tuple[DataFrame, DataFrame, int]:
    """The rows of hot keys with their slice, totals of the measures per key and slice, and the number of those."""
    return range_pieces(rows, [key], [F.col(c).asc() for c in order], [_AGGREGATE[m.how](m.column).alias(m.name) for m in measures],
                        hot.n_rows, hot.max_rows)


def _combine(how: str, left: Column, right: Column) -> Column:
    if how == "sum":
        return F.when(left.isNull() & right.isNull(), None).otherwise(
            F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
        )
    return F.greatest(left, right) if how == "max" else F.least(left, right)


def _window(keys: list[str], order: list[str], descending: bool, inclusive: bool):
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    end = Window.currentRow if inclusive else -1
    return Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, end)


def running_by_key(
    df: DataFrame,
    key: str,
    order: list[str],
    measures: list[Measure],
    *,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add every measure as a column.  ``order`` must be total within the key."""
    if hot is None or hot.places is None:
        return df.withColumns({
            m.name: _AGGREGATE[m.how](m.column).over(_window([key], order, m.descending, m.inclusive))
            for m in measures
        })

    places = small_side(hot.places.select(F.col(key).alias("_hot_key")), hot.n)
    is_hot = F.col(key).eqNullSafe(F.col("_hot_key"))
    ranged, totals, n_totals = slices(df.join(places, is_hot, "left_semi"), key, order, measures, hot)
    carried = totals.select(
        F.col(key).alias("_side_key"), F.col(PIECE).alias("_side_piece"),
        *[_AGGREGATE[m.how](m.name).over(_window([key], [PIECE], m.descending, inclusive=False)).alias(f"_carry_{m.name}")
          for m in measures])
    # The other keys are one slice each.
    others = df.join(places, is_hot, "left_anti").withColumn(PIECE, F.array().cast("array<int>"))
    local = ranged.select(*df.columns, PIECE).union(others.select(*df.columns, PIECE)).withColumns({
        m.name: _AGGREGATE[m.how](m.column).over(_window([key, PIECE], order, m.descending, m.inclusive))
        for m in measures
    })
    same = [F.col(key).eqNullSafe(F.col("_side_key")), F.col(PIECE) == F.col("_side_piece")]
    joined = local.join(small_side(carried, n_totals), same, "left")
    return joined.withColumns({
        m.name: _combine(m.how, F.col(m.name), F.col(f"_carry_{m.name}")) for m in measures
    }).select(*df.columns, *[m.name for m in measures])
