"""Global order without a global task: prefix sums, exact quantiles, exact top-k.

An ordered window without partitions sends every row to one task.  These operators range-partition
the ordered domain, whatever its type, work inside the pieces, and add the accumulated totals of the
pieces, of which there are few.  A piece that turned out too large is cut again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bround_share
from ..session import SMALL_ROWS, small_side, store

PIECE = "_piece"
#: Smaller pieces than this share a task.
PART_ROWS = 250_000
FRAME = (Window.unboundedPreceding, -1)


def _groups(by: Sequence[str]) -> list:
    return list(by) or [F.lit(1)]


def range_pieces(df: DataFrame, by: Sequence[str], order: Sequence[Column], aggregates: Sequence[Column], n_rows: int,
                 max_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """``df`` with its ``_piece``, ``aggregates`` per group and piece, and the number of those.

    A piece is a path: its place in the first cut, then in a second one where it had more than
    ``max_rows`` rows, and so on; paths compare as their pieces do.  Rows must differ in group or
    order.  Both tables are stored, so the piece of a row is fixed.
    """
    spark = df.sparkSession

    def cut_up(rows, n_pieces, path):
        ranged = rows.repartitionByRange(n_pieces, *([path] if path is not None else []), *[F.col(c) for c in by], *order)
        own = F.array(F.spark_partition_id())
        return ranged.withColumn(PIECE, own if path is None else F.concat(PIECE, own))

    def totals_of(ranged):
        totals = store(ranged.groupBy(*by, PIECE).agg(*aggregates, F.count(F.lit(1)).alias("_rows")))
        return totals, totals.agg(F.count(F.lit(1)).alias("n"), F.max("_rows").alias("largest")).first()

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = cut_up(df, max(least, -(-2 * n_rows // max(max_rows, PART_ROWS))), None)
    if max_rows < PART_ROWS:  # many small pieces of a range, rather than as many tasks
        place = F.row_number().over(Window.partitionBy(PIECE).orderBy(*[F.col(c) for c in by], *order)) - 1
        first = first.withColumn("_place", place).withColumn(
            PIECE, F.concat(PIECE, F.array(F.floor(F.col("_place") / max_rows).cast("int")))).drop("_place")
    ranged = store(first)
    totals, told = totals_of(ranged)
    while (told["largest"] or 0) > max_rows:
        large = totals.groupBy(PIECE).agg(F.sum("_rows").alias("_rows")).where(F.col("_rows") > max_rows)
        n_large, n_held = large.agg(F.count(F.lit(1)), F.sum("_rows")).first()
        marked = small_side(large.select(PIECE), n_large)
        again = cut_up(ranged.join(marked, PIECE, "left_semi"), 2 * n_large + -(-4 * n_held // max_rows), F.col(PIECE))
        before = told["largest"]
        ranged = store(ranged.join(marked, PIECE, "left_anti").unionByName(again))
        totals, told = totals_of(ranged)
        if told["largest"] >= before:
            raise ValueError("Rows that are equal in group and order cannot be cut into pieces.")
    return ranged, totals, told["n"]


def prefix_sums(
    df: DataFrame,
    column: str | Sequence[str],
    measures: Sequence[str],
    *,
    by: Sequence[str] = (),
    descending: bool = False,
    max_rows: int = SMALL_ROWS,
    totals: bool = False,
    uncounted: bool = False,
) -> DataFrame:
    """Exclusive prefix sums ``{measure}_before`` in the order of ``column`` (or several), and with
    ``totals`` the group's ``{measure}_total``.

    Any orderable type will do; values are unique within ``by``: callers aggregate to distinct
    values first, which also folds any heavily repeated value into one row.  Up to ``max_rows``
    rows a window per group is enough; ``uncounted`` goes for pieces at once, which saves rows that
    are not stored from being computed twice.
    """
    columns = [column] if isinstance(column, str) else list(column)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in columns]
    n_rows = 0 if uncounted else df.count()
    if n_rows <= max_rows and not uncounted:
        whole = Window.partitionBy(*_groups(by))
        window = whole.orderBy(*order).rowsBetween(*FRAME)
        out = df.withColumns({f"{m}_before": F.coalesce(F.sum(m).over(window), F.lit(0)) for m in measures})
        return out.withColumns({f"{m}_total": F.sum(m).over(whole) for m in measures}) if totals else out

    ranged, per_piece, n_totals = range_pieces(
        df, by, order, [F.sum(m).alias(m) for m in measures], n_rows, max_rows)
    whole = Window.partitionBy(*_groups(by))
    earlier = whole.orderBy(PIECE).rowsBetween(*FRAME)
    carried = per_piece.select(
        *[F.col(c).alias(f"_side_{c}") for c in (*by, PIECE)],
        *[F.sum(m).over(earlier).alias(f"_carry_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures if totals])
    inside = Window.partitionBy(*by, PIECE).orderBy(*order).rowsBetween(*FRAME)
    local = ranged.withColumns({f"{m}_before": F.sum(m).over(inside) for m in measures})
    same = [F.col(c).eqNullSafe(F.col(f"_side_{c}")) for c in (*by, PIECE)]
    joined = local.join(small_side(carried, n_totals), same, "left")
    before = {f"{m}_before": F.coalesce(f"{m}_before", F.lit(0)) + F.coalesce(f"_carry_{m}", F.lit(0)) for m in measures}
    return joined.withColumns(before).select(
        *df.columns, *before, *[f"{m}_total" for m in measures if totals])


def score_table(
    predictions: DataFrame, *, by: Sequence[str] = (), max_rows: int = SMALL_ROWS,
    score: str = "p", label: str = "y", descending: bool = True,
) -> DataFrame:
    """Distinct scores with row and positive counts, their prefix sums and group totals.

    Equal scores are combined map-side, so a score shared by a third of the rows is one
    row per task.
    """
    groups = list(by)
    distinct = store(predictions.groupBy(*groups, F.col(score).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    ))
    return prefix_sums(distinct, "p", ["n", "pos"], by=groups, descending=descending, max_rows=max_rows, totals=True)


def exact_quantiles(
    predictions: DataFrame, shares: Sequence[float], *, by: Sequence[str] = (),
    score: str = "p", label: str = "y", max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Linear-interpolation quantiles (one array column ``quantiles``) per group.

    The two neighbouring order statistics of each share are found in the ascending score
    table, so no task holds all values of a group (as ``percentile`` would).
    """
    groups = list(by)
    table = score_table(predictions, by=groups, score=score, label=label,
                        descending=False, max_rows=max_rows)
    points = F.array(*[
        F.struct(F.lit(i).alias("i"), ((F.col("n_total") - 1) * F.lit(float(s))).alias("at"))
        for i, s in enumerate(shares)
    ])
    first, after = F.col("n_before"), F.col("n_before") + F.col("n")

    def holds(position):
        return (position >= first) & (position < after)

    hits = (
        table.withColumn("_points", F.filter(
            points, lambda s: holds(F.floor(s["at"])) | holds(F.ceil(s["at"]))))
        .filter(F.size("_points") > 0)
        .withColumn("_point", F.explode("_points"))
    )
    at = F.col("_point.at")
    per_share = hits.groupBy(*groups, F.col("_point.i").alias("i")).agg(
        F.max(at).alias("at"),
        F.max(F.when(holds(F.floor(at)), F.col("p"))).alias("low"),
        F.max(F.when(holds(F.ceil(at)), F.col("p"))).alias("high"),
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    ordered = F.array_sort(F.collect_list(F.struct("i", value.alias("value"))))
    return per_share.groupBy(*groups).agg(
        F.transform(ordered, lambda s: s["value"]).alias("quantiles"))


def share_edges(shares: Sequence[float]) -> list[Column]:
    """Aggregates over the descending score table: per share, the score where the cut falls."""
    found = []
    for share in shares:
        k = bround_share(share, F.col("n_total"))
        here = (k > F.col("n_before")) & (k <= F.col("n_before") + F.col("n"))
        found.append(F.max(F.when(here, F.struct(
            F.lit(int(round(share * 100))).alias("share"), k.alias("k"), "p", "n", "pos",
            (k - F.col("n_before")).alias("take"), "pos_before", "n_total", "pos_total",
        ))))
    return found


def top_share_hits(
    predictions: DataFrame, edges: DataFrame, *, by: Sequence[str] = (),
) -> DataFrame:
    """Rows ``k`` and positives ``tp`` among the best-scored shares of each group.

    ``edges`` (materialised) has an array ``edges`` of ``share_edges`` per group.  Scores above the cutting
    score count whole.  Only the rows tied at it are ranked, by the md5 of their id: tied
    rows are counted per two leading bytes, and row-level ranking is left to the single
    prefix where the cut falls.
    """
    groups = list(by)
    edge = edges.select(*groups, F.explode("edges").alias("e")).select(*groups, "e.*")
    n_edges = edge.count()  # groups x shares
    partial = edge.filter(F.col("take") < F.col("n")).select(*groups, "p", "share", "take")
    digest = F.md5(F.col("impression_id").cast("string"))
    tied = (
        predictions.withColumnRenamed("y", "_y").join(small_side(partial, n_edges), [*groups, "p"])
        .select(*groups, "share", "take", "_y", digest.alias("digest"))
        .withColumn("head", F.substring("digest", 1, 4))
    )
    keys = [*groups, "share"]
    heads = tied.groupBy(*keys, "take", "head").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    over_heads = Window.partitionBy(*keys).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumns({
        "n_before": F.coalesce(F.sum("n").over(over_heads), F.lit(0)),
        "pos_before": F.coalesce(F.sum("pos").over(over_heads), F.lit(0)),
    }).filter((F.col("take") > F.col("n_before")) & (F.col("take") <= F.col("n_before") + F.col("n")))
    cut_heads = heads.select(*keys, "head", "pos_before", (F.col("take") - F.col("n_before")).alias("rest"))
    ranked = tied.join(small_side(cut_heads, n_edges), [*keys, "head"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy("digest")))
    tied_hits = ranked.groupBy(*keys).agg(
        (F.max("pos_before") + F.sum(F.when(F.col("rank") <= F.col("rest"), F.col("_y")).otherwise(0)))
        .alias("tied_hits"))
    return (
        edge.join(small_side(tied_hits, n_edges), keys, "left")
        .withColumn("tp", F.col("pos_before") + F.coalesce("tied_hits", "pos"))
        .select(*keys, "k", "tp", "n_total", "pos_total")
    )
