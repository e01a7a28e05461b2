"""Prediction quality as grouped aggregates.

``predictions`` holds ``impression_id``, a 0/1 label ``y`` and a probability ``p``, plus any
grouping columns (fold, model).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip_probability, safe_ratio
from ..session import SMALL_ROWS, cut, small_side
from .ranking import exact_quantiles, score_table, share_edges, top_share_hits

SHARES = (0.05, 0.10, 0.20)
METRICS = ("nll_mean", "rce", "ap", "pr_auc", "base_rate") + tuple(
    f"{m}_{s}" for s in (5, 10, 20) for m in ("prec", "lift", "recall")
)
_ALL = "_all"


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(_ALL, F.lit(1)), [_ALL])


def nll(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = clip_probability(p, eps)
    return -(y * F.ln(q) + (F.lit(1) - y) * F.ln(F.lit(1.0) - q))


def _rce(nll_mean: Column, base_rate: Column) -> Column:
    """Gain over always predicting the base rate, in percent."""
    return (F.lit(1.0) - nll_mean / F.greatest(nll(base_rate, base_rate), F.lit(1e-15))) * 100.0


def loss_metrics(predictions: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log-likelihood and relative cross entropy (percent over the base rate)."""
    y = F.col("y").cast("double")
    sums = predictions.groupBy(*by).agg(
        F.avg(nll(y, F.col("p"))).alias("nll_mean"), F.avg(y).alias("base_rate")
    )
    return sums.withColumn("rce", _rce(F.col("nll_mean"), F.col("base_rate")))


def _curve_sums() -> list[Column]:
    """Average precision and the area under the precision-recall curve, as sums over the
    descending score table.

    Recall grows by the score's share of positives, and the previous point's precision
    follows from the prefix sums.  Without positives every recall is 1, which leaves only the
    curve's last segment.
    """
    has_positives = F.col("pos_total") > 0
    gain = F.when(has_positives, F.col("pos") / F.col("pos_total")).otherwise(F.lit(0.0))
    here = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    before = F.when(F.col("n_before") > 0, F.col("pos_before") / F.col("n_before")).otherwise(F.lit(1.0))
    area = F.when(F.max("pos_total") > 0, F.sum(gain * (here + before) / 2)).otherwise(F.lit(0.5))
    return [F.sum(gain * here).alias("ap"), area.alias("pr_auc")]


def curve_metrics(table: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(*_curve_sums())


def _wide_tops(hits: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    scored = hits.withColumns({
        "prec": F.col("tp") / F.col("k"),
        "lift": safe_ratio(F.col("tp") / F.col("k"), F.col("pos_total") / F.col("n_total")),
        "recall": safe_ratio(F.col("tp").cast("double"), F.col("pos_total")),
    })
    return scored.groupBy(*by).agg(*[
        F.max(F.when(F.col("share") == int(round(s * 100)), F.col(m))).alias(f"{m}_{int(round(s * 100))}")
        for s in shares for m in ("prec", "lift", "recall")
    ])


def top_hits(predictions: DataFrame, table: DataFrame, *, by: Sequence[str] = (),
             shares: Sequence[float] = SHARES) -> DataFrame:
    """Rows and positives among the best-scored shares, one row per group and share."""
    edges = cut(table.groupBy(*by).agg(F.array(*share_edges(shares)).alias("edges")))
    return top_share_hits(predictions, edges, by=by)


def top_metrics(predictions: DataFrame, table: DataFrame, *, by: Sequence[str] = (),
                shares: Sequence[float] = SHARES) -> DataFrame:
    """Precision, lift and recall among the best-scored shares, one row per group."""
    return _wide_tops(top_hits(predictions, table, by=by, shares=shares), by, shares)


def evaluate(predictions: DataFrame, *, by: Sequence[str] = (), max_rows: int = SMALL_ROWS) -> DataFrame:
    """Every metric as one row per group.

    Loss, curves and the places where the top shares end come out of one pass over the
    distinct scores; the predictions are read again only for ties at those places.
    """
    rows, groups = _grouped(predictions.withColumn("p", clip_probability(F.col("p"))), by)
    table = score_table(rows, by=groups, max_rows=max_rows)
    q, pos, n = clip_probability(F.col("p")), F.col("pos"), F.col("n")
    loss = -(pos * F.ln(q) + (n - pos) * F.ln(F.lit(1.0) - q))
    # One row per group.
    sums = cut(table.groupBy(*groups).agg(
        (F.sum(loss) / F.sum("n")).alias("nll_mean"), (F.sum("pos") / F.sum("n")).alias("base_rate"),
        *_curve_sums(), F.array(*share_edges(SHARES)).alias("edges"),
    ))
    tops = _wide_tops(top_share_hits(rows, sums, by=groups), groups, SHARES)
    result = sums.withColumn("rce", _rce(F.col("nll_mean"), F.col("base_rate"))).join(
        small_side(tops, sums.count()), groups)
    return result.select(*by, *METRICS)


def reliability(predictions: DataFrame, *, by: Sequence[str] = (), n_bins: int = 10,
                max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mean prediction and outcome per quantile bin (equal edges merged, right-closed)."""
    rows, groups = _grouped(predictions, by)
    shares = [i / n_bins for i in range(n_bins + 1)]
    edges = cut(exact_quantiles(rows, shares, by=groups, max_rows=max_rows).withColumn(
        "edges", F.array_distinct("quantiles")
    ).select(*groups, F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))).alias("inner")))
    # One row of at most ``n_bins`` edges per group.
    binned = rows.join(small_side(edges, edges.count()), groups).withColumn(
        "bin", F.size(F.filter("inner", lambda e: e < F.col("p")))
    )
    out = binned.groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"),
    )
    return out.select(*by, "bin", "n", "mean_p", "mean_y")


def calibration_error(predictions: DataFrame, *, by: Sequence[str] = (), n_bins: int = 10,
                      max_rows: int = SMALL_ROWS) -> DataFrame:
    """Expected calibration error over the reliability bins."""
    bins = reliability(predictions, by=by, n_bins=n_bins, max_rows=max_rows)
    return bins.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))) / F.sum("n")).alias("ece")
    )


def box_stats(predictions: DataFrame, *, label: str = "y", by: Sequence[str] = (),
              max_rows: int = SMALL_ROWS) -> DataFrame:
    """Box-plot numbers of the prediction per label value: quartiles and 1.5-IQR whiskers."""
    groups = [*by, label]
    rows = predictions.withColumn("_label", F.col(label))
    quartiles = cut(exact_quantiles(rows, (0.25, 0.5, 0.75), by=groups, label="_label",
                                    max_rows=max_rows).select(
        *groups, *[F.element_at("quantiles", i).alias(q) for i, q in ((1, "q1"), (2, "median"), (3, "q3"))]
    ))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside_low = F.when(F.col("p") >= F.col("q1") - reach, F.col("p"))
    inside_high = F.when(F.col("p") <= F.col("q3") + reach, F.col("p"))
    # One row per label value and group.
    return (
        rows.join(small_side(quartiles, quartiles.count()), groups)
        .groupBy(*groups, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.least(F.min(inside_low), F.col("q1")).alias("whisker_low"),
            F.greatest(F.max(inside_high), F.col("q3")).alias("whisker_high"),
        )
    )


def summary(predictions: DataFrame, *, by: Sequence[str] = (), raw: str | None = None) -> DataFrame:
    """Rows, positive rate and mean prediction (also before calibration, if given)."""
    columns = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("y").cast("double")).alias("positive_rate"),
        F.avg("p").alias("mean_p"),
    ]
    if raw:
        columns.append(F.avg(raw).alias("mean_p_raw"))
    return predictions.groupBy(*by).agg(*columns)


def average_folds(fold_metrics: DataFrame, metrics: Sequence[str] = METRICS, *, fold: str = "fold_id") -> DataFrame:
    """The fold rows plus one ``AVG`` row that skips NaN."""
    names = [m for m in metrics if m in fold_metrics.columns]
    means = fold_metrics.agg(*[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in names])
    text = fold_metrics.withColumn(fold, F.col(fold).cast("string")).select(fold, *names)
    return text.unionByName(means.withColumn(fold, F.lit("AVG")).select(fold, *names))


def candidate_scores(scores: DataFrame, how: str = "mean") -> DataFrame:
    """Score of each candidate over its inner folds."""
    aggregate = F.median if how == "median" else F.avg
    return scores.groupBy("candidate").agg(
        aggregate("rce").alias("score"), F.count("rce").alias("n_folds")
    ).withColumn("score", F.coalesce("score", F.lit(float("-inf"))))
