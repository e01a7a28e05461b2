"""One label per delay bucket: risk sets, person-period rows and hazard aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip_probability, sigmoid
from .conform import HEADS, ROW_ID
from .maturity import MASK_TRAIN


def at_risk(labels: Column, n_heads: int) -> list[Column]:
    """Head k is at risk while no earlier head is positive (0/1 per head)."""
    first = F.array_position(labels, F.lit(1))
    return [((first == 0) | (first >= k)).cast("int") for k in range(1, n_heads + 1)]


def person_period(
    df: DataFrame,
    n_heads: int,
    *,
    labels: str = HEADS,
    mask: str = MASK_TRAIN,
    risk_set: bool = True,
    keep: Sequence[str] = (ROW_ID,),
) -> DataFrame:
    """One row per (impression, head) with label, maturity, risk and weight."""
    risk = at_risk(F.col(labels), n_heads)
    heads = F.array(*[
        F.struct(
            F.lit(k).alias("head"),
            F.element_at(labels, k).alias("label"),
            F.element_at(mask, k).alias("mature"),
            risk[k - 1].alias("at_risk"),
        ) for k in range(1, n_heads + 1)
    ])
    weight = F.col("mature") * F.col("at_risk") if risk_set else F.col("mature")
    return (
        df.select(*keep, F.explode(heads).alias("h")).select(*keep, "h.*").withColumn("weight", weight)
    )


def hazard_probability(logits: Sequence[Column]) -> Column:
    """Probability of any head firing: 1 minus the product of the heads' survivals."""
    survival = F.lit(1.0)
    for z in logits:
        survival = survival * (F.lit(1.0) - sigmoid(z))
    return F.lit(1.0) - survival


def click_and_convert_probability(click_logit: Column, conversion_logit: Column) -> Column:
    return sigmoid(click_logit) * sigmoid(conversion_logit)


def cross_entropy(label: Column, logit: Column) -> Column:
    """Binary cross entropy of a logit, stable for large values."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def masked_cross_entropy(label: Column, logit: Column, weight: Column) -> Column:
    """Aggregate: weighted sum over the weight, which counts at least 1."""
    return F.sum(cross_entropy(label, logit) * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def clipped_label(column: Column) -> Column:
    return F.least(F.greatest(column.cast("double"), F.lit(0.0)), F.lit(1.0))


__all__ = [
    "at_risk", "person_period", "hazard_probability", "click_and_convert_probability",
    "cross_entropy", "masked_cross_entropy", "clipped_label", "clip_probability",
]
