"""Feature encoders fitted on training rows: dense columns for networks and boosted trees,
one-hot vectors for the linear and forest models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import numerics, vocabulary
from ..session import cut

# The coefficients of a linear model and the statistics of a forest's nodes travel whole; the width
# of one-hot features is checked before fitting.  Networks have no such limit.
MAX_WIDTH = 5_000_000


def check_width(sizes: dict[str, int], what: str = "category values") -> None:
    total = sum(sizes.values())
    if total > MAX_WIDTH:
        raise ValueError(f"{total} {what} make the model larger than the limit of {MAX_WIDTH}: {sizes}")


@dataclass(frozen=True)
class DenseEncoder:
    """Category indexes and scaled numerics as plain columns."""

    categorical: tuple[str, ...]
    index: DataFrame | None
    sizes: tuple[int, ...]
    scales: dict[str, numerics.Scale]
    unseen: str

    @property
    def index_columns(self) -> list[str]:
        return [f"{c}_idx" for c in self.categorical]

    @property
    def numeric_columns(self) -> list[str]:
        return [f"{c}_{s}" for c in self.scales for s in ("z", "miss")]

    @property
    def columns(self) -> list[str]:
        return self.index_columns + self.numeric_columns

    def apply(self, df: DataFrame) -> DataFrame:
        if self.categorical:
            df = vocabulary.encode_categories(
                df, self.index, self.categorical, unseen=self.unseen,
                counted=dict(zip(self.categorical, self.sizes)))
        return numerics.add_scaled(df, self.scales)


def fit_dense(train: DataFrame, categorical, numeric, *, unseen: str = "raise") -> DenseEncoder:
    """``unseen="raise"`` keeps a slot for the unseen marker; "zero" maps to index 0."""
    index, sizes = None, {}
    if categorical:
        index = cut(vocabulary.category_index(train, categorical, keep_unseen=unseen == "raise"))
        sizes = vocabulary.sizes(index)
    return DenseEncoder(
        tuple(categorical), index, tuple(max(1, sizes.get(c, 0)) for c in categorical),
        numerics.fit_scales(train, numeric), unseen,
    )


@dataclass(frozen=True)
class OneHotFeatures:
    """Numerics (log or log1p per column) and one-hot categories as a ``features`` vector."""

    scales: dict[str, numerics.Scale]
    pipeline: object

    def apply(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(numerics.add_scaled(df, self.scales))


def fit_one_hot(train: DataFrame, categorical, numeric) -> OneHotFeatures:
    """A category that training does not hold becomes all zeros."""
    scales = numerics.fit_scales(train, numeric, kind="auto")
    if categorical:
        check_width(vocabulary.sizes(vocabulary.vocabulary(train, categorical)))
    dense = [f"{c}_{s}" for c in numeric for s in ("z", "miss")]
    hot = [f"{c}_hot" for c in categorical]
    stages = []
    if categorical:
        codes = [f"{c}_code" for c in categorical]
        stages = [
            StringIndexer(inputCols=list(categorical), outputCols=codes, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True),
        ]
    stages.append(VectorAssembler(inputCols=hot + dense, outputCol="features"))
    fitted = Pipeline(stages=stages).fit(numerics.add_scaled(train, scales))
    return OneHotFeatures(scales, fitted)


#: Categories of a column that a tree tells apart; a column with more is hashed into as many.
MOST_CATEGORIES = 256


def dense_vector(df: DataFrame, columns: list[str], output: str = "features", nominal: dict[str, int] | None = None) -> DataFrame:
    """``columns`` as one vector.  ``nominal`` names index columns and their numbers of values: trees then split
    those by sets of values, not by the order of the numbers."""
    def cell(column: str):
        n = (nominal or {}).get(column)
        if n is None:
            return F.col(column).cast("double")
        place = F.col(column) if n <= MOST_CATEGORIES else F.pmod(F.xxhash64(column), F.lit(MOST_CATEGORIES))
        marks = {"ml_attr": {"type": "nominal", "name": column, "num_vals": max(2, min(n, MOST_CATEGORIES))}}
        return place.cast("double").alias(column, metadata=marks)

    others = [F.col(c) for c in df.columns if c not in columns]
    return VectorAssembler(inputCols=columns, outputCol=output).transform(
        df.select(*others, *[cell(c).alias(c) if (nominal or {}).get(c) is None else cell(c) for c in columns]))
