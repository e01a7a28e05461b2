"""Category vocabularies: unseen-value mapping and dense indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import SMALL_ROWS, cut
from .ranking import prefix_sums

UNSEEN = -1
UNSEEN_TEXT = "__MISSING__"
# A value of more rows than this share of a task is heavy: its rows, and copies of its entry, are dealt
# to ``SALTS`` tasks.  Fewer than ``MOST_HEAVY`` values can have that share, so the sketch, which
# tracks many times as many, misses none.
SALTS = 64
HEAVY_TASKS = 0.25
MOST_HEAVY = 4096
# Vocabularies up to this many values become a hash set inside the generated code.
INLINE_VALUES = 500


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def unseen_marker(df: DataFrame, column: str):
    """What stands for an unseen value: a text in a column of texts, a number otherwise."""
    return UNSEEN_TEXT if _is_text(df, column) else UNSEEN


def vocabulary(df: DataFrame, columns: Sequence[str], extra: DataFrame | None = None) -> DataFrame:
    """Distinct non-null (column, value) pairs of all columns from one scan, and those of ``extra``.

    Values are texts if any column holds texts.  The pairs are deduplicated map-side before the one
    shuffle.
    """
    kind = "string" if any(_is_text(df, c) for c in columns) else "long"
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns
    ])
    found = df.select(F.explode(pairs).alias("v")).select("v.column", "v.value")
    if extra is not None:
        found = found.union(extra.select("column", F.col("value").cast(kind)))
    return found.filter(F.col("value").isNotNull()).distinct()


def sizes(vocab: DataFrame) -> dict[str, int]:
    return {r["column"]: r["n"] for r in vocab.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def heavy_values(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Values of each column that hold a large share of a task's rows, from mergeable sketches in one aggregate."""
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(MOST_HEAVY, int(n_tasks / HEAVY_TASKS))
    told = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.expr(f"approx_top_k(`{c}`, {most}, {16 * MOST_HEAVY})").alias(f"top_{i}") for i, c in enumerate(columns)]).first()
    bound = HEAVY_TASKS * told["n"] / n_tasks
    return {c: [t["item"] for t in told[f"top_{i}"] or [] if t["item"] is not None and t["count"] > bound]
            for i, c in enumerate(columns)}


def salted_sides(df: DataFrame, column: str, entries: DataFrame, heavy: Sequence, row_key: str | None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a shuffle join with ``_salt``: heavy values alone get ``SALTS`` salts, and their entries
    as many copies.  The salt of a row is a hash of ``row_key``, or of all columns: the same whenever
    a task runs again."""
    salt = F.pmod(F.xxhash64(*([row_key] if row_key else df.columns)), F.lit(SALTS)).cast("int")
    # Null meets nothing; it is dealt out as heavy values are.
    spread = F.col(column).isNull() | (F.col(column).isin(list(heavy)) if heavy else F.lit(False))
    left = df.withColumn("_salt", F.when(spread, salt).otherwise(F.lit(0)))
    copies = F.lit(1) if not heavy else F.when(F.col("value").isin(list(heavy)), F.lit(SALTS)).otherwise(F.lit(1))
    return left, entries.withColumn("_salt_e", F.explode(F.sequence(F.lit(0), copies - 1)))


def lookup(
    df: DataFrame, column: str, entries: DataFrame, n: int, *, small: int = SMALL_ROWS, row_key: str | None = None,
    heavy: Sequence | None = None,
) -> DataFrame:
    """Left-join ``entries`` (unique ``value`` plus payload) on ``column``.

    Up to ``small`` entries (a measured number) are broadcast and ``df`` is not moved.  Beyond that
    both sides shuffle, and ``heavy`` values (found by a sketch unless given) are salted, so that one
    held by a third of the rows is spread over many tasks.
    """
    entries = entries.withColumn("value", F.col("value").cast(df.schema[column].dataType))
    if n <= small:
        return df.join(F.broadcast(entries), df[column] == F.col("value"), "left").drop("value")
    heavy = heavy_values(df, [column])[column] if heavy is None else heavy
    left, salted = salted_sides(df, column, entries, heavy, row_key)
    return left.join(
        salted, (left[column] == salted["value"]) & (F.col("_salt") == F.col("_salt_e")), "left"
    ).drop("value", "_salt", "_salt_e")


def map_unseen(
    df: DataFrame,
    train: DataFrame,
    columns: Sequence[str],
    *,
    unknown=None,
    small: int = SMALL_ROWS,
    row_key: str | None = None,
) -> DataFrame:
    """Replace values that the training rows do not hold; null counts as unseen.

    ``unknown``: the marker, by default that of the column's kind.
    """
    if not columns:
        return df
    vocab = cut(vocabulary(train, columns))
    counted = sizes(vocab)
    tiny = [c for c in columns if counted.get(c, 0) <= min(INLINE_VALUES, small)]
    inline: dict[str, list] = {c: [] for c in tiny}
    if tiny:
        for row in vocab.filter(F.col("column").isin(*tiny)).collect():
            inline[row["column"]].append(row["value"])
    order = df.columns
    large = [c for c in columns if counted.get(c, 0) > small]
    heavy = heavy_values(df, large) if large else {}
    for c in columns:
        marker = F.lit(unseen_marker(df, c) if unknown is None else unknown)
        if c in inline:
            seen = F.coalesce(F.col(c).isin(sorted(inline[c])), F.lit(False)) if inline[c] else F.lit(False)
            df = df.withColumn(c, F.when(seen, F.col(c)).otherwise(marker))
            continue
        entries = vocab.filter(F.col("column") == c).select("value", F.lit(1).alias("_seen"))
        df = lookup(df, c, entries, counted[c], small=small, row_key=row_key, heavy=heavy.get(c))
        df = df.withColumn(c, F.when(F.col("_seen") == 1, F.col(c)).otherwise(marker)).drop("_seen")
    return df.select(*order)


def _fill(df: DataFrame, column: str, keep_unseen: bool):
    """What null counts as: the unseen marker, or 0 among numbers without a slot for it."""
    return unseen_marker(df, column) if keep_unseen or _is_text(df, column) else 0


def category_index(train: DataFrame, columns: Sequence[str], *, keep_unseen: bool = True,
                   max_rows: int = SMALL_ROWS) -> DataFrame:
    """Dense index per (column, value) in ascending order of value: numbers by number, texts by code point.

    With ``keep_unseen`` the unseen marker always has a slot and null counts as unseen;
    otherwise null counts as 0 and there is no extra slot.
    """
    filled = train.select(*[
        F.coalesce(F.col(c), F.lit(_fill(train, c, keep_unseen))).alias(c) for c in columns
    ])
    extra = None
    if keep_unseen:
        extra = train.sparkSession.createDataFrame(
            [(c, str(unseen_marker(train, c))) for c in columns], "column string, value string")
    vocab = vocabulary(filled, columns, extra).withColumn("one", F.lit(1))
    # Numbers keep their order when texts stand beside them.
    numbers = [c for c in columns if not _is_text(train, c)]
    mixed = 0 < len(numbers) < len(columns)
    if mixed:
        vocab = vocab.withColumn("_number", F.when(F.col("column").isin(numbers), F.col("value")).cast("long"))
    ranked = prefix_sums(vocab, ["_number", "value"] if mixed else "value", ["one"], by=["column"],
                         max_rows=max_rows, uncounted=True)
    return ranked.select("column", "value", F.col("one_before").cast("int").alias("index"))


def encode_categories(
    df: DataFrame,
    index: DataFrame,
    columns: Sequence[str],
    *,
    unseen: str = "raise",
    counted: dict[str, int] | None = None,
    small: int = SMALL_ROWS,
    suffix: str = "_idx",
    row_key: str | None = None,
) -> DataFrame:
    """Add ``{column}_idx``.  ``unseen`` is "raise" (when the row is evaluated) or "zero".

    ``counted`` are the vocabulary sizes, if they are known already.
    """
    counted = sizes(index) if counted is None else counted
    large = [c for c in columns if counted.get(c, 0) > small]
    filled = {c: F.coalesce(F.col(c), F.lit(_fill(df, c, unseen == "raise"))).alias(c) for c in columns}
    heavy = heavy_values(df.select([filled[c] for c in large]), large) if large else {}
    for c in columns:
        df = df.withColumn("_key", filled[c])
        entries = index.filter(F.col("column") == c).select("value", F.col("index").alias("_index"))
        df = lookup(df, "_key", entries, counted.get(c, 0), small=small, row_key=row_key, heavy=heavy.get(c))
        missing = (
            F.raise_error(F.concat(F.lit(f"Unseen value in '{c}': "), F.col(c).cast("string"))).cast("int")
            if unseen == "raise" else F.lit(0)
        )
        df = df.withColumn(f"{c}{suffix}", F.coalesce(F.col("_index"), missing)).drop("_index", "_key")
    return df
