"""Mixing sources to target weights.

Every document has a hash-random key.  Sources share a budget of words by weight; a source never gives
more than ``most_repeats`` times its own words, and what it cannot give is shared again by weight.  Within
a source, documents are range-sorted by key and prefix sums of their word counts are taken across
partitions; the source is cut at exactly its budget, whole epochs first.  The document at the cut gives
the words that are left.

The cut of a source is one row (whole epochs, key, words at the cut), so applying a mix is a projection
over the documents.  Null and empty texts have size 0 and give nothing; a null source is a source.
Repeated rows of one id have one key: they are cut together.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare_session, small_side, store
from .prefix import running_totals

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(id_col: str, seed: int) -> Column:
    """60 bits of the md5 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def cyclic_weights(sources: DataFrame, cycle=(5, 2, 1)) -> DataFrame:
    """``source``, ``weight``: weights repeat over the sources by code point, null last."""
    ordered = sources.select("source", F.col("source").isNull().alias("last"), F.lit(1).alias("one"))
    placed = running_totals(ordered, [], ["last", "source"], "one", sources.count())
    weights = F.lit([float(w) for w in cycle])
    return placed.select("source", F.get(weights, (F.col("before") % len(cycle)).cast("int")).alias("weight"))


def source_targets(sources: DataFrame, budget_share: float, most_repeats: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    A level is raised until the budget is spent: a source gets ``level * weight`` or its most.  Each
    round is one aggregate; sources that reached their most stay there, as the level only rises.
    """
    spark_sources = store(sources)
    most = F.col("source_size") * F.lit(float(most_repeats))
    budget = (spark_sources.agg(F.sum("source_size")).first()[0] or 0) * budget_share
    level, full = 0.0, -1
    while True:
        at_most = F.col("weight") * F.lit(level) > most
        row = spark_sources.agg(
            F.count_if(at_most).alias("full"), F.sum(F.when(at_most, most)).alias("given"),
            F.sum(F.when(~at_most, F.col("weight"))).alias("weights"),
        ).first()
        if row["full"] == full or not row["weights"]:
            break
        full, level = row["full"], (budget - (row["given"] or 0.0)) / row["weights"]
    return spark_sources.withColumn("target", F.least(F.col("weight") * F.lit(level), most))


def fit_mix(docs: DataFrame, weights: DataFrame | None = None, *, budget_share: float = 1.5, most_repeats: float = 2.0,
            seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
            ) -> tuple[DataFrame, DataFrame]:
    """(sized documents, cuts).  ``weights`` has source, weight; cyclic 5, 2, 1 where not given.

    Cuts: source, source_size, target, epochs, cut_key (null: nothing beyond whole epochs), cut_words.
    """
    prepare_session(docs.sparkSession)
    sized = store(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"), hash_key(id_col, seed).alias("key"),
    ))
    sizes = store(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weights = cyclic_weights(sizes) if weights is None else weights.select("source", F.col("weight").cast("double"))
    weighed = sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left").select(
        "s.*", F.coalesce("w.weight", F.lit(0.0)).alias("weight"))
    targets = source_targets(weighed, budget_share, most_repeats)
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    budgets = store(
        targets.withColumn("epochs", epochs).withColumn("rest", words - F.col("epochs") * F.col("source_size"))
    )
    ranked = running_totals(sized.groupBy("source", "key").agg(F.sum("size").alias("size")),
                            ["source"], ["key"], "size", sized.count())
    side = budgets.select(F.col("source").alias("of"), "rest")
    at_cut = ranked.join(small_side(side, budgets.count()), F.col("source").eqNullSafe(F.col("of"))).where(
        "before <= rest and rest < before + size").select(F.col("of").alias("source"), F.col("key").alias("cut_key"),
                                                          (F.col("rest") - F.col("before")).alias("cut_words"))
    cuts = store(
        budgets.alias("b").join(at_cut.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")), "left")
        .select("b.source", "source_size", "target", "epochs", "cut_key", "cut_words")
    )
    return sized, cuts


def apply_mix(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (with source, size, key) plus source_size, target and ``taken`` words, repeats counted."""
    side = small_side(cuts.withColumnRenamed("source", "of"), cuts.count())
    rest = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(
        F.col("key") == F.col("cut_key"), F.least("size", "cut_words")).otherwise(F.lit(0))
    return rows.join(side, F.col("source").eqNullSafe(F.col("of"))).select(
        *rows.columns, "source_size", "target", (F.col("epochs") * F.col("size") + rest).alias("taken"))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, seed: int = 17, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents, with the given columns: a row for each repeat, and for the document at the
    cut one row with its first words, joined by blanks."""
    _, cuts = fit_mix(docs, weights, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    rows = docs.select(
        F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"), hash_key(id_col, seed).alias("key"),
    )
    rest = F.col("taken") % F.greatest("size", F.lit(1))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")),
                      F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    text = F.col(f"row.{text_col}")
    head = F.array_join(F.slice(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), 1, F.col("words").cast("int")), " ")
    repeated = apply_mix(rows, cuts).select("row", F.explode(copies).alias("words"))
    new_text = F.when(F.col("words") < 0, text).otherwise(head)
    return repeated.select(*[new_text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
