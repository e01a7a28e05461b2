"""Token counts from an exact length histogram.

Documents are aggregated by encoded length.  Prefix and suffix sums over the lengths then answer, for every
context limit at once: how many documents fit, how many tokens they have, how many tokens remain when every
document is truncated at the limit, and where quantiles lie.  The histogram has a row per length that occurs;
its sums are taken over range partitions, never in one task.

A null or empty text has the end id alone.  Repeated rows count each.  An empty table has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare_session, small_side, store
from .prefix import running_totals
from .tokens import encoder, tokenizer_path


def _lengths(path: str, end_id: int):
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [len(ids) // 4 for ids in encoder(path).encode(batch.column("text").to_pylist(), end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["length"])

    return lengths


def length_histogram(docs: DataFrame, *, path: str | None = None, end_id: int = 0, text_col: str = "text") -> DataFrame:
    """``length, n_docs``."""
    prepare_session(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_lengths(path or tokenizer_path(), end_id), "length long").groupBy("length").agg(
        F.count("*").alias("n_docs"))


def limit_totals(histogram: DataFrame) -> DataFrame:
    """For every length as context limit: n_docs of that length, docs_within and tokens_within (at most that
    long), docs_beyond (longer), truncated_tokens (total when documents are cut there)."""
    held = store(histogram.withColumn("tokens", F.col("length") * F.col("n_docs")))
    n_rows = held.count()
    whole = held.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]
    docs = running_totals(held, [], ["length"], "n_docs", n_rows).withColumnRenamed("before", "docs_before")
    both = running_totals(docs, [], ["length"], "tokens", n_rows)
    within, beyond = F.col("docs_before") + F.col("n_docs"), F.lit(whole) - F.col("docs_before") - F.col("n_docs")
    return both.select(
        "length", "n_docs", within.alias("docs_within"), (F.col("before") + F.col("tokens")).alias("tokens_within"),
        beyond.alias("docs_beyond"),
        (F.col("before") + F.col("tokens") + beyond * F.col("length")).alias("truncated_tokens"))


def quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the smallest length that at least ``share`` of the documents do not exceed."""
    wanted = totals.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    n = F.col("docs_within") + F.col("docs_beyond")
    marked = totals.select("length", F.explode(F.filter(F.lit([float(s) for s in shares]),
                                                        lambda s: F.col("docs_within") >= s * n)).alias("share"))
    found = marked.groupBy("share").agg(F.min("length").alias("length"))
    return small_side(wanted, len(shares)).join(found, "share", "left")


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """One row: ``tokens`` in all when documents are cut at ``limit``, which need not occur as a length."""
    below = totals.where(F.col("length") <= limit).agg(
        F.max(F.struct("length", "tokens_within", "docs_beyond")).alias("x"))
    first = totals.agg((F.max(F.col("docs_within") + F.col("docs_beyond"))).alias("n"))
    cut = F.coalesce(F.col("x.tokens_within") + F.col("x.docs_beyond") * limit, F.col("n") * limit, F.lit(0))
    return below.join(F.broadcast(first), F.lit(True), "left").select(cut.alias("tokens"))
