"""Queries of the operators over the given tables, and the SQL twins of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    importance, jaccard, lengths, masked_lm, mixing, neighbours, packing, phrases, quality, spelling, suffixes,
    token_files, toxicity,
)
from .oracles import ORACLES

BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_masked_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = masked_lm.score(table(spark, sf_dir, "documents"))
    return scored.select(F.col("id").alias("doc_id"), "n_words", "log_prob",
                         (F.col("log_prob") / F.greatest("n_words", F.lit(1))).alias("log_prob_per_word"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, cuts = mixing.fit_mix(table(spark, sf_dir, "documents"))
    return mixing.apply_mix(sized, cuts).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link_documents(table(spark, sf_dir, "documents"))
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.read_ids(token_files.write_ids(table(spark, sf_dir, "documents")))
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE_COUNTS, "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = phrases.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limit_totals(lengths.length_histogram(table(spark, sf_dir, "documents")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.cut_recurring(table(spark, sf_dir, "documents"))
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op11_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def held_out(column: str):
        return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))

    scored = toxicity.score(docs, toxicity.fit(docs, labels, ~held_out("id")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries():
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql():
    return dict(ORACLES)
