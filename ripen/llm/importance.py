"""Importance resampling towards a target distribution: array-scored weights, exact draw by weighted medians.

A text's features are its runs of one to ``width`` consecutive words, hashed to buckets by CRC-32.  One pass over
the corpus and one over the target count the buckets; a bucket's gain is the rounded-down log-ratio of its smoothed
shares.  A second pass over the corpus turns every text into an array of buckets and its weight into the
rounded-down mean of their gains.  A Gumbel number from the document's id is added, and the largest scores are
drawn, which is sampling without replacement by weight.

The cutoff among all scores is found without a global sort.  Tasks sort the keys of their rows once, into blocks
of at most a million.  Each round every block tells how many of its keys lie on either side of a pivot and the
medians of both sides; the next pivot is the median of the medians on the side that holds the cutoff, weighted
by the keys they stand for, so that a quarter of the remaining keys at least is discarded.  The driver gets one row
per block.  Blocks are written anew once little of them is left.  Only the winners are sorted, over range partitions.

A null text has no words; a text without words has weight 0.  A null id stands for an empty string in the draw and
comes last among ties.  Repeated rows each take part; rows equal in score and id are interchangeable.  An empty table
has no rows; a share that rounds to no row draws none.  Very long texts are arrays of eight bytes a feature in one
task at a time.  Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare_session, store
from .prefix import running_totals

BLOCK_KEYS = 1_000_000
#: Blocks are written anew when less than this share of their keys is left.
REWRITE_BELOW = 0.25
TEXT_BYTES_AT_ONCE = 4_000_000
BLOCK = "n long, scores binary, ids binary"
#: Place of null ids, beyond every other.
NO_ID = 2**63 - 1

#: ASCII letters are lower-cased, digits and bytes of other characters stay, all else separates words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    width: int = 2
    buckets: int = 10_000
    scale: int = 1_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def _features(words: list[bytes], width: int) -> list[int]:
    """CRC-32 of every run of 1 to ``width`` words joined by blanks."""
    last = list(map(crc32, words))
    out, spaced = list(last), [b" " + w for w in words]
    for n in range(1, width):
        last = list(map(crc32, spaced[n:], last))
        out += last
    return out


def _arrays(batch: pa.RecordBatch, settings: Settings):
    """Slices of a batch: first row, buckets of all its features in turn, features and words of each text."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    first = 0
    while first < len(texts):
        features, n_features, n_words, size, at = [], [], [], 0, first
        while at < len(texts) and size < TEXT_BYTES_AT_ONCE:
            words = (texts[at] or b"").translate(_WORD_BYTES).split()
            own = _features(words, settings.width)
            features += own
            n_features.append(len(own))
            n_words.append(len(words))
            size += len(texts[at] or b"")
            at += 1
        yield first, np.array(features, np.int64) % settings.buckets, np.array(n_features, np.int64), np.array(n_words, np.int64)
        first = at


def bucket_counts(texts: DataFrame, settings: Settings = Settings(), *, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket; each task adds its own up first."""
    prepare_session(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for _, buckets, _, _ in _arrays(batch, settings):
                total += np.bincount(buckets, minlength=settings.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(settings.buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """Gain of each bucket: rounded-down, scaled log-ratio of its smoothed shares in target and corpus."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = ((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(settings.scale * np.log(ratio)).astype(np.int64)


def gumbel(id_col: str, settings: Settings) -> Column:
    """Rounded-down Gumbel number of an id, from the first 32 bits of a SHA-256."""
    key = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-settings.scale * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, settings: Settings = Settings(), *, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight, score`` of every row."""
    prepare_session(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buckets, n, n_words in _arrays(batch, settings):
                sums = np.concatenate(([0], np.cumsum(gain[buckets])))
                ends = np.cumsum(n)
                weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(n)), pa.array(n_words), pa.array(n), pa.array(weight)],
                    names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    weights = rows.mapInArrow(scored, "id long, n_words long, n_features long, weight long")
    return weights.withColumn("score", F.col("weight") + gumbel("id", settings))


def _place(block: tuple[np.ndarray, np.ndarray], pivot: tuple[int, int]) -> tuple[int, int]:
    """Where keys equal to ``pivot`` start and end in a block sorted by falling score and rising id."""
    down, ids = block
    lo, hi = np.searchsorted(down, -pivot[0], "left"), np.searchsorted(down, -pivot[0], "right")
    return lo + np.searchsorted(ids[lo:hi], pivot[1], "left"), lo + np.searchsorted(ids[lo:hi], pivot[1], "right")


def _within(block, after, until) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a block that come behind ``after`` and before ``until``."""
    start = _place(block, after)[1] if after else 0
    end = _place(block, until)[0] if until else len(block[0])
    return block[0][start:end], block[1][start:end]


def _read(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for scores, ids in zip(batch.column("scores").to_pylist(), batch.column("ids").to_pylist()):
            yield -np.frombuffer(scores, np.int64), np.frombuffer(ids, np.int64)


def _blocks(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([len(d) for d, _ in parts], pa.int64()), pa.array([(-d).tobytes() for d, _ in parts], pa.binary()),
         pa.array([i.tobytes() for _, i in parts], pa.binary())], names=["n", "scores", "ids"])


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def block():
        down, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, down))
        return _blocks([(down[order], ids[order])])

    for batch in batches:
        held.append((-batch.column("score").to_numpy(), batch.column("id").to_numpy()))
        size += batch.num_rows
        if size >= BLOCK_KEYS:
            yield block()
            held, size = [], 0
    if size:
        yield block()


SIDES = "n_first long, score_first long, id_first long, n_same long, n_last long, score_last long, id_last long"


def _sides(pivot, after, until):
    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for block in _read(batches):
            down, ids = _within(block, after, until)
            lo, hi = _place((down, ids), pivot)
            row = [lo, None, None, hi - lo, len(ids) - hi, None, None]
            if lo:
                row[1:3] = -down[lo // 2], ids[lo // 2]
            if hi < len(ids):
                middle = (hi + len(ids)) // 2
                row[5:7] = -down[middle], ids[middle]
            rows.append(row)
        columns = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in columns],
                                         names=[c.split()[0] for c in SIDES.split(", ")])

    return sides


def _weighted_median(medians: list[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    """The key with at least half of the weight up to it and half from it on, best key first."""
    medians.sort(key=lambda m: (-m[0][0], m[0][1]))
    half, passed = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        passed += n
        if passed >= half:
            return key
    return medians[-1][0]


def cutoff(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """The ``k``-th key (score, id) of ``keys`` by falling score, then rising id; None if there are not so many."""
    blocks = store(keys.select("score", F.coalesce("id", F.lit(NO_ID)).alias("id")).mapInArrow(_sorted_blocks, BLOCK))
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not 0 < k <= total:
        return None
    after = until = None  # the sought key lies strictly between these
    held, left, passed = total, total, 0
    # Before the first round no side is chosen: a pivot ahead of all keys leaves the medians of whole blocks.
    told = blocks.mapInArrow(_sides((2**63 - 1, -(2**63)), None, None), SIDES).collect()
    medians = [((r["score_last"], r["id_last"]), r["n_last"]) for r in told if r["n_last"]]
    while True:
        pivot = _weighted_median(medians)
        told = blocks.mapInArrow(_sides(pivot, after, until), SIDES).collect()
        first, same, last = (sum(r[c] for r in told) for c in ("n_first", "n_same", "n_last"))
        if passed + first < k <= passed + first + same:
            return pivot
        if k <= passed + first:
            until, left = pivot, first
            medians = [((r["score_first"], r["id_first"]), r["n_first"]) for r in told if r["n_first"]]
        else:
            after, left, passed = pivot, last, passed + first + same
            medians = [((r["score_last"], r["id_last"]), r["n_last"]) for r in told if r["n_last"]]
        if left < REWRITE_BELOW * held:
            def narrowed(batches, after=after, until=until):
                parts = [p for p in (_within(b, after, until) for b in _read(batches)) if len(p[0])]
                yield _blocks(parts)

            blocks, held = store(blocks.mapInArrow(narrowed, BLOCK)), left


def draw(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the drawn share of the rows with enough words, null for the others."""
    able = F.col("n_words") >= settings.least_words
    k = settings.percent * scored.where(able).count() // 100
    last = cutoff(scored.where(able), k)
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    place = F.coalesce("id", F.lit(NO_ID))
    wins = able & ((F.col("score") > last[0]) | (F.col("score") == last[0]) & (place <= last[1]))
    winners = scored.where(wins).withColumn("_down", -F.col("score")).withColumn("_place", place).withColumn("_one", F.lit(1))
    ranked = running_totals(winners, [], ["_down", "_place"], "_one", k)
    # Rows equal to the last key may be more than are left to draw.
    rank = F.when(F.col("before") < k, F.col("before") + 1).cast("long")
    return ranked.select(*scored.columns, rank.alias("rank")).union(
        scored.where(~F.coalesce(wins, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` of every row of ``docs``, drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs, settings, text_col=text_col), bucket_counts(target, settings, text_col=text_col), settings)
    return draw(store(weigh(docs, gain, settings, id_col=id_col, text_col=text_col)), settings)


def drawn_documents(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The drawn documents with their columns.  Ids are meant to be unique and not null: rows of an id that was
    drawn stay."""
    ids = resample(docs, target, settings, id_col=id_col, text_col=text_col).where("rank IS NOT NULL").select(
        F.col("id").alias("_drawn")).distinct()
    return docs.join(ids, docs[id_col].cast("long") == F.col("_drawn"), "left_semi")
