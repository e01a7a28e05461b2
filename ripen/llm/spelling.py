"""Spelling variants: words one edit apart, found by asymmetric q-chunks, grouped under their commonest neighbour.

Words are maximal runs of Latin letters with A-Z lower-cased; those of at least ``least_length`` code points and
``least_count`` occurrences take part.  Two words are near if one inserted, deleted or replaced code point turns one
into the other.

The shorter word of a pair (either, if equally long) contributes two disjoint chunks that cover it, its halves.
One edit touches one of them; the other is found whole in the longer word, moved by at most one place: the front
half where it was, the back half moved by the difference of the lengths.  The longer word therefore contributes
its positional grams as long as the halves of a word of its own length, and of one less, at the places within
shift one where such a half can stand.  Chunks and grams meet in an equi-join on (length, half, characters), and
every meeting is verified inside the join, so that only near pairs leave it.  Where many words share a chunk, they are
dealt out in blocks by hash and its grams go to each block, so that no task has a whole such group.

A word's form is its commonest near word if that is at least ``ratio`` times as common.  Counts grow along forms,
so they end in a root, found by doubling: each round a word points to where its target pointed.

Null texts and texts without letters have no words.  A null id stands for an empty string.  Repeated rows count each,
as ties in counts go to the smaller word.  An empty table has no words.  Very long texts and words are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare_session, small_side, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: Words that share a chunk beyond this are split into blocks of about as many.
BLOCK_WORDS = 500


@dataclass(frozen=True)
class Settings:
    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    #: Occurrences whose hash this divides lose a code point; 0: none.
    slip_every: int = 97


def word_counts(docs: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words that take part and their occurrences."""
    lowered = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lowered, F.lit(RUN), 0)).alias("run"))
    word = F.col("run")
    if settings.slip_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = F.pmod(h, F.length("run")).cast("int")
        slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        word = F.when(h % settings.slip_every == 0, slipped).otherwise(F.col("run"))
    long_enough = F.length("word") >= settings.least_length
    return runs.select(word.alias("word")).where(long_enough).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= settings.least_count)


def _half(length: Column) -> Column:
    """Code points of the front half of a word of ``length``."""
    return F.floor(length / 2).cast("int")


def _keys(length: Column, side: int, text: Column) -> list[Column]:
    return [length.alias("length"), F.lit(side).alias("side"), text.alias("gram")]


def _chunks(words: DataFrame) -> DataFrame:
    """Two rows a word: its halves."""
    length, word = F.col("size"), F.col("word")
    front = F.struct(*_keys(length, 0, word.substr(F.lit(1), _half(length))))
    back = F.struct(*_keys(length, 1, word.substr(_half(length) + 1, length)))
    return words.select("word", "n", "size", F.explode(F.array(front, back)).alias("key")).select("key.*", "word", "n", "size")


def _grams(words: DataFrame) -> DataFrame:
    """Positional grams of a word that may equal a half of a word as long, or shorter by one."""
    word, found = F.col("word"), []
    for less in (0, 1):
        length = F.col("size") - less
        found.append(F.struct(*_keys(length, 0, word.substr(F.lit(1), _half(length)))))
        found.append(F.struct(*_keys(length, 1, word.substr(_half(length) + 1 + less, length))))
    return words.select("word", "n", "size", F.explode(F.array(*found)).alias("key")).select("key.*", "word", "n", "size")


def near_pairs(words: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, n, other, other_n``: the near pairs of ``words`` (word, n), each once, the shorter or smaller word first."""
    prepare_session(words.sparkSession)
    sized = words.select("word", "n", F.length("word").alias("size"))
    keys = ["length", "side", "gram"]
    chunks, grams = _chunks(sized), _grams(sized)
    crowded = store(chunks.groupBy(*keys).count().where(F.col("count") > block_words).select(
        *keys, F.ceil(F.col("count") / block_words).cast("int").alias("n_blocks")))
    blocks = small_side(crowded, crowded.count())
    parts = F.coalesce("n_blocks", F.lit(1))
    dealt = chunks.join(blocks, keys, "left").select(
        *keys, F.pmod(F.xxhash64("word"), parts).cast("int").alias("block"), "word", "n", "size")
    copied = grams.join(blocks, keys, "left").select(
        *keys, F.explode(F.sequence(F.lit(0), parts - 1)).alias("block"), F.col("word").alias("other"),
        F.col("n").alias("other_n"), F.col("size").alias("other_size"))
    # Of the half that the edit touched, the first or the last code point is left as it was, if it has two.
    ends = {c: (F.when(F.col("side") == 0, F.col(c).substr(_half(F.col("length")) + 1, F.lit(1))).otherwise(F.col(c).substr(1, 1)),
                F.when(F.col("side") == 0, F.col(c).substr(-1, 1)).otherwise(
                    F.col(c).substr(_half(F.col("length")) + (F.length(c) - F.col("length")), F.lit(1))))
            for c in ("word", "other")}
    dealt = dealt.withColumn("head", ends["word"][0]).withColumn("tail", ends["word"][1])
    copied = copied.withColumn("other_head", ends["other"][0]).withColumn("other_tail", ends["other"][1])
    a, b = dealt.alias("a"), copied.alias("b")
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "block")]
    first = (F.col("size") < F.col("other_size")) | (F.col("word") < F.col("other"))
    hint = (F.col("a.length") < 4) | (F.col("head") == F.col("other_head")) | (F.col("tail") == F.col("other_tail"))
    near = F.levenshtein("word", "other", 1) == 1
    return a.join(b, [*met, first, hint, near]).select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words of ``forms`` (word, form), whose chains end."""
    reached = store(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        further = store(reached.join(ahead, reached["root"] == ahead["_at"], "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if not further.where("_moved").head(1):
            return further.select("word", "root")
        reached = further.select("word", "root")


def group_variants(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    words = store(words)
    pairs = store(near_pairs(words))
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("down"), "other")).alias("top"))
    judged = store(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("top.down") >= settings.ratio * F.col("n"), F.struct("top.other", (-F.col("top.down")).alias("n"))).alias("to")
    ).select("word", "n", "n_near", F.col("to.other").alias("form"), F.col("to.n").alias("form_n")))
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of ``docs``."""
    prepare_session(docs.sparkSession)
    return group_variants(word_counts(docs, settings, id_col=id_col, text_col=text_col), settings)
