"""Substring dedup by repeated-phrase automata.

A window is ``width`` consecutive words of one document.  A word goes if a window that covers it also
starts earlier (in a smaller id, or earlier in the same document); windows are judged on the input.

1. Anchors: of the ``gram``-word hashes within a window, the smallest stands for the window.  A window can
   only recur if its anchor does, so anchors, about a seventh of the words, are counted first.
2. Confirmation: windows with recurring anchors are compared by 128-bit hashes in hash ranges; of those that
   recur, each bucket of documents learns its own first place, and whether that is the first of all.
3. Automata: a bucket compiles the phrases at the anchors of the recurring windows it holds into Aho-Corasick
   automata over its words, sharded so that each holds a bounded number of phrases, and streams its documents
   through them.  Windows around every occurrence are looked up among the recurring ones by their hashes; every
   occurrence but the first of all is cut.

Null texts have no words; documents shorter than a window lose nothing.  A null id counts as the largest.
Rows of one id are ordered by their text, and among equal rows all but one lose what they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..session import prepare_session
from .recurring import (
    BUCKET_BYTES, LAST_ID, bucket_of, count_for, known_keys, look_up, range_of, ranges_for, recurring_tokens, runs, token_keys,
    total_bytes,
)
from .wordhash import ONE, OTHER, owners, rolled, sliding, word_hash_pairs, word_hashes

PHRASES_PER_AUTOMATON = 30_000
_BASE, _FIRST_CODE, _OTHER_WORD = 64, 0x100, "\x01\x01\x01"
BYTES_PER_RANGE = 12_000_000
WINDOWS = "place int, bucket int, one binary, two binary, least long, id binary, at binary, often binary"
PHRASES = "bucket int, at binary, first binary"


def _anchors(hashes: np.ndarray, lengths, width: int, gram: int):
    """(gram hashes, anchor hash of each window start, valid window starts) of concatenated texts."""
    grams = rolled(hashes, gram, ONE)
    least = sliding(grams, width - gram + 1)
    _, ends = owners(lengths)
    valid = np.arange(len(least)) + width <= ends[:len(least)] if len(least) else np.zeros(0, bool)
    return grams, least, valid


def anchor_tokens(width: int, gram: int):
    def tokens_of(texts: list[bytes]):
        words = [t.split() for t in texts]
        lengths = [len(w) for w in words]
        grams, least, valid = _anchors(word_hashes(words), lengths, width, gram)
        if not valid.any():
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        # A gram is an anchor if it is the least of some window over it.
        span = width - gram + 1
        open_ended = np.concatenate((np.zeros(span - 1, np.uint64), np.where(valid, least, 0), np.zeros(span - 1, np.uint64)))
        chosen = np.flatnonzero(sliding(open_ended, span, np.maximum)[:len(grams)] == grams)
        return grams[chosen], owners(lengths)[0][chosen]

    return tokens_of


def in_order(table: pa.Table, binary: str = "text"):
    """Rows of a bucket by (id, text): row numbers, ids (null: the largest) and texts as bytes."""
    ids = [LAST_ID if i is None else i for i in table.column("id").to_pylist()]
    texts = [t or b"" for t in table.column(binary).cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return order, [ids[i] for i in order], [texts[i] for i in order]


def _candidates(width: int, gram: int, n_ranges: int, n_places: int):
    def windows(docs: pa.Table, known: pa.Table) -> pa.Table:
        empty = pa.schema([("place", pa.int32()), ("bucket", pa.int32()), ("one", pa.binary()), ("two", pa.binary()),
                           ("least", pa.int64()), *[(c, pa.binary()) for c in ("id", "at", "often")]]).empty_table()
        known, _ = known_keys(known)
        if not len(known) or not docs.num_rows:
            return empty
        bucket = docs.column("bucket")[0].as_py()
        _, ids, texts = in_order(docs)
        words = [t.split() for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        first_hashes, second_hashes = word_hash_pairs(words)
        _, least, valid = _anchors(first_hashes, lengths, width, gram)
        starts = np.flatnonzero(valid)
        starts = starts[look_up(token_keys(least[starts], n_ranges), known)[0]]
        if not len(starts):
            return empty
        one = rolled(first_hashes, width, ONE)[starts]
        two = rolled(second_hashes, width, OTHER)[starts]
        # The first of equal windows: starts rise by (id, text, place).
        order = np.lexsort((starts, two, one))
        same = np.concatenate(([False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])))
        at, n = runs(np.cumsum(~same))
        chosen, often = order[at], np.minimum(n, 2).astype(np.uint8)
        one, two, starts = one[chosen], two[chosen], starts[chosen]
        ids = np.array(ids, np.int64)[owners(lengths)[0][starts]]
        place = range_of(one, n_places).astype(np.int64)
        order = np.lexsort((starts, place))
        at, n = runs(place[order])
        rows = [order[i:i + m] for i, m in zip(at.tolist(), n.tolist())]
        # Ids as offsets from the least of a row, in as few bytes as they need; places as words of the bucket.
        least_ids = [ids[r].min() for r in rows]
        offsets = [(ids[r].astype(np.uint64) - np.uint64(low & (2**64 - 1))) for r, low in zip(rows, map(int, least_ids))]
        told_ids = [x.astype(np.uint32) if x.max() < 2**32 else x for x in offsets]
        blob = lambda values: pa.array([values[r].tobytes() for r in rows], pa.binary())
        return pa.table({
            "place": pa.array([int(place[r[0]]) for r in rows], pa.int32()),
            "bucket": pa.array([bucket] * len(rows), pa.int32()),
            "one": blob(one), "two": blob(two), "least": pa.array(least_ids, pa.int64()),
            "id": pa.array([x.tobytes() for x in told_ids], pa.binary()), "at": blob(starts.astype(np.uint32)), "often": blob(often)})

    return windows


def _confirm(table: pa.Table) -> pa.Table:
    read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    ones = read("one", np.uint64)
    one, two, at = np.concatenate(ones), np.concatenate(read("two", np.uint64)), np.concatenate(read("at", np.uint32))
    ids = np.concatenate([
        (np.frombuffer(x, np.uint32 if len(x) == 4 * len(o) else np.uint64).astype(np.uint64) + np.uint64(low & (2**64 - 1))).view(np.int64)
        for x, o, low in zip(table.column("id").to_pylist(), ones, table.column("least").to_pylist())])
    often = np.concatenate(read("often", np.uint8))
    bucket = np.repeat(table.column("bucket").to_numpy(), [len(x) for x in ones])
    order = np.lexsort((ids, two, one))
    one, two, ids, at, often, bucket = (x[order] for x in (one, two, ids, at, often, bucket))
    starts, n = runs(np.cumsum(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))))
    first = np.zeros(len(one), np.uint8)
    first[starts] = 1
    kept = np.repeat(np.add.reduceat(often.astype(np.int64), starts) > 1, n)
    bucket, at, first = bucket[kept], at[kept], first[kept]
    order = np.lexsort((at, bucket))
    at_bucket, n = runs(bucket[order])
    rows = [order[i:i + m] for i, m in zip(at_bucket.tolist(), n.tolist())]
    blob = lambda values: pa.array([values[r].tobytes() for r in rows], pa.binary())
    return pa.table({"bucket": pa.array([int(bucket[r[0]]) for r in rows], pa.int32()),
                     "at": blob(at), "first": blob(first)})


def locate(words: list[list[bytes]], phrases: list[tuple[int, int]], width: int,
           per_automaton: int = PHRASES_PER_AUTOMATON) -> Iterator[tuple[int, np.ndarray]]:
    """(document, first words) of every occurrence of the phrases, each ``width`` words of a document from a place on.

    Automata see a word as three characters, each place with an alphabet of its own: nodes have few branches,
    and a match starts at a word.
    """
    at = 0
    while at < len(phrases):
        codes: dict[bytes, str] = {}
        automaton = ahocorasick.Automaton()
        n_added = 0
        while at < len(phrases) and n_added < per_automaton and len(codes) + width <= _BASE**3:
            doc, place = phrases[at]
            coded = "".join([codes.setdefault(w, _code(len(codes))) for w in words[doc][place:place + width]])
            automaton.add_word(coded, True)
            at += 1
            n_added += 1
        automaton.make_automaton()
        for doc, own in enumerate(words):
            if len(own) >= width:
                coded = "".join([codes.get(w, _OTHER_WORD) for w in own])
                ends = [end for end, _ in automaton.iter(coded)]
                if ends:
                    yield doc, np.array(ends, np.int64) // 3 - (width - 1)


def _code(number: int) -> str:
    high, low = divmod(number, _BASE)
    high, middle = divmod(high, _BASE)
    return chr(_FIRST_CODE + high) + chr(_FIRST_CODE + _BASE + middle) + chr(_FIRST_CODE + 2 * _BASE + low)


def repeated(words: list[list[bytes]], starts: np.ndarray, firsts: np.ndarray, width: int, gram: int,
             per_automaton: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, in the concatenation of the documents, of windows to cut; and where documents begin.

    ``starts``: the first place in these documents of each recurring window; ``firsts``: if it is the first of all.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths)))
    if not len(starts):
        return starts, begins
    hashes, others = word_hash_pairs(words)
    one, two = rolled(hashes, width, ONE), rolled(others, width, OTHER)
    grams = rolled(hashes, gram, ONE)
    span = width - gram + 1
    # Phrases: the grams that stand for the recurring windows, each distinct one once.
    least = np.zeros(len(grams) + span - 1, np.uint64)
    least[span - 1 + starts] = sliding(grams, span)[starts]
    anchors = np.flatnonzero(sliding(least, span, np.maximum)[:len(grams)] == grams)
    anchors = anchors[np.unique(grams[anchors], return_index=True)[1]]
    doc_of = np.searchsorted(begins, anchors, side="right") - 1
    near = np.zeros(len(hashes) + 1, np.int32)
    for doc, at in locate(words, list(zip(doc_of.tolist(), (anchors - begins[doc_of]).tolist())), gram, per_automaton):
        low = np.maximum(at - (span - 1), 0)
        high = np.minimum(at, lengths[doc] - width)
        some = high >= low
        np.add.at(near, begins[doc] + low[some], 1)
        np.add.at(near, begins[doc] + high[some] + 1, -1)
    near = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    order = np.lexsort((two[starts], one[starts]))
    known_one, known_two, known_start, known_first = one[starts][order], two[starts][order], starts[order], firsts[order]
    hit, at = look_up(one[near], known_one)
    # Windows that agree in the first hash alone lie next to each other: step to the one that agrees in both.
    while True:
        wrong = hit & (known_two[at] != two[near])
        if not wrong.any():
            break
        step = at[wrong] + 1
        rows = np.flatnonzero(wrong)
        going = (step < len(known_one)) & (known_one[np.minimum(step, len(known_one) - 1)] == one[near[rows]])
        at[rows[going]] = step[going]
        hit[rows[~going]] = False
    near, at = near[hit], at[hit]
    return near[~(known_first[at] & (known_start[at] == near))], begins


def _cut(width: int, gram: int, schema: pa.Schema, per_automaton: int, as_given: bool):
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        order, _, texts = in_order(docs)
        words = [t.split() for t in texts]
        at = [np.frombuffer(x, np.uint32).astype(np.int64) for x in found.column("at").to_pylist()]
        first = [np.frombuffer(x, np.bool_) for x in found.column("first").to_pylist()]
        nothing = np.empty(0, np.int64)
        starts, begins = repeated(words, np.concatenate([nothing, *at]), np.concatenate([nothing.astype(bool), *first]),
                                  width, gram, per_automaton)
        step = np.zeros(int(begins[-1]) + 1, np.int32)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + width, -1)
        all_gone = np.cumsum(step[:-1]) > 0
        n_removed, kept_text, spans = [], [], []
        given = docs.column("text").cast(pa.binary()).take(pa.array(order, pa.int64())).to_pylist() if as_given else None
        for i, (own, begin) in enumerate(zip(words, begins.tolist())):
            gone = all_gone[begin:begin + len(own)]
            if not gone.any():
                n_removed.append(0)
                kept_text.append(given[i] if as_given else b" ".join(own))
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
            spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
            n_removed.append(int(gone.sum()))
            kept_text.append(b" ".join([w for w, g in zip(own, gone.tolist()) if not g]))
        rows = docs.take(pa.array(order, pa.int64()))
        return pa.table([
            rows.column("row"), pa.array([len(w) for w in words], pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(kept_text, pa.binary()).cast(pa.string()), pa.array(spans, schema.field("spans").type),
        ], schema=schema)

    return cut


def cut_repeats(docs: DataFrame, *, width: int = 20, gram: int = 8, id_col: str = "doc_id", text_col: str = "text",
                bucket_bytes: int = BUCKET_BYTES, per_automaton: int = PHRASES_PER_AUTOMATON, as_given: bool = False) -> DataFrame:
    """One row per document row: ``row`` (its columns but the text), ``n_words``, ``n_removed``, ``kept_text`` (the
    kept words joined by single blanks; with ``as_given``, texts that lose nothing as they are) and ``spans``
    (removed ranges of words)."""
    prepare_session(docs.sparkSession)
    size = total_bytes(docs, text_col)
    n_buckets = count_for(docs, size, bucket_bytes)
    n_ranges = ranges_for(size, 6 * BYTES_PER_RANGE)
    n_places = ranges_for(size, BYTES_PER_RANGE)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(bucket_of(id_col, n_buckets).alias("bucket"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"), F.struct(*rest).alias("row"))
    texts = rows.select("bucket", "id", "text")
    by_bucket = lambda df: df.groupBy("bucket")
    known = recurring_tokens(texts, anchor_tokens(width, gram), n_buckets, n_ranges)
    found = by_bucket(texts).cogroup(by_bucket(known)).applyInArrow(
        _candidates(width, gram, n_ranges, n_places), WINDOWS)
    phrases = found.groupBy("place").applyInArrow(_confirm, PHRASES)
    out = StructType([
        StructField("row", rows.schema["row"].dataType), StructField("n_words", LongType()),
        StructField("n_removed", LongType()), StructField("kept_text", StringType()),
        StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    ])
    return by_bucket(rows).cogroup(by_bucket(phrases)).applyInArrow(
        _cut(width, gram, to_arrow_schema(out), per_automaton, as_given), out)


def without_repeats(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents, with their columns, without the repeated passages; untouched texts stay as they are.

    Documents that lose all their words go.
    """
    done = cut_repeats(docs, text_col=text_col, as_given=True, **options)
    left = done.where("n_removed = 0 or n_removed < n_words")
    return left.select(*[F.col("kept_text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
