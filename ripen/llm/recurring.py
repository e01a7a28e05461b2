"""What recurs in a corpus: which of a document's tokens occur elsewhere too, told bucket by bucket.

Documents fall into buckets by a hash of their id.  Tasks turn documents into 64-bit tokens (hashes of
shingles, of anchors) and send them, one row of arrays per range, to token ranges; a range counts its tokens and
sends those with at least two occurrences back to the buckets that hold them.  A bucket's documents and
its recurring tokens then meet in a cogroup.  Nothing is collected or broadcast, groups are bounded by the
bucket and range sizes, and a token that is frequent within one flush of a task is known to recur without
being counted: its occurrences go straight back and the range gets one marker for it.

Ranges keep the low half of a token and the range number, some 40 bits at 100 ranges and more with more
data.  Two tokens that fall together there only look more frequent than they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 5_000_000
FLUSH_TOKENS = 1_000_000
HOT_HERE = 64
LAST_ID = 2**63 - 1
#: Class of tokens that some task found frequent; others have the rounded 4 * log2(count).
HOT = 255
#: In place of a range: keys, whole, that were not counted.
READY = -1


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def count_for(docs: DataFrame, amount: int, per_part: int) -> int:
    """Parts of at most about ``per_part``; at least the session's shuffle partitions."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-amount // per_part))


def ranges_for(amount: int, per_range: int) -> int:
    """Ranges of at most about ``per_range``: as few as that, since a task tells every bucket and range apart."""
    return max(1, -(-amount // per_range))


def bucket_of(id_col: str, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col), F.lit(LAST_ID))), F.lit(n_buckets)).cast("int")


def range_of(tokens: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)


def token_keys(tokens: np.ndarray, n_ranges: int) -> np.ndarray:
    """Range number and low half of each token, as one sortable key."""
    return (range_of(tokens, n_ranges) << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(values)])))


def _count_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(254, np.rint(4 * np.log2(counts))).astype(np.uint8)


ROUTED = "r int, bucket int, keys binary, classes binary"
SPREAD = "r int, ready boolean, keys binary, buckets binary"
#: In place of a bucket: the key is frequent in some flush, and told to the range once.
MARK = -1


def _routed(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else ([], [], [], [])
    return pa.table({"r": pa.array(columns[0], pa.int32()), "bucket": pa.array(columns[1], pa.int32()),
                     "keys": pa.array(columns[2], pa.binary()), "classes": pa.array(columns[3], pa.binary())})


def _one_row_a_place(places: np.ndarray, ready: bool, keys: np.ndarray, buckets: np.ndarray) -> list[tuple]:
    order = np.lexsort((buckets, places))
    places, keys, buckets = places[order], keys[order], buckets[order].astype(np.int32)
    at, n = runs(places)
    return [(int(places[i]), ready, keys[i:i + m].tobytes(), buckets[i:i + m].tobytes()) for i, m in zip(at.tolist(), n.tolist())]


def recurring_tokens(docs: DataFrame, tokens_of: Callable, n_buckets: int, n_ranges: int) -> DataFrame:
    """``bucket, r, keys, classes``: the recurring tokens of a bucket's documents.

    ``docs`` has ``bucket`` and ``text``; ``tokens_of`` maps a list of texts (bytes) to (tokens, number of
    the text of each token).  ``keys`` holds unsigned 32-bit low halves within range ``r``, whole keys where
    ``r`` is READY; ``classes`` a byte per key, growing with the token's count, HOT where not given.

    A flush sends each range one row with parallel arrays of keys and buckets, whatever the number of buckets.
    """

    def flush(buckets, tokens):
        keys = token_keys(tokens, n_ranges)
        order = np.argsort(keys, kind="stable")
        keys, buckets = keys[order], buckets[order]
        starts, counts = runs(keys)
        frequent = counts >= HOT_HERE
        hot = np.repeat(frequent, counts)
        marks = keys[starts[frequent]]
        k = np.concatenate((keys[~hot], marks))
        b = np.concatenate((buckets[~hot], np.full(len(marks), MARK, buckets.dtype)))
        out = _one_row_a_place(k >> np.uint64(32), False, k.astype(np.uint32), b)
        k, b = keys[hot], buckets[hot]  # not counted: these keys go straight back, once per bucket
        order = np.lexsort((b, k))
        k, b = k[order], b[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        out += _one_row_a_place(b[new] % n_ranges, True, k[new], b[new])
        columns = list(zip(*out)) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
            names=["r", "ready", "keys", "buckets"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for first in range(0, len(texts), 512):
                tokens, owner = tokens_of([t or b"" for t in texts[first:first + 512]])
                held.append((buckets[first:first + 512][owner], tokens))
                n_held += len(tokens)
                if n_held >= FLUSH_TOKENS:
                    yield flush(*(np.concatenate(x) for x in zip(*held)))
                    held, n_held = [], 0
        if n_held:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    def arrays(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate([np.frombuffer(x, kind) for x in table.column("keys").to_pylist()]),
                np.concatenate([np.frombuffer(x, np.int32) for x in table.column("buckets").to_pylist()]))

    def answers(r: int, keys, buckets, classes) -> pa.Table:
        """One row per bucket; the keys come sorted."""
        order = np.argsort(buckets, kind="stable")
        keys, buckets = keys[order], buckets[order]
        classes = None if classes is None else classes[order]
        at, n = runs(buckets)
        rows = []
        for i, m in zip(at.tolist(), n.tolist()):
            first, _ = runs(keys[i:i + m])
            rows.append((r, int(buckets[i]), keys[i:i + m][first].tobytes(), None if classes is None else classes[i:i + m][first].tobytes()))
        return _routed(rows)

    def settle(table: pa.Table) -> pa.Table:
        if table.column("ready")[0].as_py():
            keys, buckets = arrays(table, np.uint64)
            order = np.argsort(keys, kind="stable")
            return answers(READY, keys[order], buckets[order], None)
        keys, buckets = arrays(table, np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, buckets = keys[order], buckets[order]
        starts, counts = runs(keys)
        hot = np.logical_or.reduceat(buckets == MARK, starts) if len(starts) else np.empty(0, bool)
        classes = np.repeat(np.where(hot, HOT, _count_class(np.maximum(counts, 1))).astype(np.uint8), counts)
        kept = np.repeat(hot | (counts > 1), counts) & (buckets != MARK)
        return answers(table.column("r")[0].as_py(), keys[kept], buckets[kept], classes[kept])

    return docs.select("bucket", "text").mapInArrow(spread, SPREAD).groupBy("ready", "r").applyInArrow(settle, ROUTED)


def known_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a bucket got, sorted and distinct, and their classes."""
    places = table.column("r").to_pylist()
    keys = [np.frombuffer(k, np.uint64) if r == READY else np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(r << 32)
            for r, k in zip(places, table.column("keys").to_pylist())]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    keys_of, keys = keys, np.concatenate(keys)
    classes = np.concatenate([np.full(len(k), HOT, np.uint8) if r == READY else np.frombuffer(c, np.uint8)
                              for r, k, c in zip(places, keys_of, table.column("classes").to_pylist())])
    order = np.argsort(keys, kind="stable")
    keys, classes = keys[order], classes[order]
    first, _ = runs(keys)
    return keys[first], classes[first]


def look_up(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it is known, and its place among the known (any place, if not)."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at
