"""Substring dedup on bytes by sorted suffixes: a difference cover that follows the content.

Every byte goes that is covered by a ``length``-byte string which also starts anywhere else, the same document
included; strings never cross documents and are judged on the input.

A difference cover picks suffixes such that any two places reach picked ones at the same distance.  Residues
of positions, as in the textbook algorithm, would pick two thirds of all bytes; here the content picks: among the
``gram``-byte hashes within a window of ``length`` bytes, the smallest stands for the window (a string
synchronising set).  Equal windows have their picked suffix at the same distance, and it is one place in about
a hundred.

1. Picked grams are counted over the corpus; windows whose gram occurs once are unique.
2. Neighbouring windows with one picked suffix form a run; its context is the bytes they cover.  Equal contexts
   form a class, told once with its count.  A class with two members recurs as a whole.
3. The picked suffixes of the other classes that share a gram are sorted: their bytes become names of eight,
   triples of names are sorted and named anew, recursing until one name, the rank, is left.  Remaining
   suffixes, those that start before the picked one, are merged by (bytes up to the picked one, its rank).
   Adjacent prefixes are compared: windows recur where ranks agree for the bytes that are left.
4. Documents are cut where their contexts recur.

A gram with very many contexts is halved by the distance to the picked suffix: each half keeps the bytes that its
windows cover, equal ones are told once, and those that differ in the bytes which all its windows share part.  What
is still many is halved again, down to single windows, so no task has a whole such group.

Null texts have no bytes; texts shorter than ``length`` lose nothing; null ids and repeated rows are documents like
others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..session import prepare_session, small_side, store
from .recurring import BUCKET_BYTES, bucket_of, count_for, known_keys, look_up, ranges_for, recurring_tokens, runs, token_keys, total_bytes
from .wordhash import ONE, mixed, owners, rolled, sliding

SLICE_BYTES = 1_000_000
CONTEXTS_AT_ONCE = 4096
#: Bytes of text per range of picked grams, of which there is one in about a hundred bytes.
RANGE_BYTES = 100_000_000
_PLACE = np.uint64((1 << 28) - 1)
_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64))
CLASS = ["gram", "one", "two"]
#: What windows at ``lo`` to ``hi`` bytes before the picked suffix cover of a context.
PIECE = ["gram", "lo", "hi", "lead", "context"]
CONTEXTS = "bucket int, gram long, one long, two long, lead int, windows int, often long, context binary"
RECURRING = "gram long, one long, two long, flags binary"
RECURRING_PIECES = "gram long, lo int, hi int, lead int, context binary, flags binary"


def _slices(texts: list[bytes]):
    """Numbers of consecutive texts of about SLICE_BYTES together."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE_BYTES:
            yield range(first, i + 1)
            first, held = i + 1, 0
    if first < len(texts):
        yield range(first, len(texts))


def picked(texts: list[bytes], length: int, gram: int):
    """(gram hashes, starts of windows, the picked place of each, text of each, begins of texts), concatenated."""
    lengths = np.array([len(t) for t in texts], np.int64)
    grams = rolled(_BYTE_HASH[np.frombuffer(b"".join(texts), np.uint8)], gram, ONE)
    span = length - gram + 1
    # Smallest by the upper bits; ties, also of equal grams, go to the first place.
    least = sliding((grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE), span)
    number, ends = owners(lengths)
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends[:len(least)]) if len(least) else np.empty(0, np.int64)
    return grams, starts, (least[starts] & _PLACE).astype(np.int64), number[starts] if len(starts) else starts, np.cumsum(lengths) - lengths


def _gram_tokens(length: int, gram: int):
    def tokens_of(texts):
        tokens, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for part in _slices(texts):
            grams, _, places, number, _ = picked([texts[i] for i in part], length, gram)
            first, _ = runs(places)
            tokens.append(grams[places[first]])
            owner.append(number[first] + part.start)
        return np.concatenate(tokens), np.concatenate(owner)

    return tokens_of


def _runs_of(texts: list[bytes], length: int, gram: int, wanted):
    """(text, first window, windows, lead, gram hash) of every run whose gram is wanted."""
    for part in _slices(texts):
        grams, starts, places, number, begins = picked([texts[i] for i in part], length, gram)
        first, n = runs(places)
        hashes = grams[places[first]]
        for i in np.flatnonzero(wanted(hashes)).tolist():
            at = first[i]
            text = int(number[at])
            start = int(starts[at])
            yield part.start + text, start - int(begins[text]), int(n[i]), int(places[at]) - start, int(hashes[i].view(np.int64))


def _halves(context: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_digest(context)
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def _contexts(length: int, gram: int, n_ranges: int, schema: pa.Schema):
    def contexts(docs: pa.Table, known: pa.Table) -> pa.Table:
        known, _ = known_keys(known)
        found: dict[tuple, list] = {}
        if len(known) and docs.num_rows:
            bucket = docs.column("bucket")[0].as_py()
            texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
            wanted = lambda hashes: look_up(token_keys(hashes, n_ranges), known)[0]
            for text, start, n, lead, own in _runs_of(texts, length, gram, wanted):
                context = texts[text][start:start + n + length - 1]
                row = found.setdefault((own, *_halves(context)), [lead, n, 0, context])
                row[2] += 1
        columns = list(zip(*((bucket, *key, *row) for key, row in found.items()))) if found else [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return contexts


def ranks(names: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by their names, left first: triples are sorted, named by rank, and so on."""
    while names.shape[1] > 1:
        lacking = -names.shape[1] % 3
        names = np.concatenate((names, np.zeros((len(names), lacking), names.dtype)), 1)
        named = np.empty((len(names), names.shape[1] // 3), np.int64)
        for i in range(named.shape[1]):
            a, b, c = names[:, 3 * i], names[:, 3 * i + 1], names[:, 3 * i + 2]
            order = np.lexsort((c, b, a))
            new = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)
            named[order, i] = np.concatenate(([0], np.cumsum(new)))
        names = named
    return names[:, 0]


def recurring_windows(grams: np.ndarray, leads: np.ndarray, contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, whether each of its windows occurs in another context of the same gram too.

    ``leads``: the place of the picked suffix in each context.
    """
    n = len(contexts)
    windows = np.array([len(c) - length + 1 for c in contexts], np.int64)
    flags = [np.zeros(w, bool) for w in windows]
    # Forward bytes from the picked suffix on, as many as any window needs, as big-endian names of eight.
    forward = np.zeros((n, -(-length // 8) * 8), np.uint8)
    for i, (context, lead) in enumerate(zip(contexts, leads.tolist())):
        own = np.frombuffer(context, np.uint8)[lead:lead + length]
        forward[i, :len(own)] = own
    names = forward.view(">u8").astype(np.uint64)
    rank = ranks(np.concatenate((grams.view(np.uint64)[:, None], names), 1))
    order = np.argsort(rank, kind="stable")
    sorted_forward, sorted_grams = forward[order], grams[order]
    # Common prefixes of neighbours; none across grams.
    differ = sorted_forward[1:] != sorted_forward[:-1]
    common = np.where(differ.any(1), differ.argmax(1), forward.shape[1])
    common[sorted_grams[1:] != sorted_grams[:-1]] = -1
    # Hashes of the bytes before the picked suffix, built up one byte at a time.
    heads = np.zeros(n, np.uint64)
    for distance in range(0, int(leads.max(initial=0)) + 1):
        if distance:
            has = leads >= distance
            before = np.zeros(n, np.int64)
            before[has] = [contexts[i][leads[i] - distance] for i in np.flatnonzero(has).tolist()]
            heads = mixed(heads * ONE + _BYTE_HASH[before])
        at = leads - distance
        some = (at >= 0) & (at < windows)
        if some.sum() < 2:
            continue
        group = np.empty(n, np.int64)
        group[order] = np.concatenate(([0], np.cumsum(common < length - distance)))
        rows = np.flatnonzero(some)
        by = rows[np.lexsort((heads[rows], group[rows]))]
        same = (group[by][1:] == group[by][:-1]) & (heads[by][1:] == heads[by][:-1])
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        for i in by[twice].tolist():
            flags[i][at[i]] = True
    return flags


def _recurring(length: int, key: list[str]):
    def recurring(table: pa.Table) -> pa.Table:
        grams, leads = (table.column(c).to_numpy() for c in ("gram", "lead"))
        found = recurring_windows(grams, leads.astype(np.int64), table.column("context").to_pylist(), length)
        some = [i for i, f in enumerate(found) if f.any()]
        kept = table.take(pa.array(some, pa.int64()))
        return pa.table({**{c: kept.column(c) for c in key}, "flags": pa.array([found[i].tobytes() for i in some], pa.binary())})

    return recurring


def _halves_of(rows: DataFrame, length: int) -> DataFrame:
    """Both halves of each row's distances: the bytes that the windows there cover, if there are any."""
    middle = F.expr("cast((lo + hi) div 2 as int)")
    half = F.explode(F.array(F.struct(F.col("lo").alias("from"), middle.alias("to")),
                             F.struct((middle + 1).alias("from"), F.col("hi").alias("to")))).alias("half")
    sides = rows.where("lo < hi").select("*", half).withColumn("begin", F.expr("greatest(0, lead - half.to)")).withColumn(
        "end", F.expr(f"least(octet_length(context), lead - half.from + {length})"))
    return sides.where(f"end - begin >= {length}").select(
        *CLASS, "windows", F.expr("skip + begin").alias("skip"), F.col("half.from").alias("lo"), F.col("half.to").alias("hi"),
        F.expr("lead - begin").alias("lead"), F.expr("substring(context, begin + 1, end - begin)").alias("context"))


def _dealt_out(classes: DataFrame, length: int, span: int, n_places: int) -> DataFrame:
    """RECURRING of classes whose grams have too many for a task; a class may have several rows, one per range."""
    # Windows that recur at the same distance agree in the bytes that all windows of the range have.
    node = F.xxhash64("gram", "lo", "hi", F.expr(f"substring(context, lead - lo + 1, {length} - hi + lo)"))
    rows = classes.select(*CLASS, F.expr(f"octet_length(context) - {length - 1}").alias("windows"), F.lit(0).alias("skip"),
                          F.lit(0).alias("lo"), F.lit(span - 1).alias("hi"), "lead", "context")
    verdicts, n_many = None, 1
    while n_many:
        rows = store(_halves_of(rows, length))
        pieces = store(rows.groupBy(*PIECE).agg(F.count("*").alias("often")).withColumn("node", node))
        many = store(pieces.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > CONTEXTS_AT_ONCE))
        n_many = many.count()
        few = pieces.join(small_side(many, n_many), "node", "left_anti").withColumn("place", F.pmod("node", F.lit(n_places)))
        whole = pieces.where("often > 1").select(*PIECE, F.expr(f"rpad(X'01', octet_length(context) - {length - 1}, X'01')").alias("flags"))
        found = whole.union(few.groupBy("place").applyInArrow(_recurring(length, PIECE), RECURRING_PIECES))
        told = rows.join(found, PIECE).select(*CLASS, F.expr("rpad(lpad(flags, skip + octet_length(flags), X'00'), windows, X'00')").alias("flags"))
        verdicts = told if verdicts is None else verdicts.union(told)
        rows = rows.withColumn("node", node).join(small_side(many, n_many), "node", "left_semi")
    return verdicts


def _cut(length: int, gram: int, schema: pa.Schema):
    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
        flags: dict[tuple, list[bytes | None]] = {}
        for *key, own in zip(*(told.column(c).to_pylist() for c in (*CLASS, "flags"))):
            flags.setdefault(tuple(key), []).append(own)
        grams = np.unique(np.array([k[0] for k in flags], np.int64).view(np.uint64)) if flags else np.empty(0, np.uint64)
        steps: dict[int, np.ndarray] = {}
        if flags:
            for text, start, n, _, own in _runs_of(texts, length, gram, lambda hashes: look_up(hashes, grams)[0]):
                found = flags.get((own, *_halves(texts[text][start:start + n + length - 1])))
                if found is None:
                    continue
                step = steps.setdefault(text, np.zeros(len(texts[text]) + 1, np.int32))
                if None in found:
                    hit = np.arange(n)
                else:
                    hit = np.flatnonzero(np.logical_or.reduce([np.frombuffer(f, np.bool_) for f in found]))
                np.add.at(step, hit + start, 1)
                np.add.at(step, hit + start + length, -1)
        n_removed, spans, kept = [], [], []
        for i, text in enumerate(texts):
            if i not in steps:
                n_removed.append(0)
                spans.append([])
                kept.append(text)
                continue
            gone = np.cumsum(steps[i][:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
            spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
            n_removed.append(int(gone.sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        return pa.table([docs.column("row"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_removed, pa.int64()),
                         pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)

    return cut


def cut_recurring(docs: DataFrame, *, length: int = 400, gram: int = 200, id_col: str = "doc_id", text_col: str = "text",
                  bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document row: ``row`` (its columns but the text), ``n_bytes``, ``n_removed``, ``spans`` (removed
    byte ranges) and ``kept`` (the bytes that are left)."""
    prepare_session(docs.sparkSession)
    size = total_bytes(docs, text_col)
    n_parts = count_for(docs, size, bucket_bytes)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(bucket_of(id_col, n_parts).alias("bucket"), F.col(text_col).cast("string").alias("text"),
                       F.struct(*rest).alias("row"))
    texts = rows.select("bucket", "text")
    n_ranges = ranges_for(size, RANGE_BYTES)
    known = recurring_tokens(texts, _gram_tokens(length, gram), n_parts, n_ranges)
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.int64()) for c in CLASS], ("lead", pa.int32()), ("windows", pa.int32()),
                        ("often", pa.int64()), ("context", pa.binary())])
    told = store(texts.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        _contexts(length, gram, n_ranges, schema), CONTEXTS))
    classes = store(told.groupBy(*CLASS).agg(F.sum("often").alias("often")))
    shared = store(classes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    n_shared, most = shared.agg(F.count("*"), F.max("n")).first()
    whole = classes.where("often > 1").select(*CLASS, F.lit(None).cast("binary").alias("flags"))
    # One context of each class whose gram has several.
    open_ = told.join(small_side(shared, n_shared), "gram").groupBy(*CLASS).agg(
        F.first("lead").alias("lead"), F.first("context").alias("context"), F.first("n").alias("n"))
    places = 4 * n_parts
    few = open_.where(F.col("n") <= CONTEXTS_AT_ONCE).withColumn("place", F.pmod(F.xxhash64("gram"), F.lit(places)))
    some = few.groupBy("place").applyInArrow(_recurring(length, CLASS), RECURRING)
    if n_shared and most > CONTEXTS_AT_ONCE:
        some = some.union(_dealt_out(open_.where(F.col("n") > CONTEXTS_AT_ONCE), length, length - gram + 1, places))
    verdicts = store(whole.union(some))
    where = told.select("bucket", *CLASS).join(verdicts, CLASS)
    out = StructType([
        StructField("row", rows.schema["row"].dataType), StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
        StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
        StructField("kept", BinaryType()),
    ])
    return rows.groupBy("bucket").cogroup(where.groupBy("bucket")).applyInArrow(_cut(length, gram, to_arrow_schema(out)), out)
