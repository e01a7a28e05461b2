"""Harmonic packing of token sequences.

A sequence holds ``size`` tokens.  A piece of length l is of class k = size // l: k such pieces fit into one
sequence, and its bins are filled with exactly k pieces, whatever their lengths within the class.  Documents
may be cut freely, so that pieces lie close under the reciprocal slot size // k of their class: whole
sequences first; then a rest that would leave more than ``most_waste`` of its slot empty gives the full
slot of the next class, and its rest goes on.

Classes are filled independently by each task over the documents it reads: no exchange, and the state is
at most k - 1 pieces per class.  What is left of all classes at the end of a task goes into bins by first
fit, longest first; only the last bins of a task are badly filled.  Sequence ids are the task's number and a
count, so a task that runs again gives the same rows.

A null text is empty, a document of its end id alone.  Repeated rows are packed each.  An empty table gives
no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare_session
from .tokens import encoder, tokenizer_path

SIZE = 1024
MOST_WASTE = 8
TASK_BITS = 40
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def cut_lengths(n: int, size: int = SIZE, most_waste: int = MOST_WASTE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in turn."""
    out = [size] * (n // size)
    rest = n % size
    while rest:
        k = size // rest
        if size // k - rest <= most_waste:
            out.append(rest)
            break
        slot = size // (k + 1)
        out.append(slot)
        rest -= slot
    return out


class Bins:
    """Open bins of each class; full ones come out as lists of pieces (their lengths first)."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.open: dict[int, list] = {}

    def add(self, piece) -> list | None:
        k = self.size // piece[0]
        if k == 1:
            return [piece]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.open.pop(k) if len(held) == k else None

    def rest(self) -> Iterator[list]:
        """The pieces of all unfilled bins, first fit, longest first."""
        bins: list[list] = []
        room: list[int] = []
        for piece in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[0]):
            at = next((i for i, r in enumerate(room) if r >= piece[0]), None)
            if at is None:
                bins.append([])
                room.append(self.size)
                at = len(bins) - 1
            bins[at].append(piece)
            room[at] -= piece[0]
        self.open = {}
        yield from bins


def _pack(path: str, end_id: int, size: int, most_waste: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, rows = Bins(size), []
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << TASK_BITS

        def close(bin_) -> None:
            nonlocal number
            at = 0
            for length, doc, start, ids, n in bin_:
                rows.append((doc, start, length, ids, n, number, at))
                at += length
            number += 1

        def told() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[
                "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return batch

        for batch in batches:
            docs, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for first in range(0, len(texts), 1000):
                encoded = encoder(path).encode(texts[first:first + 1000], end_id)
                for doc, ids in zip(docs[first:first + 1000], encoded):
                    n, start = len(ids) // 4, 0
                    for length in cut_lengths(n, size, most_waste):
                        full = bins.add((length, doc, start, ids[4 * start:4 * (start + length)], n))
                        start += length
                        if full:
                            close(full)
                if rows:
                    yield told()
        for bin_ in bins.rest():
            close(bin_)
        if rows:
            yield told()

    return pack


def pack(docs: DataFrame, *, size: int = SIZE, most_waste: int = MOST_WASTE, path: str | None = None, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens,
    sequence_id, offset."""
    prepare_session(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pack(path or tokenizer_path(), end_id, size, most_waste), PIECES)


def padding(lengths: np.ndarray, size: int = SIZE) -> int:
    """Padding of sequences filled so far: none at a power of two, else up to the size."""
    powers = (lengths & (lengths - 1)) == 0
    return int(np.where(powers, 0, size - lengths).sum())
