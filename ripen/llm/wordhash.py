"""Words of texts as bytes, their hashes, and hashes of runs of words or bytes."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

ONE = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers spread over the whole word (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(word_lists: list[list[bytes]]) -> np.ndarray:
    """One hash per word of all texts in turn; each distinct word is hashed once."""
    return word_hash_pairs(word_lists)[0]


def word_hash_pairs(word_lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes per word of all texts in turn."""
    words = list(chain.from_iterable(word_lists))
    place = {w: i for i, w in enumerate(set(words))}
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, place)), ">u8").astype(np.uint64).reshape(-1, 2)
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    return both[at, 1], both[at, 0]


def rolled(values: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of ``width`` values, by doubling."""
    if len(values) < width:
        return np.empty(0, np.uint64)
    total, total_width = None, 0
    block, block_width, power = values, 1, factor
    while True:
        if width & block_width:
            if total is None:
                total = block
            else:
                n = len(values) - total_width - block_width + 1
                total = total[:n] * power + block[total_width:total_width + n]
            total_width += block_width
        if total_width == width:
            return mixed(total)
        block = block[:len(block) - block_width] * power + block[block_width:]
        with np.errstate(over="ignore"):
            power = power * power
        block_width *= 2


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """``pick`` of every run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    done, span = values, 1
    while span * 2 <= width:
        done = pick(done[:-span], done[span:])
        span *= 2
    n = len(values) - width + 1
    return pick(done[:n], done[width - span:width - span + n])


def owners(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the parts of a concatenation: number of the part of each element, and where it ends."""
    lengths = np.asarray(lengths, np.int64)
    number = np.repeat(np.arange(len(lengths)), lengths)
    return number, np.cumsum(lengths)[number]
