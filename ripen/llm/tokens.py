"""Token ids of whole texts by a public tokenizer file, with a cache of pieces."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

PIECES_KEPT = 150_000
MISSES_AT_ONCE = 20_000
TEXTS_AT_ONCE = 1_000
#: Where none of these occurs, white space is blanks and line feeds, none beside another but line feeds.
_BESIDE_BLANKS = ("  ", " \n", "\n ")
_RARE_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE_SPACE = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))
_SIGNS = ".,;:!?"

#: Latin letters, digits, signs but the apostrophe, and single line feeds within: here the byte-level
#: pattern cuts at changes of class only, so that the tokenizer's model can be asked directly.
_PLAIN = re.compile(r"(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n(?=\S))+")
_CLASSES = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|\n|[!-&(-/:-@\[-`{-~]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts as the tokenizer does, piece by piece.

    A byte-level tokenizer never joins what stands before a blank to what starts with it, when characters
    other than white space stand on both sides.  Texts are cut there, and every distinct piece is encoded
    once per worker for as long as a cache holds it.  The cache has two generations of ``PIECES_KEPT``
    pieces: a full one becomes the old one, from which pieces that are met again are taken over.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        shown = _byte_characters()
        self.blank = shown[32]
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0x250)}
        self.signs = {c: b"".join(self.packed[t.id] for t in self.model.tokenize(c)) for c in _SIGNS}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text, cut before safe blanks; pieces but the first stand without their blank."""
        parts = text.split(" ")
        if len(parts) == 1:
            return parts
        rare = _RARE_SPACE if text.isascii() else _RARE_SPACE + _WIDE_SPACE
        if parts[0] and parts[-1] and not parts[0][0].isspace() and not any(x in text for x in (*_BESIDE_BLANKS, *rare)):
            return parts
        out = [parts[0]]
        for part in parts[1:]:
            last = out[-1]
            # No cut beside white space: at its ends a run of it is encoded by what follows.
            if part and last and not part[0].isspace() and not last[-1].isspace():
                out.append(part)
            else:
                out[-1] = f"{last} {part}"
        return out

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > PIECES_KEPT:
            self.old, self.known = self.known, {}
        new = []
        for piece in pieces:
            found = self.old.get(piece)
            if found is None:
                new.append(piece)
            else:
                self.known[piece] = found
        other, ids, tokenize, known = [], self.packed, self.model.tokenize, self.known
        for piece in new:
            # A word, or a word and a sign: letters are one class, whatever their script.
            word = piece[:-1] if piece[-1:] in _SIGNS else piece
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                found = known.get(word)
                if found is None:
                    shown = word if word.isascii() else word.translate(self.shown)
                    found = known[word] = b"".join([ids[t.id] for t in tokenize(self.blank + shown)])
                if word is not piece:
                    known[piece] = found + self.signs[piece[-1]]
            elif _PLAIN.fullmatch(piece):
                parts = _CLASSES.findall(piece)
                if not piece.isascii() or "\n" in piece:
                    parts = [p.translate(self.shown) for p in parts]
                parts[0] = self.blank + parts[0]
                self.known[piece] = b"".join([ids[t.id] for part in parts for t in tokenize(part)])
            else:
                other.append(piece)
        for first in range(0, len(other), MISSES_AT_ONCE):
            some = other[first:first + MISSES_AT_ONCE]
            found = self.tokenizer.encode_batch_fast([" " + p for p in some], add_special_tokens=False)
            for piece, encoded in zip(some, found):
                self.known[piece] = np.array(encoded.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, closed by ``end_id``; a null text is empty."""
        if len(texts) > TEXTS_AT_ONCE:
            starts = range(0, len(texts), TEXTS_AT_ONCE)
            return [ids for i in starts for ids in self.encode(texts[i:i + TEXTS_AT_ONCE], end_id)]
        end = np.array([end_id], "<u4").tobytes()
        cut = [self.pieces(t) if t else [""] for t in texts]
        firsts = self.tokenizer.encode_batch_fast([c[0] for c in cut], add_special_tokens=False)
        rest = set().union(*(c[1:] for c in cut))
        missing = rest.difference(self.known)
        if missing:
            full = len(self.known) + len(missing) > PIECES_KEPT
            self._learn(rest if full else missing)
        find = self.known.__getitem__
        return [np.array(first.ids, "<u4").tobytes() + b"".join(map(find, c[1:])) + end for first, c in zip(firsts, cut)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer; workers are used for many tasks."""
    return Encoder(path)
