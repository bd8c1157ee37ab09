"""Encoding by pieces: a text is cut where no token can reach across, and each distinct piece is encoded once."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np


class PieceEncoder:
    """Token ids of texts as bytes of little-endian integers.

    ``split`` cuts a text into pieces whose encodings, joined, are the encoding of the text.
    ``encode`` turns a list of distinct pieces into lists of ids. Known pieces are kept up to
    ``most`` of them or ``room`` bytes; then the table starts again, so that memory is bounded.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], Iterable[list[int]]], dtype: str, most: int = 1_200_000, room: int = 64 << 20):
        self.split, self.encode, self.dtype, self.most, self.room = split, encode, np.dtype(dtype), most, room
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > self.most or self.held > self.room:
            self.forget()
        code = "H" if self.dtype.itemsize == 2 else "I"
        new = [p for p in pieces if p not in self.known]
        for begin in range(0, len(new), 20_000):
            part = new[begin : begin + 20_000]
            for piece, ids in zip(part, self.encode(part), strict=True):
                self.known[piece] = array(code, ids).tobytes()
                self.held += len(piece) + len(self.known[piece])

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        seen: set[str] = set()
        for pieces in cut:
            seen.update(pieces)
        self.learn(seen)
        find = self.known.__getitem__
        return [b"".join(map(find, pieces)) for pieces in cut]


UNEVEN_SPACE = re.compile(r"[ \n](?=\s|\Z)")
BEFORE_WORD = re.compile(r"(?= \S)")


def byte_level_pieces(text: str) -> list[str]:
    """Cuts for the byte-level pattern: before a blank that a word follows, and around a lone line feed.

    The pattern takes such a blank together with the word behind it and never looks back, so what
    follows the cut is split as if it began there. A run of white space of another kind stays with
    what precedes it.
    """
    if not text:
        return []
    if "\0" in text or text[0] in " \n" or UNEVEN_SPACE.search(text):
        return [p for p in BEFORE_WORD.split(text) if p]
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
