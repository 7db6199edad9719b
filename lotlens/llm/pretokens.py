"""Splitting of many texts into pre-tokens at once, as the byte-level pattern of the public rank files does.

The pattern (a fixed value): 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from lotlens.llm.common import code_points, ragged

SPACE, LETTER, NUMBER, OTHER = range(4)
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    major = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(x))[0], OTHER) for x in range(sys.maxunicode + 1)], np.uint8)
    major[WHITE_SPACE] = SPACE
    return major


def split(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which the pre-tokens begin (one more at the end), and the number of pre-tokens before each row."""
    points, rows = code_points(data, starts)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(starts), np.int64)
    kind = kinds()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[rows[:-1][rows[:-1] < n]] = True
    fresh[n] = True
    change = fresh.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    begins = change.copy()
    after = np.flatnonzero(change[:n] & ~fresh[:n])
    after = after[kind[after - 1] == SPACE]          # first character after white space of the same text
    begins[after - 1] = True                         # the last white space stands apart,
    begins[after[points[after - 1] == 0x20]] = False  # and a blank belongs to what follows
    quote = np.flatnonzero((points == 0x27) & begins[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~fresh[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        padded = np.append(points, [0, 0]).astype(np.uint32)
        one, two = padded[quote + 1], padded[quote + 2]
        whole = ~fresh[np.minimum(quote + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = whole & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        begins[quote[short | long] + 1] = False
        begins[np.minimum(quote[short] + 2, n)] = True
        begins[quote[long] + 2] = False
        begins[np.minimum(quote[long] + 3, n)] = True
    at = np.flatnonzero(begins)
    before = np.zeros(n + 1, np.int64)
    np.cumsum(begins[:n], out=before[1:])
    if n != len(data):
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[at]
    return at, before[rows]


def distinct(data: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pre-tokens and, for each pre-token, its place among them."""
    pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


class Coder:
    """Ids of whole texts; each distinct pre-token is encoded once while a memory of bounded size holds it.

    The memory has two generations of ``room`` pre-tokens at most: when the younger one is full it becomes the older one,
    and what is used again comes back from there, so frequent pre-tokens stay. encode() gives the ids of each of a list of
    new pre-tokens, as the bytes of 32-bit numbers.
    """

    def __init__(self, encode, room: int = 400_000):
        self.encode, self.room, self.known, self.older = encode, room, {}, {}

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and the number of ids before each row."""
        at, rows = split(data, starts)
        if len(at) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        pieces, which = distinct(data, at)
        if len(self.known) > self.room:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = self.older.get(pieces[i])
        new = [i for i in missing if found[i] is None]
        for i, got in zip(new, self.encode([pieces[i] for i in new]) if new else [], strict=True):
            found[i] = got
        for i in missing:
            self.known[pieces[i]] = found[i]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first, each = np.frombuffer(b"".join(found), np.uint32), np.cumsum(lengths) - lengths, lengths[which]
        before = np.zeros(len(which) + 1, np.int64)
        np.cumsum(each, out=before[1:])
        return flat[ragged(first[which], each)], before[rows]
