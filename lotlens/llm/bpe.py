"""Byte-level BPE in two tiers: whole pre-tokens through a minimal perfect hash, the others by merging linked bytes."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from lotlens.llm.common import blocks, bytes_of, flat_text, mix, piece_hashes, ragged
from lotlens.llm.pretokens import Coder


class PerfectHash:
    """Each of n distinct keys has a slot of its own in 0..n-1: hash, displace, and single keys placed directly."""

    def __init__(self, hashes: np.ndarray, load: int = 4):
        n = self.n = len(hashes)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys have the same 64-bit hash")
        self.buckets = max(1, n // load)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        firsts = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        tries = np.arange(1, 65)
        for b in np.argsort(-sizes, kind="stable"):
            keys = hashes[order[firsts[b]:firsts[b] + sizes[b]]]
            if len(keys) < 2:
                break
            base = 0
            while True:
                slots = np.sort(self._slot(keys[None, :], (base + tries)[:, None]), axis=1)
                fits = ~taken[slots].any(1) & (slots[:, 1:] != slots[:, :-1]).all(1)
                if fits.any():
                    self.shift[b] = base + tries[fits.argmax()]
                    taken[slots[fits.argmax()]] = True
                    break
                base += len(tries)
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = -1 - np.flatnonzero(~taken)[:len(single)]

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; for any other hash some slot, whose key the caller compares."""
        shift = self.shift[self._bucket(hashes)]
        return np.where(shift < 0, -1 - shift, self._slot(hashes, shift))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked adjacent pair, the leftmost of equals, over a linked list of parts.

    A heap entry is rank * (length + 1) + place; it is stale if the pair at that place has another rank by now.
    """
    n = len(piece)
    m, rank = n + 1, ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    best = [rank(piece[i:i + 2], -1) for i in range(n - 1)]
    heap = [r * m + i for i, r in enumerate(best) if r >= 0]
    best += (-1, -1)
    heapify(heap)
    while heap:
        r, i = divmod(heappop(heap), m)
        if best[i] != r:
            continue
        j = after[i]
        k = after[i] = after[j]
        before[k], best[j] = i, -1
        if k < n:
            best[i] = r = rank(piece[i:after[k]], -1)
            if r >= 0:
                heappush(heap, r * m + i)
        else:
            best[i] = -1
        p = before[i]
        if p >= 0:
            best[p] = r = rank(piece[p:k], -1)
            if r >= 0:
                heappush(heap, r * m + p)
    ids, i = [], 0
    while i < n:
        j = after[i]
        ids.append(ranks[piece[i:j]])
        i = j
    return ids


class BytePairs:
    """A rank file's vocabulary: encode() of many texts, decode() of many rows of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        words = list(self.ranks)
        hashes = piece_hashes(*bytes_of(words))
        self.hash = PerfectHash(hashes)
        self.words = np.empty(len(words), object)
        self.words[self.hash.slots(hashes)] = words
        self.whole = [np.uint32(self.ranks[w]).tobytes() for w in self.words]
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            by_id[rank] = word
        self.text, self.text_at, ends = bytes_of(by_id)
        self.text_size = ends - self.text_at
        self.digits, self.digits_at, ends = bytes_of([b"%d," % i for i in range(len(by_id))])
        self.digits_size = ends - self.digits_at
        self.coder = Coder(self._new, room=100_000)

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        slots = self.hash.slots(piece_hashes(*bytes_of(pieces)))
        words = self.words[slots]
        return [self.whole[s] if w == p else array("I", merge(p, self.ranks)).tobytes() for s, w, p in zip(slots, words, pieces, strict=True)]

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.coder.ids(data, starts)

    def _spelled(self, ids: np.ndarray, rows: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size[ids], out=before[1:])
        return text[ragged(at[ids], size[ids])].tobytes(), before[rows]

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all rows of ids, and where each row's begin."""
        return self._spelled(ids, rows, self.text, self.text_at, self.text_size)

    def decimals(self, ids: np.ndarray, rows: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Each id in decimal and a comma after it."""
        return self._spelled(ids, rows, self.digits, self.digits_at, self.digits_size)


@cache
def byte_pairs(path: str) -> BytePairs:
    """One vocabulary for each Python worker."""
    return BytePairs(path)


def encode_ids(text: Column, path: str) -> Column:
    """Ids of each whole text as an array; null text has none, as has an empty one.

    Each match of the pattern in pretokens is encoded separately, special tokens are plain text. `path` names a rank
    file that every executor has.
    """
    @arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = byte_pairs(path)
        for batch in batches:
            data, starts = flat_text(batch)
            parts, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for a, b in blocks(starts):
                ids, rows = model.encode(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                parts.append(ids.astype(np.int32))
                ends.append(rows[1:] + ends[-1][-1])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(parts)))
    return run(text)


def decode_ids(ids: Column, path: str) -> Column:
    """The bytes that each array of ids stands for (they need not be valid UTF-8); null for null."""
    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = byte_pairs(path)
        for batch in batches:
            yield pa.array([None if x is None else b"".join(model.text[model.text_at[i]:model.text_at[i] + model.text_size[i]].tobytes() for i in x)
                            for x in batch.to_pylist()], pa.binary())
    return run(ids)


CODED = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


def coded(text: Column, path: str) -> Column:
    """Encodes each whole text, decodes the ids again, and keeps their number and digests only.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the decoded bytes. Null text counts as
    empty: no ids, both digests those of no bytes. Repeated rows get equal results.
    """
    @arrow_udf(CODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = byte_pairs(path)
        for batch in batches:
            data, starts = flat_text(batch)
            counts, listed, decoded = [], [], []
            for a, b in blocks(starts):
                ids, rows = model.encode(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                counts.append(np.diff(rows))
                flat, at = model.decimals(ids, rows)
                listed += [hashlib.sha256(flat[i:max(i, j - 1)]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
                flat, at = model.decode(ids, rows)
                decoded += [hashlib.sha256(flat[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                                             names=["n_tokens", "ids_sha256", "decoded_sha256"])
    return run(text)
