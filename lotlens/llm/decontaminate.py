"""Benchmark passages in documents, up to a budget of edits: q-gram lemma in diagonal bands, then banded alignment.

A benchmark text is cut into overlapping windows. If a document holds a window with at most k edits, the two share at
least m - q + 1 - k q of the window's q-grams, on diagonals (place in the document less place in the benchmark text) that
differ by at most k; so all of them lie in one of the bands of 2 (k + 1) diagonals that begin every k + 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lotlens.llm.common import blocks, code_points, flat_text, mix, ragged, written
from lotlens.llm.langid import SortedHashes

Q = 8
FILTER_BITS = 22
NO_ID = -(1 << 63)


@cache
def plain() -> np.ndarray:
    """The lower-case letter or the digit of every code point, 0 for anything else."""
    return np.array([ord(chr(x).lower()[0]) if chr(x).isalnum() else 0 for x in range(0x110000)], np.uint32)


def normal(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case and digits, single gaps (0) between words, none at the ends; and where each row begins."""
    points, rows = code_points(data, starts)
    codes = plain()[points]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    first = rows[:-1][rows[:-1] < rows[1:]]
    keep[first] = codes[first] != 0
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    kept, rows = codes[keep], before[rows]
    last = rows[1:][rows[1:] > rows[:-1]] - 1
    last = last[kept[last] == 0]
    if len(last):
        kept = np.delete(kept, last)
        rows = rows - np.searchsorted(last, rows)
    return kept, rows


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the q-gram that begins at each place but the last q - 1."""
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(codes) - Q + 1), np.uint64)
        wide = codes.astype(np.uint64)
        for k in range(Q):
            total = total * np.uint64(0x9E3779B97F4A7C15) + wide[k:k + len(total)]
        return mix(total)


@dataclass
class Index:
    """q-grams of one block of benchmark texts and the windows to look for."""

    ids: np.ndarray
    codes: np.ndarray = None
    starts: np.ndarray = None
    windows: list[list[tuple[int, int, int, int]]] = field(default_factory=list)  # start, length, edits, q-grams asked for
    band: int = 1
    present: np.ndarray = None
    table: SortedHashes = None
    first: np.ndarray = None
    count: np.ndarray = None
    owner: np.ndarray = None
    place: np.ndarray = None

    @classmethod
    def of(cls, ids: list[int], texts: list[str], window: int, stride: int, share: float, least: int, common: int = 64) -> Index:
        codes, starts = normal(*flat_text(pa.array(texts, pa.string())))
        index = cls(np.array(ids, np.int64), codes, starts)
        grams, owner, place = [], [], []
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            own = gram_hashes(codes[a:b])
            grams.append(own)
            owner.append(np.full(len(own), i))
            place.append(np.arange(len(own)))
        grams, owner, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((grams, np.uint64), (owner, np.int64), (place, np.int64)))
        unique, which, count = np.unique(grams, return_inverse=True, return_counts=True)
        # q-grams of many places tell little: windows that are rich enough without them don't ask for them.
        frequent = count[which] > common
        needed = np.zeros(len(grams), bool)
        at = np.searchsorted(owner, np.arange(len(ids) + 1))
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            n, found = int(b - a), []
            spans = [(0, n)] if n <= window else [(s, window) for s in sorted({*range(0, n - window, stride), n - window})]
            for s, m in spans if n >= Q else ():
                k = min(int(share * m), (m - Q) // Q) if n >= least else 0
                own = slice(at[i] + s, at[i] + s + m - Q + 1)
                rare = int((~frequent[own]).sum())
                if rare - k * Q < 3:
                    needed[own], rare = True, m - Q + 1
                found.append((s, m, k, max(1, rare - k * Q)))
                index.band = max(index.band, k + 1)
            index.windows.append(found)
        kept = ~frequent | np.isin(which, which[needed])
        grams, owner, place = grams[kept], owner[kept], place[kept]
        unique, which = np.unique(grams, return_inverse=True)
        index.table = SortedHashes(unique.view(np.int64))
        rank = np.empty(len(unique), np.int64)
        rank[index.table.order] = np.arange(len(unique))
        order = np.argsort(rank[which], kind="stable") if len(which) else np.zeros(0, np.int64)
        index.owner, index.place = owner[order], place[order]
        index.count = np.bincount(rank[which], minlength=len(unique)) if len(which) else np.zeros(0, np.int64)
        index.first = np.cumsum(index.count) - index.count
        index.present = np.zeros(1 << FILTER_BITS, bool)
        index.present[(unique >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return index

    def find(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, place of the benchmark text, edits) of every benchmark text that a row of normal text holds."""
        hashes = gram_hashes(codes)
        at = np.flatnonzero(self.present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        row = np.searchsorted(starts, at, "right") - 1
        at, row = at[inside := at + Q <= starts[row + 1]], row[inside]
        found = self.table.find(hashes[at].view(np.int64))
        at, row, found = at[found >= 0], row[found >= 0], found[found >= 0]
        times = self.count[found]
        hit = ragged(self.first[found], times)
        row, owner, place = np.repeat(row, times), self.owner[hit], self.place[hit]
        least = np.array([min((w[3] for w in x), default=1 << 30) for x in self.windows])
        pair = row * len(self.ids) + owner
        if len(pair):
            size = int((len(starts) - 1) * len(self.ids))
            many = np.bincount(pair, minlength=size)[pair] if size < 1 << 22 else (lambda c, i: c[i])(*np.unique(pair, return_counts=True, return_inverse=True)[1:][::-1])
            enough = many >= least[owner]
            pair, place, diagonal = pair[enough], place[enough], (np.repeat(at, times) - starts[row] - place)[enough]
        if not len(pair):
            return []
        bands = 1 << 40
        step = diagonal // self.band + (1 << 30)
        cell = np.concatenate([pair * bands + step, pair * bands + step - 1]) if pair.max() < 1 << 22 else None
        if cell is None:
            _, small = np.unique(pair, return_inverse=True)
            names = np.unique(pair)
            cell = np.concatenate([small * bands + step, small * bands + step - 1])
        else:
            names = None
        place = np.concatenate([place, place])
        order = np.lexsort((place, cell))
        cell, place = cell[order], place[order]
        cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(cuts, len(cell)))
        pairs = cell[cuts] // bands
        pairs = pairs if names is None else names[pairs]
        asked = []
        for c in np.flatnonzero(sizes >= least[pairs % len(self.ids)]):
            r, o = divmod(int(pairs[c]), len(self.ids))
            places = np.unique(place[cuts[c]:cuts[c] + sizes[c]])
            low = (int(cell[cuts[c]] % bands) - (1 << 30)) * self.band
            for s, m, k, need in self.windows[o]:
                a, b = np.searchsorted(places, [s, s + m - Q + 1])
                if b - a >= need:
                    asked.append((m, k, r, o, s, low))
        best: dict[tuple[int, int], int] = {}
        for m, k in {x[:2] for x in asked}:
            group = [x for x in asked if x[:2] == (m, k)]
            for i in range(0, len(group), 512):
                part = group[i:i + 512]
                for x, edits in zip(part, self._edits(codes, starts, part, m, k), strict=True):
                    if edits <= k:
                        best[x[2], x[3]] = min(best.get((x[2], x[3]), edits), int(edits))
        return [(r, o, e) for (r, o), e in best.items()]

    def _edits(self, codes: np.ndarray, starts: np.ndarray, asked: list[tuple], m: int, k: int) -> np.ndarray:
        """Least edits between each window and any region on the band's diagonals and k more on either side."""
        r, o, s, low = (np.array(x) for x in list(zip(*asked, strict=True))[2:])
        pattern = self.codes[(self.starts[o] + s)[:, None] + np.arange(m)]
        width = 2 * self.band + 2 * k
        begin = low + s - k
        place = begin[:, None] + np.arange(m + width)
        size = (starts[r + 1] - starts[r])[:, None]
        text = np.where((place >= 0) & (place < size), codes[np.clip(starts[r][:, None] + place, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
        across = np.arange(width)
        cost = np.zeros((len(asked), width), np.int32)
        for i in range(m):
            cut = cost + (text[:, i:i + width] != pattern[:, i:i + 1])
            cut[:, :-1] = np.minimum(cut[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(cut - across, axis=1) + across
        return cost.min(1)


FOUND = "array<struct<item_id: bigint, edits: int>>"


def _search(text: Column, shared: Broadcast) -> Column:
    @arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        for batch in batches:
            data, starts = flat_text(batch)
            items, edits, counts = [], [], np.zeros(len(batch) + 1, np.int64)
            for a, b in blocks(starts):
                codes, rows = normal(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                for r, o, e in sorted(index.find(codes, rows), key=lambda x: (x[0], index.ids[x[1]])):
                    items.append(index.ids[o])
                    edits.append(e)
                    counts[a + r + 1] += 1
            items = np.array(items, np.int64)
            found = pa.StructArray.from_arrays([pa.array(items, mask=items == NO_ID), pa.array(np.array(edits, np.int32))], names=["item_id", "edits"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), found)
    return run(text)


def contamination(docs: DataFrame, benchmark: DataFrame, into: str, text: str = "text", window: int = 100, stride: int = 20, share: float = 0.1, least: int = 40,
                  block_bytes: int = 1 << 23) -> DataFrame:
    """docs with a column `into`: the benchmark texts (item_id, text) each document holds, and the fewest edits of a window.

    Compared are letters (in lower case) and digits, with single gaps. A benchmark text of at most `window` characters is
    one window, a longer one has one every `stride` characters; a document holds it if some region is within `share` edits
    per character of a window. With a stride of twice the edits, every verbatim excerpt of `window` characters is found,
    wherever it begins. Benchmark texts under `least` characters are looked for verbatim; those under Q characters, and
    null ones, are not. Equal benchmark texts count once, under the smallest item_id, which is null if none has one. Null
    or empty documents hold none.

    The benchmark goes to the executors in blocks of about `block_bytes` of text; with more than one block, documents are
    searched once for each and written in between.
    """
    spark = docs.sparkSession
    texts = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
             .groupBy("text").agg(F.min("item_id").alias("item_id")))
    parts = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    docs = docs.withColumn(into, F.expr(f"cast(array() as {FOUND})"))
    for part in range(parts):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()
        rows.sort(key=lambda r: (r.item_id is not None, r.item_id or 0, r.text))
        index = Index.of([NO_ID if r.item_id is None else r.item_id for r in rows], [r.text for r in rows], window, stride, share, least)
        docs = docs.withColumn(into, F.concat(into, _search(F.col(text), spark.sparkContext.broadcast(index))) if part else _search(F.col(text), spark.sparkContext.broadcast(index)))
        if part + 1 < parts:
            docs = written(docs, "searched")
    return docs
