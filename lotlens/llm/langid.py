"""Language identification: interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lotlens.llm.common import blocks, code_points, flat_text, mix, written

ORDER = 5
#: Bits of a character in a packed n-gram; rarer code points share the upper half of the codes.
BITS = 12
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """The code of every code point: of its lower-case letter, or 0 (a gap) for anything that is no letter."""
    codes = np.zeros(0x110000, np.uint16)
    half = 1 << (BITS - 1)
    for x in range(0x110000):
        c = chr(x)
        if c.isalpha():
            y = ord(c.lower()[0])
            codes[x] = y if y < half else half + (y * 2654435761 >> 7) % half
    return codes


def grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the highest order, one per letter or gap, and the number before each row.

    Everything that is no letter counts as a gap; runs of gaps are one, and each row begins as after a long gap.
    """
    points, rows = code_points(data, starts)
    codes = letters()[points]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    first = rows[:-1][rows[:-1] < rows[1:]]
    keep[first] = codes[first] != 0
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    kept, rows = codes[keep].astype(np.int64), before[rows]
    padded = np.zeros(len(kept) + (ORDER - 1) * (len(rows) - 1), np.int64)
    place = np.arange(len(kept)) + np.repeat((ORDER - 1) * np.arange(1, len(rows)), np.diff(rows))
    padded[place] = kept
    packed = kept.copy()
    for back in range(1, ORDER):
        packed |= padded[place - back] << (BITS * back)
    return packed, rows


def low(packed: np.ndarray, order: int) -> np.ndarray:
    return packed & ((1 << (BITS * order)) - 1)


class SortedHashes:
    """Places of packed n-grams in an array sorted by their hash; the hash's first bits say where to begin."""

    def __init__(self, packed: np.ndarray):
        hashes = mix(packed)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        bits = max(1, int(len(packed)).bit_length())
        self.drop = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.drop).astype(np.int32)
        counts = np.diff(np.append(self.begin, len(hashes)))
        self.deepest = int(counts.max()) if len(hashes) else 0

    def find(self, packed: np.ndarray) -> np.ndarray:
        """The place of each n-gram, -1 for one that isn't there."""
        found = np.full(len(packed), -1, np.int64)
        if not len(self.hashes):
            return found
        hashes = mix(packed)
        at = self.begin[(hashes >> self.drop).astype(np.int64)].astype(np.int64)
        left = np.arange(len(packed))
        for step in range(self.deepest):
            place = at[left] + step
            there = self.hashes[np.minimum(place, len(self.hashes) - 1)]
            same = there == hashes[left]
            found[left[same]] = place[same]
            left = left[~same & (there < hashes[left]) & (place < len(self.hashes) - 1)]
            if not len(left):
                break
        return found


@dataclass
class Model:
    """Tables over the n-grams of all languages together: a row per n-gram or context, a column per language."""

    langs: list[str]
    base: np.ndarray = None  # log2 probability of an unseen letter
    limit: np.ndarray = None  # cross-entropy above which a text is rejected
    keys: list[SortedHashes] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    contexts: list[SortedHashes] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def log2(self, packed: np.ndarray) -> np.ndarray:
        """log2 of the interpolated probability of each n-gram's last letter, by language."""
        total = np.zeros((len(packed), len(self.langs)), np.float32)
        left = np.arange(len(packed))
        for order in range(ORDER, 0, -1):
            there = low(packed[left], order)
            place = self.keys[order - 1].find(there)
            hit = place >= 0
            total[left[hit]] += self.values[order - 1][place[hit]]
            left, there = left[~hit], there[~hit]
            if not len(left):
                return total
            context = self.contexts[order - 1].find(there >> BITS)
            known = context >= 0
            total[left[known]] += self.weights[order - 1][context[known]]
        total[left] += self.base
        return total

    def entropies(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per letter of each row under each language, and the number of letters and gaps scored."""
        packed, rows = grams(data, starts)
        n = np.diff(rows)
        sums = np.zeros((len(n), len(self.langs)))
        at, some = 0, np.flatnonzero(n)
        for a, b in blocks(rows, 1 << 18):
            part = self.log2(packed[rows[a]:rows[b]])
            here = some[(some >= a) & (some < b)]
            if len(here):
                sums[here] = np.add.reduceat(part, rows[here] - rows[a], axis=0, dtype=np.float64)
        return -sums / np.maximum(n, 1)[:, None], n


def fit(langs: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Kneser-Ney tables from each language's n-grams of the highest order and their counts.

    Lower orders count the distinct letters seen before; each order has one discount, n1 / (n1 + 2 n2).
    """
    model = Model(langs)
    own = []
    for lang in langs:
        packed, count = counted[lang]
        levels = [None] * ORDER
        levels[-1] = (packed, count.astype(np.float64))
        for order in range(ORDER - 1, 0, -1):
            levels[order - 1] = tuple(x.astype(t) for x, t in zip(np.unique(low(levels[order][0], order), return_counts=True), (np.int64, np.float64), strict=True))
        own.append(levels)
    alphabet = len(np.unique(np.concatenate([levels[0][0] for levels in own]))) + 1
    lower = np.full((1, len(langs)), 1.0 / alphabet)
    lower_keys = None
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([levels[order - 1][0] for levels in own]))
        heads = np.unique(union >> BITS)
        head_of, below = np.searchsorted(heads, union >> BITS), np.zeros(len(union), np.int64) if lower_keys is None else np.searchsorted(lower_keys, low(union, order - 1))
        level = np.empty((len(union), len(langs)))
        rest = np.ones((len(heads), len(langs)))
        for k, levels in enumerate(own):  # a language at a time: the driver holds one table of this order, not its parts
            packed, count = levels[order - 1]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            head = np.searchsorted(heads, packed >> BITS)
            total = np.bincount(head, count, len(heads))
            kinds = np.bincount(head, minlength=len(heads))
            some = total > 0
            rest[some, k] = discount * kinds[some] / total[some]
            column = rest[head_of, k] * lower[below, k]
            column[np.searchsorted(union, packed)] += np.maximum(count - discount, 0) / total[head]
            level[:, k] = column
        for hashes, tables, keys, rows in ((model.keys, model.values, union, level), (model.contexts, model.weights, heads, rest)):
            hashes.append(SortedHashes(keys))
            tables.append(np.empty(rows.shape, np.float32))
            for k in range(len(langs)):
                tables[-1][:, k] = np.log2(rows[hashes[-1].order, k])
            hashes[-1].order = None  # the tables have that order now
        lower, lower_keys = level, union
    model.base = np.full(len(langs), np.log2(1.0 / alphabet), np.float32)
    model.limit = np.full(len(langs), np.inf)
    return model


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, held = batch.column("lang"), batch.column("held")
        for lang, back in ((x, y) for x in names.unique().to_pylist() for y in (False, True)):
            texts = batch.column("text").filter(pc.and_(pc.equal(names, lang), pc.equal(held, back)))
            data, starts = flat_text(texts)
            for a, b in blocks(starts):
                packed, _ = grams(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                found, count = np.unique(packed, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([back] * len(found), pa.bool_()), pa.array(found), pa.array(count)],
                                                 names=["lang", "held", "gram", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams and counts of a batch as one row of bytes per language: the driver gets no row per n-gram."""
    for batch in batches:
        for lang in batch.column("lang").unique().to_pylist():
            own = batch.filter(pc.equal(batch.column("lang"), lang))
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *[pa.array([own.column(c).to_numpy().tobytes()], pa.binary()) for c in ("gram", "n", "taught")]],
                                             names=["lang", "gram", "n", "taught"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_bytes: int = 4_000_000, check_bytes: int = 1_000_000,
          keep: float = 0.999, slack: float = 1.0, few: int = 100) -> Model:
    """Fits the models on whole texts, about `sample_bytes` of each language, drawn by a hash of the text; equal texts count once.

    Sampling by a share of each language's bytes bounds the model (distinct n-grams of the sample) at any input size.
    `check_bytes` more, or the same share of a language with less, calibrate rejection by models of the others: a text is
    rejected if its bits per letter exceed the `keep` quantile of its language's own texts by more than `slack`, and by
    more the shorter it is. A language with under `few` texts to calibrate on takes the quantile over all languages
    where that is higher; where no text could be held back at all, a text must do better than letters drawn evenly. The final
    model of a language drawn whole counts the held texts too. Rows without text or language teach nothing; without any
    letter, the model knows no language.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").withColumn("mark", F.xxhash64("text"))
    once = rows.groupBy("lang", "mark").agg(F.max(F.octet_length("text")).alias("bytes"))
    sizes = {r.lang: r.bytes for r in once.groupBy("lang").agg(F.sum("bytes").alias("bytes")).collect() if r.bytes}
    if not sizes:
        return Model([])
    whole = sample_bytes + check_bytes
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, whole / v)])[F.col("lang")]
    # Copies of a text have one mark and lie in one draw: once drawn, one of them stays.
    drawn = (rows.where(F.pmod("mark", F.lit(1 << 52)) / float(1 << 52) < share).dropDuplicates(["lang", "mark"])
             .withColumn("held", F.pmod(F.xxhash64("mark"), F.lit(whole)) < check_bytes))
    drawn = written(drawn, "drawn")
    entire = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, v <= whole)])[F.col("lang")]
    counted = (drawn.where(~F.col("held") | entire).select("lang", "held", "text").mapInArrow(_counts, "lang string, held boolean, gram bigint, n bigint")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("taught"))
               .mapInArrow(_packed, "lang string, gram binary, n binary, taught binary").collect())
    if not counted:
        return Model([])
    taught, every = {}, {}
    for k in {r.lang for r in counted}:
        gram, n, kept = (np.concatenate([np.frombuffer(r[c], np.int64) for r in counted if r.lang == k]) for c in ("gram", "n", "taught"))
        order = np.argsort(gram)
        gram, n, kept = gram[order], n[order], kept[order]
        every[k] = gram, n
        taught[k] = (gram[kept > 0], kept[kept > 0]) if kept.any() else every[k]
    del counted, gram, n, kept, order
    model = fit(sorted(taught), taught)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = drawn.where("held").select("lang", _scored(F.col("text"), shared).alias("s")).select("lang", "s.*").where("lang = lang_pred")
    checked = scored.rollup("lang").agg(F.percentile_approx("bits", keep, 10000).alias("bits"), F.count("*").alias("n")).where("n > 0").collect()
    shared.unpersist()
    limits = {r.lang: r for r in checked}
    if any((taught[k][1].sum() != every[k][1].sum()) for k in every):
        model = fit(sorted(every), every)
    for i, k in enumerate(model.langs):
        own = [limits[x].bits for x in (k, None) if x in limits and (x == k or k not in limits or limits[k].n < few)]
        model.limit[i] = max(own) + slack if own else -model.base[i]
    return model


RESULT = "struct<lang_pred: string, score: double, bits: double, rejected: boolean>"


def _scored(text: Column, shared: Broadcast) -> Column:
    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            data, starts = flat_text(batch)
            parts = [model.entropies(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a]) for a, b in blocks(starts)] if model.langs else []
            n = np.concatenate([x[1] for x in parts]) if parts else np.zeros(len(batch), np.int64)
            bits = np.concatenate([x[0] for x in parts]) if parts else np.zeros((len(batch), 1))
            best = bits.argmin(1) if len(bits) else np.zeros(0, np.int64)
            least = bits[np.arange(len(bits)), best]
            odds = 1 / np.exp2(-(bits - least[:, None]) * np.minimum(n, 20)[:, None]).sum(1) if len(bits) else np.zeros(0)
            known = n > 0
            limit = (model.limit[best] if model.langs else np.zeros(len(n))) + 4 / np.sqrt(np.maximum(n, 1))
            names = np.array([*model.langs, UNKNOWN], object)[np.where(known, best, len(model.langs))]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.where(known, odds, 0.0)), pa.array(np.where(known, least, 0.0)), pa.array(~known | (least > limit))],
                names=["lang_pred", "score", "bits", "rejected"])
    return run(text)


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The language with the lowest cross-entropy per letter, as a struct column of `docs`.

    `score` is that language's share of the likelihoods over at most 20 letters; `bits` the cross-entropy. Null text and
    text without a letter are `und` with score 0 and rejected, as is every text if the model knows no language. Equal
    entropies go to the alphabetically first language. Texts whose bits exceed the calibrated limit are rejected but
    keep their language.
    """
    return _scored(F.col(text), docs.sparkSession.sparkContext.broadcast(model))
