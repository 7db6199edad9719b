"""Hard negatives by exact integer scores from Kronecker-packed products.

Components are whole numbers. Biased to be non-negative, a component of several candidates sits in separate fields of one
wide integer; one multiplication by the anchor's biased component multiplies all of them, the sum over components keeps
every field below its width, and unpacking less the biases' share gives exact scores. The wide integer is a 53-bit whole
number held in a double, whose matrix products are the fastest exact ones; values too large for that go through wide
Python integers, packed alike.

Anchors meet rows in blocks of bounded size, so a label or a table of any size is many tasks: first the anchor's own label
for its positives, then all rows for the negatives. A block returns its best few for each anchor only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, ANCHORS, STRIP = 4096, 1024, 128
#: Bits of the whole numbers that a double holds exactly.
EXACT = 53
WIDE_STRIP = 256


def components(vectors: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where some are too large for exact products."""
    scaled = np.floor(vectors * float(scale)) if vectors.size and np.abs(vectors).max() < 2.0**52 / scale else None
    if scaled is not None or not vectors.size:
        return (vectors if scaled is None else scaled).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def _unbias(product: np.ndarray, anchors: np.ndarray, rows: np.ndarray, low_a: int, low_r: int) -> np.ndarray:
    """Sums of a * c from sums of (a - low_a) * (c - low_r)."""
    return product + low_r * anchors.sum(1)[:, None] + low_a * rows.sum(1)[None, :] - anchors.shape[1] * low_a * low_r


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all rows, both matrices of whole numbers; beyond 64 bits the nearest such number."""
    n, d = len(rows), anchors.shape[1]
    if not d or not n or not len(anchors):
        return np.zeros((len(anchors), n), np.int64)
    low_a, low_r = min(0, int(anchors.min())), min(0, int(rows.min()))
    high_a, high_r = int(anchors.max()) - low_a, int(rows.max()) - low_r
    width = max(1, (d * high_a * high_r).bit_length())
    if width > EXACT or anchors.dtype == object or rows.dtype == object:
        return _wide(anchors, rows, low_a, low_r, width)
    fields = EXACT // width
    count = -(-n // fields)
    biased = np.zeros((fields, count, d), np.int64)
    biased.reshape(fields * count, d)[:n] = rows - low_r
    packed = sum(biased[f] << (f * width) for f in range(fields)).astype(np.float64)
    product = ((anchors - low_a).astype(np.float64) @ packed.T).astype(np.int64)
    mask = (1 << width) - 1
    return _unbias(np.concatenate([(product >> (f * width)) & mask for f in range(fields)], axis=1)[:, :n], anchors, rows, low_a, low_r)


def _wide(anchors: np.ndarray, rows: np.ndarray, low_a: int, low_r: int, width: int) -> np.ndarray:
    """The same with Python integers: one holds a component of up to WIDE_STRIP rows."""
    size = -(-width // 8)
    out = np.zeros((len(anchors), len(rows)), object)
    factors = [[int(x) - low_a for x in row] for row in anchors]
    for i in range(0, len(rows), WIDE_STRIP):
        part = rows[i:i + WIDE_STRIP]
        packed = [int.from_bytes(b"".join((int(x) - low_r).to_bytes(size, "little") for x in column), "little") for column in part.T]
        for j, row in enumerate(factors):
            whole = sum(a * p for a, p in zip(row, packed, strict=True)).to_bytes(size * len(part), "little")
            out[j, i:i + len(part)] = [int.from_bytes(whole[k * size:(k + 1) * size], "little") for k in range(len(part))]
    out = _unbias(out, anchors.astype(object), rows.astype(object), low_a, low_r)
    return np.array([max(-2**63, min(2**63 - 1, int(v))) for v in out.ravel()], np.int64).reshape(out.shape)


def _largest(score: np.ndarray) -> int:
    return max(abs(int(score.min())), abs(int(score.max()))) if score.size else 0


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row of score the places of its k highest allowed entries, highest first, equal ones in order of place."""
    n = score.shape[1]
    if n > k and _largest(score) < 2**62 // n - n:
        order = np.where(allowed, score * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
        top = np.argpartition(order, n - k, axis=1)[:, n - k:]
        value = np.take_along_axis(order, top, 1)
        top = np.take_along_axis(top, np.argsort(-value, axis=1), 1)
        return [t[row[t]] for t, row in zip(top, allowed, strict=True)]
    return [np.array(sorted(np.flatnonzero(a), key=lambda j, s=s: (-int(s[j]), j))[:k], np.int64) for s, a in zip(score, allowed, strict=True)]


def _block(block: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray]:
    asked, stored = (part.sort_values("vec_id") for part in (block[block.asks], block[~block.asks]))
    a, r = (components(np.stack(part.vec.tolist()).astype(np.float64)) if len(part) else np.zeros((0, 0), np.int64) for part in (asked, stored))
    return asked, a, stored, r


def _strips(asked: pd.DataFrame, a: np.ndarray, r: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    if len(asked) and len(r):
        for i in range(0, len(asked), STRIP):
            yield asked.iloc[i:i + STRIP], scores(a[i:i + STRIP], r)


POSITIVES = "anchor_id long, vec_id long, score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _frame(found: list[tuple], schema: str) -> pd.DataFrame:
    """Rows of (values that repeat..., ids, scores), one tuple per list of ids."""
    names = [c.split()[0] for c in schema.split(", ")]
    times = [len(f[-1]) for f in found]
    columns = [np.repeat(np.array([f[i] for f in found], np.int64), times) for i in range(len(names) - 2)]
    columns += [np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (-2, -1)]
    return pd.DataFrame(dict(zip(names, columns, strict=True)))


def _positives(k: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        asked, a, stored, r = _block(block)
        ids, found = stored.vec_id.to_numpy(), []
        for part, score in _strips(asked, a, r):
            own = part.vec_id.to_numpy()
            tops = best(score, own[:, None] != ids[None, :], k)
            found.extend((anchor, ids[top], s[top]) for anchor, s, top in zip(own, score, tops, strict=True))
        return _frame(found, POSITIVES)
    return run


def _negatives(k: int, low: int, high: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        asked, a, stored, r = _block(block)
        ids, labels, found = stored.vec_id.to_numpy(), stored.label.to_numpy(), []
        for part, score in _strips(asked, a, r):
            other = part.label.to_numpy()[:, None] != labels[None, :]
            largest = max([_largest(score), *(abs(p["score"]) for ps in part.positives for p in ps)])
            kind = np.int64 if largest < 2**55 else object  # a hundred times a score must fit
            for slot in range(max(map(len, part.positives), default=0)):
                has = np.array([len(p) > slot for p in part.positives])
                positive = [p[slot] for p in part.positives[has]]
                limit, here = np.array([int(p["score"]) for p in positive], kind)[:, None], score[has]
                hundred = 100 * here.astype(kind)
                fits = other[has] & (low * limit <= hundred).astype(bool) & (hundred <= high * limit).astype(bool)
                for anchor, p, s, top in zip(part.vec_id[has], positive, here, best(here, fits, k), strict=True):
                    if len(top):
                        found.append((anchor, p["vec_id"], p["score"], ids[top], s[top]))
        return _frame(found, NEGATIVES)
    return run


def _met(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and askers of equal keys, dealt to blocks of at most about ROWS and ANCHORS of them."""
    sizes = rows.groupBy(keys).agg(F.ceil(F.count("*") / ROWS).alias("row_blocks"))
    calls = asked.groupBy(keys).agg(F.ceil(F.count("*") / ANCHORS).alias("anchor_blocks"))
    plan = sizes.join(calls, keys)

    def dealt(side: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        return (side.join(plan, keys).withColumn(f"{own}_id", F.pmod(F.xxhash64("vec_id"), F.col(own)))
                .withColumn(f"{other}_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).withColumn("asks", F.lit(asks)).drop(own, other))
    return dealt(rows, "row_blocks", "anchor_blocks", False).unionByName(dealt(asked, "anchor_blocks", "row_blocks", True), allowMissingColumns=True)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, embedding).

    anchors holds vec_ids. A score is the inner product of the vectors' components floor(256 x), exact. An anchor's
    positives are its `positives` best other rows of its label; for each, the `negatives` best rows of another label with
    low * positive score <= 100 * negative score <= high * positive score; ties go to the smaller vec_id. Rows with a null
    vec_id, label or vector, or a null or non-finite component, take no part; of several rows with one vec_id the one of
    smallest (label, vector) counts. Vectors of different lengths never meet. A score beyond 64 bits counts as the nearest
    64-bit number. Anchors without positives, and positives without fitting negatives, have no row.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    rows = rows.where("vec_id is not null and label is not null and vec is not null").where(finite)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.*", F.size("x.vec").alias("dim"))
    asked = rows.join(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    # As many tasks as a shuffle has: the work goes by pairs, which the size of the rows doesn't tell.
    tasks, keys = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["dim", "label", "row_blocks_id", "anchor_blocks_id"]
    found = _met(rows, asked, keys[:2]).repartition(tasks, *keys).groupBy(keys).applyInPandas(_positives(positives), POSITIVES)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    chosen = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))  # `positives` of them at most
    asked = asked.join(chosen, asked.vec_id == chosen.anchor_id).drop("anchor_id")
    keys.remove("label")
    found = _met(rows, asked, keys[:1]).repartition(tasks, *keys).groupBy(keys).applyInPandas(_negatives(negatives, low, high), NEGATIVES)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
