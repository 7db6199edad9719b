"""Nearest neighbours by cross-polytope hashing: pseudo-rotated unit vectors belong to their nearest signed axis.

A table rotates by three rounds of random signs and a fast Hadamard transform. A vector is stored once per table, in the
bucket of its nearest signed axis (or of `hashes` rotations' axes); a query probes each table's buckets in the order of
its own coordinates. Candidates are ranked by exact distance. Buckets are cut into blocks of rows and of queries, so that
a bucket of any size is many tasks and each returns its nearest few only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm.common import written

ROWS, QUERIES = 4096, 1024
#: More probes than a table has buckets.
EVERY = 1 << 30


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, half = rows.shape[1], 1
    while half < n:
        pairs = rows.reshape(len(rows), -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), n)
        half *= 2
    return rows / np.sqrt(n)


def rotated(unit: np.ndarray, seed: int) -> np.ndarray:
    """The pseudo-rotation of that number: three times random signs and a transform, padded to a power of two."""
    wide = 1 << max(0, int(unit.shape[1] - 1).bit_length())
    rows = np.zeros((len(unit), wide))
    rows[:, :unit.shape[1]] = unit
    signs = np.random.default_rng([seed, wide]).choice([-1.0, 1.0], (3, wide))
    for s in signs:
        rows = hadamard(rows * s)
    return rows


def axes(unit: np.ndarray, seed: int) -> np.ndarray:
    """Closeness of each row to every signed axis: first the positive, then the negative ones."""
    rows = rotated(unit, seed)
    return np.concatenate([rows, -rows], axis=1)


def probes(unit: np.ndarray, table: int, hashes: int, count: int) -> np.ndarray:
    """The `count` nearest buckets of each row in one table, nearest first; count 1 is the bucket it is stored in."""
    near = axes(unit, table * hashes)
    for h in range(1, hashes):
        near = (near[:, :, None] + axes(unit, table * hashes + h)[:, None, :]).reshape(len(unit), -1)
    count = min(count, near.shape[1])
    if count == 1:
        return near.argmax(1)[:, None]
    return np.argpartition(-near, count - 1, axis=1)[:, :count]


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row places and matrix of the usable vectors, one matrix per length: not null, finite and not zero."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        place = np.flatnonzero(sizes == size)
        rows = flat[starts[place][:, None] + np.arange(size)]
        good = np.isfinite(rows).all(1) & (rows != 0).any(1)
        yield place[good], rows[good]


STORED = "vec_id long, dim int, slot int, bucket long, vec binary"


def _buckets(tables: int, hashes: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for place, rows in vectors(batch.column("embedding")):
                for i in range(0, len(rows), 1024 if hashes == 1 else 64):
                    part, own = rows[i:i + (1024 if hashes == 1 else 64)], ids[place[i:i + (1024 if hashes == 1 else 64)]]
                    unit = part / np.abs(part).max(1, keepdims=True)
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    raw = np.array([r.tobytes() for r in part], object)
                    for t in range(tables):
                        found = probes(unit, t, hashes, count)
                        each = np.repeat(np.arange(len(part)), found.shape[1])
                        n = len(each)
                        yield pa.RecordBatch.from_arrays([pa.array(own[each]), pa.array(np.full(n, rows.shape[1], np.int32)), pa.array(np.full(n, t, np.int32)),
                                                          pa.array(found.ravel().astype(np.int64)), pa.array(raw[each], pa.binary())], names=[x.split()[0] for x in STORED.split(", ")])
    return run


def nearest(query: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its k nearest rows but its own id, by exact distance, ties to the smaller id."""
    scale = (rows**2).sum(1)
    for i in range(0, len(query), 128):
        part = query[i:i + 128]
        rough = (part**2).sum(1)[:, None] + scale[None, :] - 2 * part @ rows.T
        rough[query_ids[i:i + 128, None] == ids[None, :]] = np.inf
        cut = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        cut = cut + 1e-9 * ((part**2).sum(1) + scale.max())  # the rough sums' rounding must not decide
        for j, q in enumerate(part):
            near = np.flatnonzero((rough[j] <= cut[j]) & np.isfinite(rough[j]))
            exact = np.sqrt(((rows[near] - q) ** 2).sum(1))
            order = np.lexsort((ids[near], exact))[:k]
            yield int(query_ids[i + j]), ids[near[order]], exact[order]


def _search(k: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        asked, stored = block[block.asks], block[~block.asks]
        found = []
        if len(asked) and len(stored):
            query, rows = (np.stack([np.frombuffer(v, np.float64) for v in part.vec]) for part in (asked, stored))
            for q, near, exact in nearest(query, asked.vec_id.to_numpy(), rows, stored.vec_id.to_numpy(), k):
                found.append(pd.DataFrame({"query_id": q, "vec_id": near, "score": exact}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return run


KEYS = ["dim", "slot", "bucket"]


def _met(rows: DataFrame, queries: DataFrame, k: int, tables: int, count: int, hashes: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest few of each block of rows that a query's buckets lead to."""
    stored, asked = (x.mapInArrow(_buckets(tables, hashes, n), STORED) for x, n in ((rows, 1), (queries, count)))
    # One row per bucket: at most tables x (2 x dimension) ** hashes of them.
    sizes = stored.groupBy(KEYS).agg(F.ceil(F.count("*") / ROWS).alias("row_blocks"))
    calls = asked.groupBy(KEYS).agg(F.ceil(F.count("*") / QUERIES).alias("query_blocks"))
    plan = F.broadcast(sizes.join(calls, KEYS))

    def dealt(side: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).alias(f"{own}_id")
        return (side.join(plan, KEYS).select(*KEYS, "vec_id", "vec", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(f"{other}_id"))
                .select(*KEYS, "row_blocks_id", "query_blocks_id", "vec_id", "vec", F.lit(asks).alias("asks")))
    met = dealt(stored, "row_blocks", "query_blocks", False).union(dealt(asked, "query_blocks", "row_blocks", True))
    found = met.groupBy(*KEYS, "row_blocks_id", "query_blocks_id").applyInPandas(_search(k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def search(vectors_: DataFrame, queries: DataFrame, k: int = 10, tables: int = 4, count: int = 24, hashes: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors_ found for each of queries, both (vec_id, embedding).

    Score is the Euclidean distance in double precision, ties go to the smaller vec_id, a query's own id is no candidate.
    Every vector is stored in `tables` tables and every query probes `count` buckets of each; a query that meets fewer than
    k candidates there probes every bucket of one table, so it gets all candidates where there are fewer. Vectors that are
    null or zero, or hold null or non-finite components, and rows without an id take no part; vectors of different lengths
    never meet. Rows of one vec_id count as one candidate, at its nearest vector, and as one query.
    """
    clean, asked = [x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
                    for x in (vectors_, queries)]
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    first = _met(clean, asked, k, tables, count, hashes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = written(first, "nearest")
    enough = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(enough, "vec_id", "left_anti")
    rest = _met(clean, short, k, 1, EVERY, 1).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kept = first.join(enough.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    return kept.unionByName(rest).select("query_id", "rank", "vec_id", "score")
