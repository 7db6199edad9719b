"""Documents linked by the Jaccard similarity of their word n-gram sets: a blocked sparse product of document by n-gram.

1. Texts with the same set are one node; from here on only nodes are compared.
2. By size bounds two linked nodes share k of the first n - ceil(t n) + k n-grams of each set, in any fixed order and for
   any k; k grows with n. The order puts common n-grams last, as counted over all documents in a hashed counter array of
   fixed size. A node with fewer than k shared n-grams there (k of its smallest possible partner) is linked with none.
3. Every shared n-gram names a leader, its node with the smallest id, and every node follows the smallest leader of its
   n-grams. Nodes of one leader and similar size form blocks of bounded weight: near copies meet in few blocks.
4. Only block pairs that share an n-gram are multiplied. A product accumulates overlap counts of all its pairs in one
   small matrix, drops those below the bound and returns a row per node: its root within the product and its number of
   links. No pair of documents is ever a row.
5. Roots are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import blocks, flat_text, mix, piece_hashes, written

COUNTERS, SLICES = 1 << 20, 64
#: Weight of all sets in one block; a set weighs its n-grams, SMALL at least.
BLOCK_GRAMS, SMALL = 400_000, 200
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True


def gram_sets(data: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's distinct n-grams of words as sorted 64-bit hashes; a row of fewer words is one n-gram, none is none."""
    data = _LOWER[data]
    text = np.concatenate([[True], _BLANK[data], [True]])
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    begins = np.flatnonzero(~text[1:-1] & (text[:-2] | first[:-1]))
    ends = np.flatnonzero(~text[1:-1] & (text[2:] | first[1:])) + 1
    words = piece_hashes(data, begins, ends)
    rows = np.searchsorted(begins, starts)
    factors = mix(np.arange(1, width + 1)) | np.uint64(1)
    out = []
    with np.errstate(over="ignore"):
        last = max(0, len(words) - width + 1)
        whole = sum((words[k:k + last] * factors[k] for k in range(width)), np.zeros(last, np.uint64))
        whole = mix(whole)
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(whole[a:b - width + 1]))
            elif b > a:
                out.append(mix(np.array([(words[a:b] * factors[:b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray, seed: int) -> int:
    """A 63-bit hash of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(grams ^ np.uint64(0x5851F42D4C957F2D + seed)).sum() + np.uint64(len(grams))], np.uint64))[0] >> np.uint64(1))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    data, starts = flat_text(batch.column("text"))
    for a, b in blocks(starts):
        yield from enumerate(gram_sets(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a], width), a)


def _summaries(width: int, seed: int):
    """Per document its node, size and a second hash; per task the counter array in slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            node, check, size = (np.zeros(len(batch), np.int64) for _ in range(3))
            for i, grams in _sets(batch, width):
                node[i], check[i], size[i] = signature(grams, seed), signature(grams, seed + 7919), len(grams)
                np.add.at(counts, (grams & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            n = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node), pa.array(check), pa.array(size), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                                             names=["doc_id", "node", "check", "n", "slice", "counts"])
        parts = counts.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64())] * 4 + [pa.array(range(SLICES), pa.int32()), pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary())],
                                         names=["doc_id", "node", "check", "n", "slice", "counts"])
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(part.as_buffer(), np.int32)
            sums[k] = sums.get(k, 0) + part.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])


def first_shared(n: int) -> int:
    """How many n-grams two linked sets, the smaller of n, share among their first ones."""
    return 1 + n // 20


def _prefixes(width: int, seed: int, percent: int, shared: Broadcast):
    """Per document its first n-grams in the common order: as many as a link's size bound asks for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for _, grams in _sets(batch, width):
                if 100 * len(grams) >= percent * (len(grams) + 1):  # a smaller set links with no other set
                    k = len(grams) - -(-percent * len(grams) // 100) + first_shared(len(grams))
                    order = level[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57) | grams >> np.uint64(7)
                    keys.append(grams[np.argpartition(order, k - 1)[:k]].view(np.int64))
                    nodes.append(signature(grams, seed))
                    sizes.append(len(grams))
            lengths = np.fromiter(map(len, keys), np.int64, len(keys))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            every, size = np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
            for i in range(0, len(flat), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(flat[part]), pa.array(every[part]), pa.array(size[part])], names=["gram", "node", "n"])
    return run


def _node_sets(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("node").to_numpy()
            rows, sets, size = [], [], 0
            for i, grams in _sets(batch, width):
                if signature(grams, seed) == want[i]:
                    rows.append(i)
                    sets.append(grams.tobytes())
                    size += len(sets[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(want[rows]), pa.array(sets, pa.binary())], names=["node", "grams"])
                    rows, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(want[rows].astype(np.int64)), pa.array(sets, pa.binary())], names=["node", "grams"])
    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], strip: int = 4096) -> np.ndarray:
    """Sizes of all intersections: the product of the two incidence matrices, a strip of n-grams at a time."""
    count = np.zeros((len(left), len(right)), np.int32)
    a, b = np.concatenate(left), np.concatenate(right)
    grams = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)

    def placed(sets, flat):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(grams, flat), max(0, len(grams) - 1))
        there = grams[at] == flat if len(grams) else np.zeros(len(flat), bool)
        order = np.argsort(at[there], kind="stable")
        return at[there][order], owner[there][order]
    (ga, oa), (gb, ob) = placed(left, a), placed(right, b)
    for i in range(0, len(grams), strip):
        one, two = (np.zeros((len(s), min(strip, len(grams) - i)), np.float32) for s in (left, right))
        for m, g, o in ((one, ga, oa), (two, gb, ob)):
            x, y = np.searchsorted(g, [i, i + strip])
            m[o[x:y], g[x:y] - i] = 1
        count += (one @ two.T).astype(np.int32)
    return count


def _spread(linked: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column reaches through the links (right None: rows and columns are the same)."""
    far = np.iinfo(np.int64).max
    rows, cols = left.copy(), (left if right is None else right).copy()
    while True:
        down = np.minimum(cols, np.where(linked, rows[:, None], far).min(0))
        across = np.minimum(down if right is None else rows, np.where(linked, down[None, :], far).min(1))
        if right is None:
            down = across
        if (down == cols).all() and (across == rows).all():
            return rows, cols
        rows, cols = across, down


def _product(percent: int):
    """Links within a block or between two: a row per linked node with its root there and the number of rows it links."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "node"])
        left = rows[rows.side == 0]
        right = rows[rows.side == 1]
        same = not len(right)
        right = left if same else right
        a, b = ([np.frombuffer(x, np.uint64) for x in part.grams] for part in (left, right))
        both = overlaps(a, b).astype(np.int64)
        union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both
        ids, others = left.node.to_numpy(), right.node.to_numpy()
        linked = (100 * both >= percent * union) & (ids[:, None] != others[None, :])
        near = _spread(linked, ids, None if same else others)
        found = [pd.DataFrame({"node": ids, "root": near[0], "links": linked @ right.copies.to_numpy()})]
        if not same:
            found.append(pd.DataFrame({"node": others, "root": near[1], "links": left.copies.to_numpy() @ linked}))
        found = pd.concat(found)
        return found[found.links > 0]
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, from edges (a, b); alternating stars, each round a written table.

    Only nodes with an edge have a row.
    """
    now, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = state


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """Of (gram, node, n) those whose gram another node has, of nodes with enough such grams for a link."""
    grams = rows.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("gram")
    met = written(rows.join(grams, "gram").groupBy("gram", "node").agg(F.max("n").alias("n")), "met")
    least = F.expr(f"1 + int(ceil({percent} * n / 100.0) / 20)")
    enough = met.groupBy("node").agg(F.count("*").alias("k"), F.max("n").alias("n")).where(F.col("k") >= least).select("node")
    return met.join(enough, "node").select("gram", "node", "n")


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, component_id and n_links, the number of other rows it links with.

    Two texts link when 100 * intersection >= percent * union of their sets of `width` words (words: anything but ASCII
    white space, A-Z in lower case). component_id is the smallest doc_id reachable by links. A text without words, empty
    or null, links with nothing and is its own component. Equal texts always link; repeated rows count as other rows.
    A null doc_id names no component: such a row takes the smallest id of the others, or null.
    """
    spark, rows, seed = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 0
    while True:
        summary = written(rows.mapInArrow(_summaries(width, seed), "doc_id long, node long, check long, n long, slice int, counts binary"), "summary")
        nodes = written(summary.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("check").alias("one"),
                                                                  F.max("check").alias("two")), "nodes")
        if nodes.where("one <> two").isEmpty():
            break
        seed += 1  # two different sets with one hash
    counts = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in (summary.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary").collect()):
        counts[r.slice] += np.frombuffer(r.counts, np.int64)
    level = np.maximum(0, np.floor(4 * np.log2(np.maximum(counts.ravel(), 1) / max(1.0, counts.mean())))).astype(np.uint8)
    shared = spark.sparkContext.broadcast(level)
    prefixes = rows.mapInArrow(_prefixes(width, seed, percent, shared), "gram long, node long, n long")
    meetings = written(_shared(prefixes, percent), "meetings")
    shared.unpersist()
    meetings = written(_shared(meetings, percent), "meetings")
    leaders = meetings.groupBy("gram").agg(F.min("node").alias("leader"))
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9)
    followers = meetings.join(leaders, "gram").groupBy("node").agg(F.min("leader").alias("leader"), F.max("n").alias("n")).withColumn("step", step)
    weights = followers.groupBy("leader", "step").agg(F.ceil(F.sum(F.greatest("n", F.lit(SMALL))) / BLOCK_GRAMS).alias("parts"))
    placed = written(followers.join(weights, ["leader", "step"])
                     .select("node", "step", F.xxhash64("leader", "step", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), "placed")
    met = meetings.select("gram", "node").join(placed, "node").select("gram", "block", "step").distinct()
    other = met.select("gram", F.col("block").alias("block2"), F.col("step").alias("step2"))
    between = met.join(other, "gram").where("block < block2 and abs(step - step2) <= 1").select("block", "block2").distinct()
    within = placed.groupBy("block").agg(F.count("*").alias("k")).where("k > 1").select("block", F.col("block").alias("block2"))
    units = (between.union(within).withColumn("unit", F.xxhash64("block", "block2"))
             .select("unit", F.explode(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block2").alias("block"), F.lit(1).alias("side")))).alias("x"),
                     (F.col("block") == F.col("block2")).alias("own")).select("unit", "x.*", "own").where("not own or side = 0").drop("own"))
    wanted = placed.join(nodes, "node").select("node", "doc_id", "copies", "block")
    key = F.coalesce("doc_id", F.lit(-1)).alias("key")
    sets = (rows.select(key, "text").join(wanted.select(key, "node"), "key").select("node", "text").mapInArrow(_node_sets(width, seed), "node long, grams binary").dropDuplicates(["node"]))
    linked = written(sets.join(wanted.select("node", "copies", "block"), "node").join(units, "block").select("unit", "side", "node", "copies", "grams")
                     .groupBy("unit").applyInPandas(_product(percent), "node long, root long, links long"), "linked")
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = named.join(least, "root").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = summary.where("n is not null").select("doc_id", F.col("n").alias("n_shingles"), "node")
    return (found.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id", "n_links")
            .union(found.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id", F.lit(0).cast("long"))))
