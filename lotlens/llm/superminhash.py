"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Texts with the same set of word shingles are one node. SuperMinHash gives every element a random permutation of the
   signature's places and a rank below one; component p is the least (position of p in the permutation + rank) over all
   elements. Ranks of one element are correlated over the places, so signatures vary less than independent hashes. All
   elements take their first positions first, then their second ones: once every place is filled, later positions can't
   change it, so a large set stops after a few rounds.
2. ROWS components make a band. At 85 % similarity two sets miss all BANDS bands with a chance of 2e-9. Nodes of one band
   hash are a bucket; buckets with the same nodes are one.
3. Every node meets the smallest node of the bucket that it shares most often (its leader) and the link is verified on full
   sets. Linked nodes are joined to components by alternating stars.
4. Nodes of one component need no further comparison. Buckets that still hold several components are cut into blocks;
   signatures name the nodes with a likely partner in another component, and those are verified on full sets in the task,
   where a local union-find skips pairs already joined. No pair of documents is ever a row but a node and its leader.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import blocks, flat_text, mix, written
from lotlens.llm.jaccard import components, gram_sets, signature

BANDS, ROWS = 42, 6
PLACES = BANDS * ROWS
#: Positions that are followed back through the swaps before permutations are written out.
FOLLOWED = 8
#: Nodes in one block, and the weight of the sets that a task verifies at once (a set weighs its shingles, SMALL at least).
BLOCK, BLOCK_SHINGLES, SMALL = 1024, 400_000, 200


def _draw(elements: np.ndarray, position: int) -> tuple[np.ndarray, np.ndarray]:
    """Each element's random rank (56 bits) and swap partner (position to PLACES - 1) at a position."""
    with np.errstate(over="ignore"):
        x = mix(elements + np.uint64(0x9E3779B97F4A7C15) * np.uint64(position + 1))
    rank = x >> np.uint64(8)
    partner = np.uint64(position) + ((mix(x) >> np.uint64(32)) * np.uint64(PLACES - position) >> np.uint64(32))
    return rank, partner.astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The SuperMinHash signature of every set (none empty), one row of PLACES numbers each."""
    n, free = len(sets), np.iinfo(np.uint64).max
    filled = np.full((n, PLACES), free, np.uint64)
    flat, left = filled.reshape(-1), np.full(n, PLACES)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    elements = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    swaps: list[np.ndarray] = []
    table = None
    for position in range(PLACES):
        if not len(elements):
            break
        rank, partner = _draw(elements, position)
        if table is None and position < FOLLOWED:
            place = partner.copy()
            for earlier in range(position - 1, -1, -1):
                place[swaps[earlier] == place] = earlier
            swaps.append(partner)
        else:
            every = np.arange(len(elements))
            if table is None:
                table = np.tile(np.arange(PLACES, dtype=np.uint16), (len(elements), 1))
                for earlier, swap in enumerate(swaps):
                    table[every, swap], table[:, earlier] = table[:, earlier].copy(), table[every, swap]
            place = table[every, partner].astype(np.int64)
            table[every, partner], table[:, position] = table[:, position].copy(), place.astype(np.uint16)
        target = owner * PLACES + place
        new = flat[target] == free  # a place filled at an earlier position is final
        np.minimum.at(flat, target[new], (np.uint64(position) << np.uint64(56)) | rank[new])
        left -= np.bincount(np.unique(target[new]) // PLACES, minlength=n)
        open_ = left[owner] > 0  # a set whose places are all filled is done
        if not open_.all():
            elements, owner = elements[open_], owner[open_]
            swaps = [s[open_] for s in swaps]
            table = table[open_] if table is not None else None
    return filled


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every band."""
    with np.errstate(over="ignore"):
        total = (mix(found).reshape(len(found), BANDS, ROWS) * (mix(np.arange(1, ROWS + 1)) | np.uint64(1))).sum(2, dtype=np.uint64)
        return mix(total + mix(np.arange(1, BANDS + 1))[None, :]).view(np.int64)


def least_alike(percent: int) -> int:
    """Equal components that two sets of that similarity reach but with a chance below 1e-12 (seven deviations)."""
    share = percent / 100
    return max(1, int(PLACES * share - 7 * np.sqrt(PLACES * share * (1 - share))))


SUMMARY = "doc_id long, row long, node long, check long, n long, bytes binary, keys array<long>"


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, starts = flat_text(batch.column("text"))
    for a, b in blocks(starts):
        yield a, gram_sets(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a], width)


def _summaries(width: int, percent: int, seed: int):
    """Per document: node, second hash, size, a byte of each component, and band hashes where another set can be near."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets(batch, width):
                sizes = np.array([len(s) for s in sets], np.int64)
                node = np.array([signature(s, seed) for s in sets], np.int64)
                check = np.array([signature(s, seed + 7919) for s in sets], np.int64)
                signed = np.flatnonzero((sizes > 0) & (100 * sizes >= percent * (sizes + 1)))  # a smaller set links with no other set
                found = signatures([sets[i] for i in signed])
                low, keys = (mix(found) & np.uint64(255)).astype(np.uint8), band_keys(found)
                texts, lists = [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(signed):
                    texts[i], lists[i] = low[k].tobytes(), keys[k]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(sets)) for c in ("doc_id", "row")), pa.array(node), pa.array(check), pa.array(sizes), pa.array(texts, pa.binary()),
                                                  pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "row", "node", "check", "n", "bytes", "keys"])
    return run


def _node_sets(width: int, seed: int):
    """The full sets of wanted nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("node").to_numpy()
            for at, sets in _sets(batch, width):
                keep = [i for i, s in enumerate(sets) if signature(s, seed) == want[at + i]]
                yield pa.RecordBatch.from_arrays([pa.array(want[at + np.array(keep, np.int64)]), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["node", "shingles"])
    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _leader_links(percent: int):
    """Of a leader and some of its followers those that link."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows.node == rows.leader]
        tail = rows[rows.node != rows.leader]
        a = np.frombuffer(head.shingles.iloc[0], np.uint64) if len(head) else np.zeros(0, np.uint64)
        keep = [linked(a, np.frombuffer(x, np.uint64), percent) for x in tail.shingles] if len(head) else [False] * len(tail)
        return tail.loc[np.array(keep, bool), ["node", "leader"]].rename(columns={"node": "a", "leader": "b"})
    return run


def _partners(least: int):
    """Nodes of a unit with a likely partner of another component, by the bytes of their signatures."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        size, root = len(rows), rows.root.to_numpy()
        keep = np.zeros(size, bool)
        if size > 1:
            whole = np.stack([np.frombuffer(b, np.uint8) for b in rows.bytes])
            for i in range(0, size, 32):
                part = slice(i, i + 32)
                near = (whole[part, None, :] == whole[None, :, :]).sum(2) >= least
                near &= root[part, None] != root[None, :]
                keep[part] |= near.any(1)
        return rows.loc[keep, ["unit", "node"]]
    return run


def _verified(percent: int, least: int):
    """Links that join the components of a unit; pairs already joined, directly or through others, are not compared."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(x, np.uint64) for x in rows.shingles]
        whole = np.stack([np.frombuffer(b, np.uint8) for b in rows.bytes])
        group = np.unique(rows.root, return_inverse=True)[1]
        ids, found = rows.node.to_numpy(), []
        for i in range(len(sets)):
            alike = (whole[i + 1:] == whole[i]).sum(1) >= least
            for j in i + 1 + np.flatnonzero(alike):
                if group[i] != group[j] and linked(sets[i], sets[j], percent):
                    found.append((ids[i], ids[j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")
    return run


def _rest(buckets: DataFrame, roots: DataFrame, signed: DataFrame, weigh: DataFrame, sets, percent: int) -> DataFrame:
    """Links (a, b) between nodes of one bucket that are in different components so far."""
    placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k")).where("low <> high")
    # The component of most nodes is not compared with itself; a bucket whose other nodes are few stays linear.
    main = (placed.join(open_.select("key"), "key", "left_semi").groupBy("key", "root").agg(F.count("*").alias("k"))
            .groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("k")))
    placed = (placed.join(main, "key").withColumn("own", F.col("root") == F.col("main"))
              .withColumn("blocks", F.ceil((F.col("k") - F.col("most")) / BLOCK)).withColumn("main_blocks", F.ceil(F.col("most") / BLOCK)))
    mine = F.when(F.col("own"), F.col("blocks") + F.pmod(F.xxhash64("node"), F.col("main_blocks"))).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    # Blocks of other nodes meet each other and the main ones; main blocks meet the others only.
    last = F.when(F.col("own"), F.col("blocks")).otherwise(F.col("blocks") + F.col("main_blocks")) - 1
    spread = placed.withColumn("mine", mine).select("key", "node", "root", F.col("mine"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    units = written(spread.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "node", "root"), "units")
    # As many tasks as a shuffle has: the work goes by pairs, which the size of the rows doesn't tell.
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    likely = units.join(signed, "node").repartition(tasks, "unit").groupBy("unit").applyInPandas(_partners(least_alike(percent)), "unit long, node long")
    likely = written(likely, "likely")
    if likely.isEmpty():
        return None
    # A unit whose sets weigh more than a task should hold is cut in the same way once more.
    likely = likely.join(weigh, "node")
    parts = likely.groupBy("unit").agg(F.ceil(F.sum("weight") / BLOCK_SHINGLES).alias("parts"))
    mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.xxhash64("unit", F.least(mine, o), F.greatest(mine, o)))
    pieces = likely.join(parts, "unit").select("node", F.explode(cut).alias("piece"))
    full = sets(likely.select("node").distinct())
    pieces = pieces.join(full, "node").join(signed, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return written(pieces.repartition(tasks, "piece").groupBy("piece").applyInPandas(_verified(percent, least_alike(percent)), "a long, b long"), "links")


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, component_id and kept.

    Two texts link when 100 * intersection >= percent * union of their sets of `width` words (words: anything but ASCII
    white space, A-Z in lower case; a text of fewer words is one shingle). component_id is the smallest doc_id reachable
    by links, kept says that it is the row's own. A text without words, empty or null, links with nothing and is its own
    component. Equal texts always link. A null doc_id names no component: such a row takes the smallest id of the others,
    or null, and is kept only if there is none. Bands are made for 85 %: at 80 % a single link is missed with 3e-6.
    """
    # Rows are known by a hash of doc_id and text, so rows without an id don't meet at one key.
    rows, seed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text"), 0
    while True:
        summary = written(rows.mapInArrow(_summaries(width, percent, seed), SUMMARY), "summary")
        nodes = written(summary.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.min("check").alias("one"), F.max("check").alias("two"), F.max("n").alias("n"),
                                                                  F.first("bytes").alias("bytes"), F.first("keys").alias("keys")), "nodes")
        if nodes.where("one <> two").isEmpty():
            break
        seed += 1  # two different sets with one hash
    met = nodes.where("keys is not null").select(F.explode("keys").alias("key"), "node")
    met = written(met, "bands")
    alike = met.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("all")).where("k > 1")
    distinct = alike.groupBy("k", "low", "high", "all").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    buckets = written(met.join(distinct.select("key", F.col("low").alias("leader"), "times", "k"), "key").select("key", "node", "leader", "times", "k"), "buckets")

    weigh = nodes.select("node", F.greatest("n", F.lit(SMALL)).alias("weight"))
    signed = nodes.where("bytes is not null").select("node", "bytes")

    def sets(wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, from a row of each."""
        found = rows.select("row", "text").join(nodes.join(wanted, "node").select("row", "node"), "row").select("node", "text")
        return found.mapInArrow(_node_sets(width, seed), "node long, shingles binary").dropDuplicates(["node"])

    pairs = buckets.where("node <> leader").groupBy("node", "leader").agg(F.sum("times").alias("times"))
    pairs = written(pairs.groupBy("node").agg(F.max_by("leader", F.struct("times", -F.col("leader"))).alias("leader")), "leaders")
    full = written(sets(pairs.select("node").union(pairs.select("leader")).distinct()), "sets")
    heavy = pairs.join(weigh, "node").groupBy("leader").agg(F.ceil(F.sum("weight") / BLOCK_SHINGLES).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    asked = pairs.join(heavy, "leader").select("leader", "node", part.alias("part"))
    leaders = heavy.select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    first = asked.union(leaders).join(full, "node").groupBy("leader", "part").applyInPandas(_leader_links(percent), "a long, b long")
    edges = written(first, "links")
    roots = components(edges)
    compared = buckets.where("k = 2").join(pairs, ["node", "leader"]).select("key")  # a node and its leader, and no one else
    more = _rest(buckets.join(compared, "key", "left_anti").select("key", "node"), roots, signed, weigh, sets, percent)
    if more is not None:
        roots = components(edges.union(more))
    named = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    found = summary.select("doc_id", F.col("n").alias("n_shingles"), "node")
    out = (found.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id")
           .union(found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
