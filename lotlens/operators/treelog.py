"""Append-only Merkle logs without rebuilding: compact ranges, prefix heads and consistency proofs.

A compact range is the list of the largest complete subtrees that cover neighbouring leaves: O(log n) nodes (level, idx),
node idx of a level standing for leaves idx * 2^level to (idx + 1) * 2^level - 1. Ranges of neighbouring leaves merge by
pairing siblings, in any grouping, so a day's range is an aggregate that is stored once and merged later. Nodes are folded
BITS levels at a time, in groups of at most 2^BITS of them; STAGES rounds reach logs of 2^40 leaves, so that no plan needs
to know a log's size beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, STAGES = 10, 4
_NODE = "sha2(concat(unhex('01'), unhex({0}), unhex({1})), 256)"
_LEFT = "coalesce(x.idx % 2 = 0 AND get(c, i + 1).idx = x.idx + 1, false)"
_RIGHT = "coalesce(x.idx % 2 = 1 AND get(c, i - 1).idx = x.idx - 1, false)"
# Siblings next to each other become their parent.
_PARENTS = ("transform(filter(transform(c, (x, i) -> IF(" + _LEFT + ", i, NULL)), i -> i IS NOT NULL), i -> named_struct('idx', shiftright(get(c, i).idx, 1), 'node', "
            + _NODE.format("get(c, i).node", "get(c, i + 1).node") + "))")
_ALONE = f"transform(filter(c, (x, i) -> NOT ({_LEFT} OR {_RIGHT})), x -> named_struct('level', l, 'idx', x.idx, 'node', x.node))"


_EMPTY = "CAST(array() AS ARRAY<STRUCT<level: INT, idx: BIGINT, node: STRING>>)"


def _top(nodes: DataFrame, level: str) -> DataFrame:
    """nodes, of which those of the last level must be the only ones of their group."""
    fits = F.expr(f"level < {level} OR idx = 0")
    return nodes.withColumn("idx", F.when(fits, F.col("idx")).otherwise(F.raise_error("log of too many leaves").cast("bigint")))


def _fold(nodes: DataFrame, keys: Sequence[str], kept: str, bits: int, stages: int) -> DataFrame:
    """Pair siblings of nodes(keys, level, idx, node) up to the top; ``kept`` says which nodes of a level become rows.

    Nodes of a group of keys do not overlap.
    """
    out, tops = None, None
    for stage in range(stages):
        low, high = stage * bits, (stage + 1) * bits
        here = nodes.where(f"level >= {low} AND level < {high}").select(*keys, "level", "idx", "node")
        here = here if tops is None else here.unionByName(tops)
        groups = here.groupBy(*keys, F.expr(f"shiftright(idx, {high} - level)").alias("grp")).agg(F.collect_list(F.struct("level", "idx", "node")).alias("ns"))
        step = ("transform(array(array_sort(concat(a.cur, transform(filter(ns, n -> n.level = l), n -> named_struct('idx', n.idx, 'node', n.node))))), c -> "
                f"named_struct('cur', {_PARENTS}, 'out', concat(a.out, {kept})))[0]")
        start = f"named_struct('cur', CAST(array() AS ARRAY<STRUCT<idx: BIGINT, node: STRING>>), 'out', {_EMPTY})"
        done = groups.selectExpr(*keys, f"aggregate(sequence({low}, {high - 1}), {start}, (a, l) -> {step}) AS r")
        rows = done.selectExpr(*keys, "inline(r.out)")
        out = rows if out is None else out.unionByName(rows)
        tops = done.selectExpr(*keys, "inline(r.cur)").selectExpr(*keys, f"CAST({high} AS INT) AS level", "idx", "node")
    rest = nodes.where(f"level >= {bits * stages}").select(*keys, "level", "idx", "node").unionByName(tops)
    return out.unionByName(_top(rest, str(bits * stages)))


def _fold_leaves(nodes: DataFrame, keys: Sequence[str], bits: int, stages: int) -> DataFrame:
    """The largest complete subtrees over leaves(keys, level 0, idx, node), in one chain of rounds.

    Nodes that stay alone, a few per group, travel with the group's other nodes, so no round is worked out twice.
    """
    for stage in range(stages):
        low, high = stage * bits, (stage + 1) * bits
        groups = nodes.groupBy(*keys, F.expr(f"shiftright(idx, {high} - level)").alias("grp")).agg(F.collect_list(F.struct("level", "idx", "node")).alias("ns"))
        here = "ns" if not stage else f"filter(ns, n -> n.level = {low})"
        start = (f"named_struct('cur', transform(array_sort({here}), n -> named_struct('idx', n.idx, 'node', n.node)), 'out', "
                 + (_EMPTY if not stage else f"filter(ns, n -> n.level < {low})") + ")")
        step = f"transform(array(a.cur), c -> named_struct('cur', {_PARENTS}, 'out', concat(a.out, {_ALONE})))[0]"
        every = f"concat(a.out, transform(a.cur, x -> named_struct('level', {high}, 'idx', x.idx, 'node', x.node)))"
        nodes = groups.selectExpr(*keys, f"inline(aggregate(sequence({low}, {high - 1}), {start}, (a, l) -> {step}, a -> {every}))")
    return _top(nodes, str(bits * stages))


def _leaf_nodes(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    return leaves.select(*keys, F.lit(0).alias("level"), F.col("idx").cast("bigint").alias("idx"), "node")


def compact_ranges(leaves: DataFrame, by: Sequence[str] = (), bits: int = BITS, stages: int = STAGES) -> DataFrame:
    """(log, by..., level, idx, node): the compact range of each group of leaves(log, by..., idx, node)."""
    keys = ["log", *by]
    return _fold_leaves(_leaf_nodes(leaves, keys), keys, bits, stages)


def merged(ranges: DataFrame, by: Sequence[str] = (), bits: int = BITS, stages: int = STAGES) -> DataFrame:
    """One range per (log, by...) from ranges of disjoint leaves, for example the stored one and a new day's."""
    return _fold(ranges, ["log", *by], _ALONE, bits, stages)


def range_roots(ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(log, by..., size, root) of ranges that begin at leaf 0."""
    # At most one node per level.
    lists = ranges.groupBy("log", *by).agg(F.sum(F.expr("shiftleft(1L, level)")).alias("size"), F.array_sort(F.collect_list(F.struct("level", "node"))).alias("ns"))
    return lists.select("log", *by, "size", _folded("ns").alias("root"))


def _folded(nodes: str):
    """The hash over complete subtrees sorted from the right (smallest) to the left."""
    return F.expr(f"aggregate(slice({nodes}, 2, size({nodes})), {nodes}[0].node, (r, n) -> {_NODE.format('n.node', 'r')})")


def prefix_nodes(ranges: DataFrame, bits: int = BITS, stages: int = STAGES) -> DataFrame:
    """Every complete subtree that is made of whole nodes of ``ranges``, and those nodes: log, level, idx, node.

    They hold all that the head of any prefix ending where a range ends needs.
    """
    return _fold(ranges, ["log"], "transform(c, x -> named_struct('level', l, 'idx', x.idx, 'node', x.node))", bits, stages)


def prefix_roots(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(log, size, root) of heads(log, size) from complete subtrees(log, level, idx, node): log2(size) of them each."""
    need = heads.select("log", F.col("size").cast("bigint").alias("size")).distinct().selectExpr("log", "size", "explode(filter(sequence(0, 61), b -> shiftright(size, b) % 2 = 1)) AS level")
    need = need.selectExpr("log", "size", "level", "2 * shiftright(size, level + 1) AS idx")
    lists = need.join(nodes, ["log", "level", "idx"]).groupBy("log", "size").agg(F.array_sort(F.collect_list(F.struct("level", "node"))).alias("ns"))
    return lists.where(F.size("ns") == F.expr("bit_count(size)")).select("log", "size", _folded("ns").alias("root"))


def period_heads(leaves: DataFrame, period: str, bits: int = BITS, stages: int = STAGES) -> DataFrame:
    """(log, period, size, root): the head after each period's leaves, from one range per log and period and prefix merges.

    leaves(log, period, idx, node), periods in the order of idx. No leaf is read more than once.
    """
    ranges = compact_ranges(leaves, [period], bits, stages)
    sizes = leaves.groupBy("log", period).agg((F.max("idx") + 1).cast("bigint").alias("size"))
    return sizes.join(prefix_roots(sizes, prefix_nodes(ranges.drop(period), bits, stages)), ["log", "size"]).select("log", period, "size", "root")


def boundary_nodes(leaves: DataFrame, sizes: DataFrame, bits: int = BITS, stages: int = STAGES) -> DataFrame:
    """Complete subtrees that heads and proofs of ``sizes`` (log, size) can ask for: log, level, idx, node.

    Every leaf is folded once; only groups of 2^bits nodes with one of the sizes inside give their inner nodes as rows.
    """
    sizes = sizes.select("log", F.col("size").cast("bigint").alias("size")).distinct()
    nodes, out = _leaf_nodes(leaves, ["log"]), None
    for stage in range(stages):
        low, high = stage * bits, (stage + 1) * bits
        cut = sizes.where(F.expr(f"size % shiftleft(1L, {high}) <> 0")).selectExpr("log", f"shiftright(size, {high}) AS grp").distinct().withColumn("cut", F.lit(True))
        groups = nodes.selectExpr("log", f"shiftright(idx, {bits}) AS grp", "idx", "node").groupBy("log", "grp").agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("ns"))
        groups = groups.join(cut, ["log", "grp"], "left")
        every = "IF(cut, transform(c, x -> named_struct('level', l, 'idx', x.idx, 'node', x.node)), CAST(array() AS ARRAY<STRUCT<level: INT, idx: BIGINT, node: STRING>>))"
        step = f"transform(array(a.cur), c -> named_struct('cur', {_PARENTS}, 'out', concat(a.out, {every})))[0]"
        start = "named_struct('cur', ns, 'out', CAST(array() AS ARRAY<STRUCT<level: INT, idx: BIGINT, node: STRING>>))"
        done = groups.selectExpr("log", f"aggregate(sequence({low}, {high - 1}), {start}, (a, l) -> {step}) AS r")
        rows = done.selectExpr("log", "inline(r.out)")
        out = rows if out is None else out.unionByName(rows)
        nodes = done.selectExpr("log", "inline(r.cur)")
    return out.unionByName(nodes.selectExpr("log", f"CAST({bits * stages} AS INT) AS level", "idx", "node"))


# The intervals of leaves whose hashes prove that the first n leaves extend the first m, in the order of the proof.
_INTERVALS = """aggregate(sequence(1, 62), named_struct('lo', 0L, 'm', m, 'n', n, 'whole', true, 'out', CAST(array() AS ARRAY<STRUCT<lo: BIGINT, hi: BIGINT>>), 'done', false),
  (a, s) -> CASE WHEN a.done THEN a
    WHEN a.m = a.n THEN named_struct('lo', a.lo, 'm', a.m, 'n', a.n, 'whole', a.whole, 'out', IF(a.whole, a.out, concat(array(named_struct('lo', a.lo, 'hi', a.lo + a.m)), a.out)), 'done', true)
    ELSE transform(array(shiftleft(1L, 63 - CAST(length(regexp_replace(lpad(bin(a.n - 1), 64, '0'), '1.*$', '')) AS INT))), k ->
      IF(a.m <= k, named_struct('lo', a.lo, 'm', a.m, 'n', k, 'whole', a.whole, 'out', concat(array(named_struct('lo', a.lo + k, 'hi', a.lo + a.n)), a.out), 'done', false),
                   named_struct('lo', a.lo + k, 'm', a.m - k, 'n', a.n - k, 'whole', false, 'out', concat(array(named_struct('lo', a.lo, 'hi', a.lo + k)), a.out), 'done', false)))[0] END,
  a -> a.out)"""


def consistency_proofs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs(log, m, n), 0 < m <= n, with ``proof``: the hashes that show n's tree to begin with m's. An empty one proves m = n.

    ``nodes`` are boundary_nodes of all m and n. A pair whose nodes are not all there has no proof (null).
    """
    wanted = pairs.select("log", F.col("m").cast("bigint").alias("m"), F.col("n").cast("bigint").alias("n")).where("m > 0 AND m <= n").distinct()
    wanted = wanted.withColumn("parts", F.expr(f"CASE WHEN m > 0 AND m <= n THEN {_INTERVALS} END"))  # the optimiser may ask before it filters
    steps = wanted.selectExpr("log", "m", "n", "posexplode(parts) AS (place, p)")
    # An interval is the complete subtrees of its length's bits, largest first.
    need = steps.selectExpr("log", "m", "n", "place", "p.lo AS lo", "p.hi - p.lo AS len", "explode(filter(sequence(0, 61), b -> shiftright(p.hi - p.lo, b) % 2 = 1)) AS level")
    need = need.selectExpr("log", "m", "n", "place", "len", "level", "shiftright(lo + shiftleft(shiftright(len, level + 1), level + 1), level) AS idx")
    hashed = (need.join(nodes, ["log", "level", "idx"]).groupBy("log", "m", "n", "place", "len").agg(F.array_sort(F.collect_list(F.struct("level", "node"))).alias("ns"))
              .where(F.size("ns") == F.expr("bit_count(len)")).select("log", "m", "n", "place", _folded("ns").alias("h")))
    lists = hashed.groupBy("log", "m", "n").agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("hs"))
    joined = wanted.join(lists, ["log", "m", "n"], "left")
    whole = F.coalesce(F.size("hs"), F.lit(0)) == F.size("parts")
    return joined.select("log", "m", "n", F.when(whole, F.coalesce(F.expr("transform(hs, x -> x.h)"), F.expr("CAST(array() AS ARRAY<STRING>)"))).alias("proof"))


def verify_consistency(proofs: DataFrame) -> DataFrame:
    """Check (log, m, n, root_m, root_n, proof) as an untrusting reader would; adds ``ok``."""
    shift = "IF(a.fn % 2 = 0 AND a.fn <> 0, bit_count((a.fn & -a.fn) - 1), 0)"
    step = f"""aggregate(slice(path, 2, size(path)), named_struct('fn', shiftright(m - 1, bit_count(m ^ (m - 1)) - 1), 'sn', shiftright(n - 1, bit_count(m ^ (m - 1)) - 1), 'fr', path[0], 'sr', path[0], 'ok', true),
      (a, c) -> CASE WHEN a.sn = 0 THEN named_struct('fn', a.fn, 'sn', a.sn, 'fr', a.fr, 'sr', a.sr, 'ok', false)
        WHEN a.fn % 2 = 1 OR a.fn = a.sn THEN named_struct('fn', shiftright(a.fn, 1 + {shift}), 'sn', shiftright(a.sn, 1 + {shift}), 'fr', {_NODE.format('c', 'a.fr')}, 'sr', {_NODE.format('c', 'a.sr')}, 'ok', a.ok)
        ELSE named_struct('fn', shiftright(a.fn, 1), 'sn', shiftright(a.sn, 1), 'fr', a.fr, 'sr', {_NODE.format('a.sr', 'c')}, 'ok', a.ok) END,
      a -> a.ok AND a.sn = 0 AND a.fr = root_m AND a.sr = root_n)"""
    path = proofs.withColumn("path", F.expr("IF(bit_count(m) = 1, concat(array(root_m), proof), proof)"))
    ok = F.expr(f"CASE WHEN m = n THEN size(proof) = 0 AND root_m = root_n WHEN m <= 0 OR m > n OR size(proof) = 0 THEN false ELSE {step} END")
    return path.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("path")
