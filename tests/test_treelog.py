"""Append-only logs: ranges, prefix heads, consistency proofs."""

import hashlib

from pyspark.sql import functions as F

from lotlens.operators import treelog as T

H = lambda b: hashlib.sha256(b).hexdigest()


def split(n):
    k = 1
    while k * 2 < n:
        k *= 2
    return k


def tree_hash(leaves):
    """The published recursive definition."""
    if len(leaves) == 1:
        return leaves[0]
    k = split(len(leaves))
    return H(b"\x01" + bytes.fromhex(tree_hash(leaves[:k])) + bytes.fromhex(tree_hash(leaves[k:])))


def proof(m, leaves, whole=True):
    n = len(leaves)
    if m == n:
        return [] if whole else [tree_hash(leaves)]
    k = split(n)
    return [*proof(m, leaves[:k], whole), tree_hash(leaves[k:])] if m <= k else [*proof(m - k, leaves[k:], False), tree_hash(leaves[:k])]


LEAVES = [H(f"leaf {i}".encode()) for i in range(45)]


def frame(spark, logs):
    return spark.createDataFrame([(log, i, h, i // 7) for log, n in logs for i, h in enumerate(LEAVES[:n])], "log long, idx long, node string, day int")


def test_ranges_merge_to_the_root_in_any_grouping(spark):
    logs = [(n, n) for n in (1, 2, 3, 7, 8, 16, 31, 45)]
    leaves = frame(spark, logs)
    want = {n: (n, tree_hash(LEAVES[:n])) for n, _ in logs}
    for bits, stages in ((2, 4), (10, 4)):
        assert {r.log: (r["size"], r.root) for r in T.range_roots(T.compact_ranges(leaves, bits=bits, stages=stages)).collect()} == want
        days = T.compact_ranges(leaves, ["day"], bits, stages)
        assert {r.log: (r["size"], r.root) for r in T.range_roots(T.merged(days.drop("day"), bits=bits, stages=stages)).collect()} == want
    counts = days.groupBy("log", "day").count().collect()
    assert max(r["count"] for r in counts) <= 5  # of seven leaves
    assert T.compact_ranges(leaves.limit(0)).count() == 0


def test_period_heads_equal_the_definition(spark):
    leaves = frame(spark, [(1, 45), (2, 20), (3, 1)])
    got = {(r.log, r.day): (r["size"], r.root) for r in T.period_heads(leaves, "day", bits=2).collect()}
    assert got == {(log, d): (min(n, 7 * d + 7), tree_hash(LEAVES[:min(n, 7 * d + 7)])) for log, n in ((1, 45), (2, 20), (3, 1)) for d in range((n + 6) // 7)}


def test_consistency_proofs_equal_the_definition_and_forged_ones_fail(spark):
    pairs = [(1, m, n) for n in (1, 2, 3, 4, 7, 8, 9, 21, 32, 33, 45) for m in range(1, n + 1)]
    sizes = spark.createDataFrame([(1, n) for n in range(1, 46)], "log long, size long")
    nodes = T.boundary_nodes(frame(spark, [(1, 45)]), sizes, bits=2)
    found = T.consistency_proofs(spark.createDataFrame(pairs, "log long, m long, n long"), nodes)
    got = {(r.log, r.m, r.n): r.proof for r in found.collect()}
    assert got == {(1, m, n): proof(m, LEAVES[:n]) for _, m, n in pairs}
    roots = T.prefix_roots(sizes, nodes)
    assert {r["size"]: r.root for r in roots.collect()} == {n: tree_hash(LEAVES[:n]) for n in range(1, 46)}
    whole = (found.join(roots.select(F.col("size").alias("m"), F.col("root").alias("root_m")), "m").join(roots.select(F.col("size").alias("n"), F.col("root").alias("root_n")), "n"))
    assert T.verify_consistency(whole).where("ok").count() == len(pairs)
    bad = "sha2({0}, 256)".format
    forgeries = [whole.withColumn("root_m", F.expr(bad("root_m"))), whole.withColumn("root_n", F.expr(bad("root_n"))), whole.where("m < n").withColumn("proof", F.expr("slice(proof, 2, size(proof))")),
                 whole.where("m < n").withColumn("proof", F.expr("slice(proof, 1, size(proof) - 1)")), whole.withColumn("proof", F.expr("concat(proof, array(root_n))")),
                 whole.where("m < n").withColumn("proof", F.expr(f"transform(proof, (h, i) -> IF(i = size(proof) DIV 2, {bad('h')}, h))")), whole.where("m < n").withColumn("n", F.expr("m"))]
    for forged in forgeries:
        assert T.verify_consistency(forged).where("ok").count() == 0
    assert T.consistency_proofs(spark.createDataFrame([(9, 1, 2)], "log long, m long, n long"), nodes).first().proof is None


def test_only_groups_with_a_boundary_give_rows(spark):
    leaves = frame(spark, [(1, 45)])
    nodes = T.boundary_nodes(leaves, spark.createDataFrame([(1, 21)], "log long, size long"), bits=2)
    assert nodes.where("level = 0").count() == 4 and nodes.where("level = 0").agg(F.min("idx")).first()[0] == 20
