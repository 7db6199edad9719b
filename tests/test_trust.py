"""Chains, Merkle logs, digests."""

import hashlib
import json

from pyspark.sql import functions as F

from lotlens.operators import trust as T

H = lambda b: hashlib.sha256(b).hexdigest()


def naive_root(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1
    while k * 2 < len(leaves):
        k *= 2
    return H(b"\x01" + bytes.fromhex(naive_root(leaves[:k])) + bytes.fromhex(naive_root(leaves[k:])))


def test_merkle_sizes_and_proofs(spark):
    """One log of each size 1..20; two-bit fan-in exercises several folding rounds."""
    rows, roots = [], {}
    for n in range(1, 21):
        leaves = [H(b"\x00" + bytes.fromhex(H(f"cert{i}".encode()))) for i in range(n)]
        roots[n] = naive_root(leaves)
        rows += [(n, i, h) for i, h in enumerate(leaves)]
    leaves = spark.createDataFrame(rows, "log long, idx long, node string")
    got = T.merkle_root(leaves, bits=2)
    assert {r.log: r.root for r in got.collect()} == roots
    assert {r.log: r.root for r in T.merkle_root(leaves).collect()} == roots
    proofs = T.inclusion_proofs(leaves, bits=2).join(got, "log")
    assert T.verify_inclusion(proofs).where("ok").count() == len(rows)
    broken = proofs.withColumn("node", F.when(F.col("idx") == 0, F.sha2("node", 256)).otherwise(F.col("node")))
    assert T.verify_inclusion(broken).where("NOT ok").count() == 20
    assert T.verify_inclusion(proofs.withColumn("size", F.col("size") - F.col("size"))).where("ok").count() == 0
    # every prefix of the longest log
    heads = spark.createDataFrame([(20, n) for n in range(1, 21)], "log long, size long")
    assert {r.size: r.root for r in T.head_roots(heads, leaves, bits=2).collect()} == roots
    edited = leaves.withColumn("node", F.when((F.col("log") == 20) & (F.col("idx") == 5), F.sha2("node", 256)).otherwise(F.col("node")))
    published = heads.withColumn("root", F.element_at(F.create_map(*[F.lit(x) for kv in roots.items() for x in kv]), F.col("size").cast("int")))
    bad = {r["size"] for r in T.tree_head_consistency(published, edited, bits=2).where("NOT consistent").collect()}
    assert bad == set(range(6, 21))


def chain(n, centre, name="A"):
    prev, rows = T.GENESIS, []
    for i in range(n):
        row = dict(id=centre * 1000 + i, centre_id=centre, lot_ref=f"L{i}", farmer_name=name, officer_name=None, created_at="2026-06-01T08:00:00+00:00", n_bulbs=40 + i, n_looks=2,
                   grade_a_pct=71.25, ci_low=60.0, ci_high=80.5, defect_pct=3.1, result_json=json.dumps({"grade_a_pct": 71.25}))
        payload = {k: row[k] or "" for k in ("centre_id", "lot_ref", "farmer_name", "officer_name", "created_at", "n_bulbs", "n_looks", "grade_a_pct", "ci_low", "ci_high", "defect_pct")}
        row["result_sha256"] = H(row["result_json"].encode()) if i % 3 else None
        if row["result_sha256"]:
            payload["result_sha256"] = row["result_sha256"]
        row["prev_hash"] = prev
        row["row_hash"] = prev = H((json.dumps(payload, sort_keys=True, separators=(",", ":")) + prev).encode())
        rows.append(row)
    return rows


SCHEMA = ("id long, centre_id long, lot_ref string, farmer_name string, officer_name string, created_at string, n_bulbs int, n_looks int, grade_a_pct double, ci_low double, ci_high double, "
          "defect_pct double, result_json string, result_sha256 string, prev_hash string, row_hash string")


def test_chain_audit_finds_edits_without_cascading(spark):
    rows = chain(9, 1) + chain(4, 2, 'Señor "Ω" 😀') + chain(9, 3)
    rows[20]["grade_a_pct"] = 90.0            # headline edited
    rows[14]["result_json"] = '{"grade_a_pct": 1}'  # blob edited, digest pinned
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], SCHEMA)
    audit = T.audit_chain(df)
    assert {r.id for r in audit.where("NOT ok").collect()} == {rows[20]["id"], rows[14]["id"]}
    assert {r.centre_id: r.intact for r in T.chain_status(audit).collect()} == {1: True, 2: True, 3: False}
    states = {r.id: r.state for r in T.tampered_rows(df).collect()}
    assert states[rows[20]["id"]] == "tampered" and states[rows[14]["id"]] == "unverifiable"


def test_canonical_json_numbers_and_keys():
    assert T.canonical({"b": 1.0, "a": [1e21, 1e-7, 0.1, -0.0, 123456789.5, True, None], "é": "\n\"ü"}) == '{"a":[1e+21,1e-7,0.1,0,123456789.5,true,null],"b":1,"é":"\\n\\"ü"}'
    assert T.canonical(1e20) == "100000000000000000000" and T.canonical(1.5e-6) == "0.0000015" and T.canonical(333333333.33333329) == "333333333.3333333"


def test_receipt_digest_job(spark):
    body = {"z": 1, "a": {"x": 2.0}}
    good = H(T.canonical(body).encode())
    df = spark.createDataFrame([(good, (1, (2.0,))), ("0" * 64, (1, (2.0,))), (None, (1, (2.0,)))], "hash string, core struct<z: int, a: struct<x: double>>")
    assert {r.hash: r.hash_ok for r in T.receipt_digests(df).collect()} == {good: True, "0" * 64: False, None: False}
