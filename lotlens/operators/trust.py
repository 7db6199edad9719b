"""Audits: hash chains, pinned digests, Merkle logs, receipt revisions, evidence digests.

Each audit row depends only on stored neighbours, so chains are checked in parallel; Merkle levels are folded a thousand
leaves at a time.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.canonical import canonical_digest
from lotlens.functions.numeric import num
from lotlens.functions.ordered import previous
from lotlens.operators import treelog

GENESIS = "0" * 64


def json_string(c) -> Column:
    """A JSON string literal with non-ASCII characters escaped, as ASCII-only encoders write it."""
    quoted = F.expr(f"to_json(named_struct('v', coalesce({c}, '')))")
    body = F.substring(quoted, F.lit(6), F.length(quoted) - 6)  # drop {"v": and }
    wide = body.rlike("[^\\x00-\\x7F]")
    return F.when(wide, F.array_join(F.transform(F.split(body, ""), _escape_char), "")).otherwise(body)


def _escape_char(ch: Column) -> Column:
    code = F.ascii(ch)
    unit = lambda v: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(v)), 4, "0"))
    high, low = F.lit(55296) + F.floor((code - 65536) / 1024), F.lit(56320) + (code - 65536) % 1024
    return F.when(code > 65535, F.concat(unit(high), unit(low))).when(code > 127, unit(code)).otherwise(ch)


def ledger_payload() -> Column:
    """Key-sorted compact JSON of the fields a ledger row is hashed over; rows without a digest use the older field set."""
    pair = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    number = lambda c: F.col(c).cast("string")
    fields = [pair("centre_id", number("centre_id")), pair("ci_high", number("ci_high")), pair("ci_low", number("ci_low")),
              pair("created_at", json_string("created_at")), pair("defect_pct", number("defect_pct")), pair("farmer_name", json_string("farmer_name")),
              pair("grade_a_pct", number("grade_a_pct")), pair("lot_ref", json_string("lot_ref")), pair("n_bulbs", number("n_bulbs")),
              pair("n_looks", number("n_looks")), pair("officer_name", json_string("officer_name"))]
    digest = F.when(F.coalesce(F.col("result_sha256"), F.lit("")) != "", pair("result_sha256", json_string("result_sha256")))
    return F.concat(F.lit("{"), F.concat_ws(",", *fields, digest), F.lit("}"))


def result_integrity(lots: DataFrame) -> DataFrame:
    """covered: a digest is pinned; ok: the stored bytes still match it (NULL when nothing was pinned)."""
    covered = F.coalesce(F.col("result_sha256"), F.lit("")) != ""
    same = F.sha2(F.coalesce(F.col("result_json"), F.lit("")), 256) == F.col("result_sha256")
    return lots.withColumn("covered", covered).withColumn("digest_ok", F.when(covered, same))


def audit_chain(lots: DataFrame) -> DataFrame:
    """Per stored row: link to the previous row, recomputed row hash and pinned digest; ok when all hold.

    A bad row does not fail its successors: they are checked against the hash that is stored.
    """
    # Digests are checked first: the stored texts then need not be sorted with their rows.
    linked = previous(result_integrity(lots), "id", {"_before": "row_hash"}, ["centre_id"])
    before = F.coalesce(F.col("_before"), F.lit(GENESIS))
    x = linked.withColumn("link_ok", F.col("prev_hash") == before)
    x = x.withColumn("hash_ok", F.sha2(F.concat(ledger_payload(), before), 256) == F.col("row_hash"))
    ok = F.col("link_ok") & F.col("hash_ok") & F.coalesce(F.col("digest_ok"), F.lit(True))
    return x.withColumn("ok", ok).drop("_before")


def chain_status(audit: DataFrame) -> DataFrame:
    return audit.groupBy("centre_id").agg(F.bool_and("ok").alias("intact"), F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("ok")).alias("n_bad"))


def tampered_rows(lots: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Rows whose stored headline disagrees with digest-vouched content; rows nothing vouches for are listed apart."""
    x = result_integrity(lots).withColumn("truth", F.get_json_object("result_json", "$.grade_a_pct").try_cast("double"))
    vouched = F.coalesce(F.col("digest_ok"), F.lit(False))
    state = (F.when(~vouched, "unverifiable").when(F.col("truth").isNull(), "unreadable")
             .when(F.abs(F.col("grade_a_pct") - F.col("truth")) > tolerance, "tampered"))
    return x.withColumn("state", state).where(F.col("state").isNotNull()).select("id", "centre_id", "grade_a_pct", "truth", "state")


IDENTITY = ("centre_id", "lot_ref", "farmer_name", "officer_name", "n_bulbs", "n_looks", "grade_a_pct", "ci_low", "ci_high", "defect_pct")


def dedupe_finalised(lots: DataFrame, keys: Sequence[str] = IDENTITY, order: str = "id") -> DataFrame:
    """First stored row per identity key; missing names count as empty."""
    named = [F.coalesce(F.col(k), F.lit("")).alias(k) if k in ("farmer_name", "officer_name") else F.col(k) for k in keys]
    rest = [c for c in lots.columns if c not in keys]
    # A plain minimum is hashed where whole rows are sorted.
    first = F.struct(F.min(order).alias(order)) if rest == [order] else F.min_by(F.struct(*rest), order)
    return lots.select(*named, *rest).groupBy(*keys).agg(first.alias("_r"), F.count(F.lit(1)).alias("n_copies")).select(*keys, "_r.*", "n_copies")


# ---- Merkle log -------------------------------------------------------------------------------------------

_NODE = "sha2(concat(unhex('01'), unhex({0}), unhex({1})), 256)"
_PAIR_UP = ("transform(sequence(0, (size({a}) + 1) DIV 2 - 1), i -> IF(2 * i + 1 < size({a}), "
            + _NODE.format("{a}[2 * i]", "{a}[2 * i + 1]") + ", {a}[2 * i]))")


def leaf_hash(hex_digest) -> Column:
    """Leaf of a receipt digest: SHA-256 of a zero byte and the digest."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex(num(hex_digest))), 256)


def _groups(nodes: DataFrame, bits: int) -> DataFrame:
    """Runs of 2^bits neighbouring nodes as one ordered array: log, grp, nodes."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda x: x["node"])
    return nodes.groupBy("log", F.expr(f"shiftright(idx, {bits})").alias("grp")).agg(members.alias("nodes"))


def merkle_root(leaves: DataFrame, bits: int = treelog.BITS) -> DataFrame:
    """Root and size per log from leaves(log, idx, node)."""
    return treelog.range_roots(treelog.compact_ranges(leaves, bits=bits))


def _with_levels(groups: DataFrame, bits: int) -> DataFrame:
    last = "element_at(acc, -1)"
    return groups.selectExpr("log", "grp", f"aggregate(sequence(1, {bits}), array(nodes), (acc, s) -> concat(acc, array({_PAIR_UP.format(a=last)}))) AS levels")


def inclusion_proofs(leaves: DataFrame, bits: int = treelog.BITS, stages: int = treelog.STAGES) -> DataFrame:
    """Audit path of every leaf: log, idx, node, proof[] from the leaf level upwards; logs of up to 2^(bits * stages) leaves."""
    def build(nodes: DataFrame, stages: int) -> DataFrame:
        lv = _with_levels(_groups(nodes, bits), bits)
        part = "filter(transform(sequence(0, {b} - 1), l -> get(levels[l], CAST(shiftright(j, l) ^ 1 AS INT))), h -> h IS NOT NULL)".format(b=bits)
        own = (lv.selectExpr("log", "grp", "levels", "posexplode(levels[0]) AS (j, node)")
               .selectExpr("log", "grp", f"shiftleft(grp, {bits}) + j AS idx", "node", f"{part} AS part"))
        if stages == 1:
            return own.selectExpr("log", "idx", "node", "part AS proof")
        upper = build(lv.selectExpr("log", "grp AS idx", f"levels[{bits}][0] AS node"), stages - 1)
        return own.join(upper.selectExpr("log", "idx AS grp", "proof AS rest"), ["log", "grp"]).selectExpr("log", "idx", "node", "concat(part, rest) AS proof")
    return build(leaves.select("log", F.col("idx").cast("bigint").alias("idx"), "node"), stages)


def verify_inclusion(proofs: DataFrame) -> DataFrame:
    """Check proofs(log, idx, node, proof, size, root) as an untrusting reader would; adds ``ok``."""
    step = """aggregate(proof, named_struct('fn', CAST(idx AS BIGINT), 'sn', CAST(size - 1 AS BIGINT), 'r', node, 'ok', idx < size),
      (a, p) -> CASE WHEN a.sn = 0 THEN named_struct('fn', a.fn, 'sn', a.sn, 'r', a.r, 'ok', false)
        WHEN a.fn % 2 = 1 OR a.fn = a.sn THEN named_struct(
          'fn', shiftright(a.fn, 1 + IF(a.fn % 2 = 0 AND a.fn <> 0, bit_count((a.fn & -a.fn) - 1), 0)),
          'sn', shiftright(a.sn, 1 + IF(a.fn % 2 = 0 AND a.fn <> 0, bit_count((a.fn & -a.fn) - 1), 0)),
          'r', """ + _NODE.format("p", "a.r") + """, 'ok', a.ok)
        ELSE named_struct('fn', shiftright(a.fn, 1), 'sn', shiftright(a.sn, 1), 'r', """ + _NODE.format("a.r", "p") + """, 'ok', a.ok) END,
      a -> a.ok AND a.sn = 0 AND a.r = root)"""
    return proofs.withColumn("ok", F.expr(step))


def head_roots(heads: DataFrame, leaves: DataFrame, bits: int = treelog.BITS) -> DataFrame:
    """Root of the first ``size`` leaves for every head(log, size), from log2(size) subtree nodes each."""
    return treelog.prefix_roots(heads, treelog.boundary_nodes(leaves, heads, bits))


def tree_head_consistency(heads: DataFrame, leaves: DataFrame, bits: int = treelog.BITS) -> DataFrame:
    """Does each published head(log, size, root) still match the log's first ``size`` leaves?"""
    now = head_roots(heads, leaves, bits).withColumnRenamed("root", "recomputed")
    return heads.join(now, ["log", "size"], "left").withColumn("consistent", F.coalesce(F.col("root") == F.col("recomputed"), F.lit(False)))


def days_without_head(leaves: DataFrame, heads: DataFrame) -> DataFrame:
    """Days on which a log grew but no head was published."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    grown = leaves.groupBy("log", day("logged_at")).agg(F.count(F.lit(1)).alias("n_leaves"))
    return grown.join(heads.select("log", day("published_at")).distinct(), ["log", "day"], "left_anti")


# ---- receipts ---------------------------------------------------------------------------------------------

def revision_chain(receipts: DataFrame) -> DataFrame:
    """Per receipt: its parent is the previous revision's hash and revisions have no gap."""
    p = previous(receipts, "rev", {"_h": "hash", "_r": "rev"}, ["lot_id"], tie=["receipt_no"])
    first = F.col("_r").isNull()
    return (p.withColumn("parent_ok", F.when(first, F.col("parent").isNull()).otherwise(F.col("parent").eqNullSafe(F.col("_h"))))
            .withColumn("rev_ok", F.when(first, F.col("rev") == 0).otherwise(F.col("rev") == F.col("_r") + 1)).drop("_h", "_r"))


def canonical(value) -> str:
    """RFC 8785 text of a parsed JSON value: sorted keys, no blanks, shortest numbers."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _shortest(value)
    return json.dumps(value, ensure_ascii=False)


def _shortest(x: float) -> str:
    """ECMAScript number text."""
    if not math.isfinite(x):
        raise ValueError("non-finite number")
    if x == 0:
        return "0"
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, frac = mantissa.partition(".")
    frac = "" if frac == "0" else frac
    digits = (whole + frac).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + frac) - len((whole + frac).lstrip("0")))
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if n <= point <= 21:
        text = digits + "0" * (point - n)
    elif 0 < point <= 21:
        text = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        e = point - 1
        text = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return ("-" if x < 0 else "") + text


def receipt_digests(receipts: DataFrame, core: str = "core", stored: str = "hash", optional: Sequence[str] = ()) -> DataFrame:
    """Canonical digest of each receipt body, a column of declared type, and whether it equals the stored hash."""
    return (receipts.withColumn("digest", canonical_digest(core, receipts.schema[core].dataType, optional))
            .withColumn("hash_ok", F.coalesce(F.col(stored) == F.col("digest"), F.lit(False))))


def evidence_hash(pieces: DataFrame, order: Sequence[str] = ("shot_at", "capture_id", "pos"), value: str = "digest") -> DataFrame:
    """One digest per lot over its ordered piece digests, written as a JSON list of strings.

    SHA-256 is sequential, so each lot is folded in order; the fold streams over sorted partitions and holds one hash
    state, never a lot's whole list.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lot, state, out = None, None, []
        for b in batches:
            for key, d in zip(b["lot_id"], b[value]):
                if state is None or key != lot:
                    if state is not None:
                        state.update(b"]")
                        out.append((lot, state.hexdigest()))
                    lot, state = key, hashlib.sha256(b"[")
                    state.update(json.dumps(d).encode())
                else:
                    state.update(("," + json.dumps(d)).encode())
            if out:
                yield pd.DataFrame(out, columns=["lot_id", "evidence"])
                out = []
        if state is not None:
            state.update(b"]")
            yield pd.DataFrame([(lot, state.hexdigest())], columns=["lot_id", "evidence"])
    ordered = pieces.repartition("lot_id").sortWithinPartitions("lot_id", *order)
    return ordered.select("lot_id", value).mapInPandas(fold, "lot_id long, evidence string")


def regrade_check(stored: DataFrame, regraded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored headlines against a fresh grading; NULL where the pack is unknown.

    stored(lot_id, receipt_no, pack_known, known_pack_id, <columns>), regraded(lot_id, pack_id, <columns>).
    """
    fresh = regraded.select("lot_id", F.col("pack_id").alias("known_pack_id"), *[F.col(c).alias(f"now_{c}") for c in columns])
    j = stored.join(fresh, ["lot_id", "known_pack_id"], "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    return j.withColumn("headline_ok", F.when(F.col("pack_known"), same)).drop(*[f"now_{c}" for c in columns])
