"""Rule packs: versioned grading limits as data.

Units are integers: sizes in tenths of a millimetre, surface shares in per-mille, confidence in per-mille.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens import schema

BUCKETS = ("GRADE_A", "URS", "REJECT", "REFER")
DEFECTS = ("blackening", "rot", "sunburn", "spots", "sprouting", "peeled", "cut")
SHAPES = ("double", "bottleneck", "split")
DEFAULT_PACK_ID = "in-psf-2026-07-30-a-only"


@dataclass(frozen=True)
class Rule:
    measure: str
    op: str
    limit: int
    na: str = "pass"


@dataclass(frozen=True)
class Bucket:
    id: str
    label: str
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class Pack:
    id: str
    effective_from: str
    effective_to: str | None
    buckets: tuple[Bucket, ...]
    procured: tuple[str, ...]
    bad: tuple[str, ...]
    reject_rules: tuple[Rule, ...]
    version: str = "1.0.0"
    size_metric: str = "min_feret"
    k_sigma: float = 1.645
    min_conf: int = 600
    look_merge: str = "max_nonA"
    p0: float = 0.1
    p1: float = 0.25
    alpha: float = 0.05
    beta: float = 0.1
    max_trays: int = 8
    refer_share_max: float = 0.25
    bootstrap_b: int = 2000
    extra: dict = field(default_factory=dict, compare=False)

    def stages(self) -> list[tuple[int, str, tuple[Rule, ...]]]:
        """(stage number, outcome bucket, rules); stage 0 holds the outright reject rules."""
        return [(0, "REJECT", self.reject_rules),
                *[(i, b.id, b.rules) for i, b in enumerate(self.buckets, start=1)]]


def _rules(*specs: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(*s) for s in specs)


# The limits, dates and thresholds of the five published packs.
_REJECT = _rules(("rot", "<=", 10), ("sprouting", "<=", 10), ("cut", "<=", 20))
_GRADE_A_SURFACE = (("blackening", "<=", 50), ("spots", "<=", 100), ("sunburn", "<=", 20), ("peeled", "<=", 100),
                    ("double", "==", 0), ("bottleneck", "==", 0), ("split", "==", 0))
_URS_SURFACE = (("blackening", "<=", 300), ("spots", "<=", 400), ("sunburn", "<=", 100), ("split", "==", 0))
_A_45_65 = Bucket("GRADE_A", "Grade A", _rules(("size", ">=", 450), ("size", "<=", 650), *_GRADE_A_SURFACE))
_A_FROM_55 = Bucket("GRADE_A", "Grade A", _rules(("size", ">=", 550), *_GRADE_A_SURFACE))
_URS_35_70 = _rules(("size", ">=", 350), ("size", "<=", 700), *_URS_SURFACE)
_URS_FROM_45 = _rules(("size", ">=", 450), *_URS_SURFACE)

PACKS: tuple[Pack, ...] = (
    Pack("in-psf-2026-pre-a", "2026-05-15", "2026-06-03", (_A_45_65,), ("GRADE_A",), ("REJECT",), _REJECT),
    Pack("in-psf-2026-pre-b", "2026-05-15", "2026-06-03", (_A_FROM_55,), ("GRADE_A",), ("REJECT",), _REJECT),
    Pack("in-psf-2026-06-relaxed-a", "2026-06-04", "2026-07-29",
         (_A_45_65, Bucket("URS", "URS (relaxed)", _URS_35_70)), ("GRADE_A", "URS"), ("REJECT",), _REJECT),
    Pack("in-psf-2026-06-relaxed-b", "2026-06-04", "2026-07-29",
         (_A_FROM_55, Bucket("URS", "URS (relaxed)", _URS_FROM_45)), ("GRADE_A", "URS"), ("REJECT",), _REJECT),
    Pack("in-psf-2026-07-30-a-only", "2026-07-30", None,
         (_A_45_65, Bucket("URS", "URS (not procured)", _URS_35_70)), ("GRADE_A",), ("URS", "REJECT"), _REJECT),
)


def pack_by_id(pack_id: str) -> Pack:
    return next(p for p in PACKS if p.id == pack_id)


def default_pack() -> Pack:
    return pack_by_id(DEFAULT_PACK_ID)


def pack_document(p: Pack) -> dict:
    """The pack as a JSON-ready document, the form written to and read from pack files."""
    rule = lambda r: {"m": r.measure, "op": r.op, "v": r.limit, **({"na": r.na} if r.na != "pass" else {})}
    return {
        "id": p.id, "version": p.version, "effective_from": p.effective_from,
        **({"effective_to": p.effective_to} if p.effective_to else {}),
        "size_metric": p.size_metric, "k_sigma": p.k_sigma, "refer": {"min_conf": p.min_conf},
        "reject_rules": [rule(r) for r in p.reject_rules],
        "buckets": [{"id": b.id, "label": b.label, "rules": [rule(r) for r in b.rules]} for b in p.buckets],
        "procured": list(p.procured),
        "lot": {"look_merge": p.look_merge, "max_trays": p.max_trays, "refer_share_max": p.refer_share_max,
                "bootstrap_b": p.bootstrap_b,
                "sprt": {"bucket_set": list(p.bad), "p0": p.p0, "p1": p.p1, "alpha": p.alpha, "beta": p.beta}},
    }


def pack_hash(p: Pack) -> str:
    """SHA-256 of the key-sorted compact document."""
    text = json.dumps(pack_document(p), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


# ---- pack tables -------------------------------------------------------------------------------------

def packs_values_sql(packs: tuple[Pack, ...] = PACKS) -> str:
    """The pack dimension as a VALUES query that Spark and other SQL engines read alike."""
    rows = ",\n".join(
        f"('{p.id}', {i}, '{p.version}', '{pack_hash(p)}', '{p.effective_from}', "
        f"{repr(p.effective_to) if p.effective_to else 'CAST(NULL AS STRING)'}, '{p.size_metric}', "
        f"CAST({p.k_sigma} AS DOUBLE), {p.min_conf}, '{','.join(p.procured)}', '{','.join(p.bad)}', "
        f"CAST({p.p0} AS DOUBLE), CAST({p.p1} AS DOUBLE), CAST({p.alpha} AS DOUBLE), CAST({p.beta} AS DOUBLE), "
        f"{p.max_trays}, CAST({p.refer_share_max} AS DOUBLE))" for i, p in enumerate(packs))
    return ("SELECT * FROM (VALUES " + rows + ") AS t(pack_id, pack_ord, version, pack_hash, effective_from, "
            "effective_to, size_metric, k_sigma, min_conf, procured, bad, p0, p1, alpha, beta, max_trays, "
            "refer_share_max)")


def pack_rules_values_sql(packs: tuple[Pack, ...] = PACKS) -> str:
    rows = []
    for p in packs:
        for stage, bucket, rules in p.stages():
            for ord_, r in enumerate(rules):
                rows.append(f"('{p.id}', {stage}, '{bucket}', {ord_}, '{r.measure}', '{r.op}', {r.limit}, '{r.na}')")
    return ("SELECT * FROM (VALUES " + ",\n".join(rows) + ") AS t(pack_id, stage, bucket, rule_ord, measure, op, "
            "lim, na)")


def packs_table(spark: SparkSession, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    """Pack dimension as a local relation: its size is known to the planner, so joins broadcast it by size."""
    return spark.sql(packs_values_sql(packs))


def pack_rules_table(spark: SparkSession, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    return spark.sql(pack_rules_values_sql(packs))


def read_rule_packs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pack JSON documents (one per file, or one per line) as a nested table."""
    return spark.read.schema(schema.PACK).option("recursiveFileLookup", True).option("multiLine", not lines).json(path)


def explode_pack_rules(packs: DataFrame) -> DataFrame:
    """Nested packs -> one row per rule: pack_id, stage, bucket, rule_ord, measure, op, lim, na."""
    reject = packs.select(F.col("id").alias("pack_id"), F.lit(0).alias("stage"), F.lit("REJECT").alias("bucket"),
                          F.posexplode("reject_rules").alias("rule_ord", "r"))
    bucket = (packs.select(F.col("id").alias("pack_id"), F.posexplode("buckets").alias("rank", "b"))
              .select("pack_id", (F.col("rank") + 1).alias("stage"), F.col("b.id").alias("bucket"),
                      F.posexplode("b.rules").alias("rule_ord", "r")))
    return reject.unionByName(bucket).select(
        "pack_id", "stage", "bucket", "rule_ord", F.col("r.m").alias("measure"), F.col("r.op").alias("op"),
        F.col("r.v").alias("lim"), F.coalesce(F.col("r.na"), F.lit("pass")).alias("na"))


def packs_from_documents(docs: list[dict]) -> tuple[Pack, ...]:
    """Pack objects from parsed documents (a handful of configuration rows, read on the driver)."""
    rule = lambda r: Rule(r["m"], r["op"], int(r["v"]), r.get("na") or "pass")
    return tuple(
        Pack(d["id"], d["effective_from"], d.get("effective_to"),
             tuple(Bucket(b["id"], b["label"], tuple(rule(r) for r in b["rules"])) for b in d["buckets"]),
             tuple(d["procured"]), tuple(d["lot"]["sprt"]["bucket_set"]), tuple(rule(r) for r in d["reject_rules"]),
             d["version"], d["size_metric"], float(d["k_sigma"]), int(d["refer"]["min_conf"]), d["lot"]["look_merge"],
             float(d["lot"]["sprt"]["p0"]), float(d["lot"]["sprt"]["p1"]), float(d["lot"]["sprt"]["alpha"]),
             float(d["lot"]["sprt"]["beta"]), int(d["lot"]["max_trays"]), float(d["lot"]["refer_share_max"]),
             int(d["lot"]["bootstrap_b"])) for d in docs)
