"""Measurements to lot results as one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import round_half_up
from lotlens.operators import lots as L
from lotlens.operators import rules as R
from lotlens.plans.session import materialise
from lotlens.sources.packs import PACKS, Pack


def graded_looks(bulbs: DataFrame, packs: Sequence[Pack] = PACKS, overrides: DataFrame | None = None) -> DataFrame:
    """Verdicts tallied per lot, pack, tray and look, with human actions folded in as signed corrections."""
    rows = R.bucket_verdicts(bulbs, packs, ("lot_id", "tray", "look", "w"))
    if overrides is None:
        return L.look_aggregates(rows)
    rows = rows.withColumn("k", F.lit(1))
    changes = R.verdict_changes(bulbs, packs, overrides)
    return L.look_aggregates(rows.unionByName(changes), "k")


def graded_trays(bulbs: DataFrame, packs: Sequence[Pack] = PACKS, overrides: DataFrame | None = None,
                 mode: str | None = None) -> DataFrame:
    """Trays with their looks merged as each pack says, or all by ``mode``."""
    looks = graded_looks(bulbs, packs, overrides)
    return L.merge_looks(looks, mode) if mode else L.merge_looks_by_pack(looks, packs)


def lot_results(trays: DataFrame, packs: Sequence[Pack] = PACKS, b: int | None = None,
                seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(share intervals, decisions) of every lot under every pack; see cluster_bootstrap for replicates and seeds.

    Trays are written once: sums, design effects and both resampling forms read them, and the items are scanned once.
    """
    trays = materialise(trays)
    totals = L.lot_totals(trays, packs)
    intervals = L.lot_intervals(L.lot_shares(trays, packs), L.cluster_bootstrap(trays, packs, b, seeds=seeds))
    return intervals, L.lot_decision(L.sprt(totals, packs), packs)


def grade_lots(bulbs: DataFrame, packs: Sequence[Pack] = PACKS, overrides: DataFrame | None = None,
               b: int | None = None, seeds: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Full result of every lot under every pack in one job, or of the pairs ``only`` (lot_id, pack_id) names.

    Beside the headline by weight: sizes, the sequential test (llr and its two limits), the Grade-A design effect, the
    numbers of overriding and contesting actions, and ``shares``, for each basis and bucket the estimate with its interval
    and Jeffreys bounds. Non-Grade-A per look stays in rows (graded_looks).
    """
    trays = graded_trays(bulbs, packs, overrides)
    trays = trays if only is None else trays.join(only, ["lot_id", "pack_id"], "left_semi")
    intervals, decisions = lot_results(trays, packs, b, seeds)
    extra = decisions.select("lot_id", "pack_id", "n_trays", "n_looks", F.col("n").cast("bigint").alias("n_items"), "refer_share", "trays_more",
                             *[round_half_up(c, 2).alias(name) for c, name in (("deff_a", "deff"), ("llr", "llr"), ("upper", "llr_reject"), ("lower", "llr_accept"))])
    entry = F.struct("basis", "bucket", F.expr("CAST(floor(p * n + 0.5) AS BIGINT)").alias("k"), "est", "ci_lo", "ci_hi", "method", "bayes_lo", "bayes_hi")
    wide = L.headline(L.with_jeffreys(intervals), decisions, F.sort_array(F.collect_list(entry)).alias("shares"))  # ten per lot and pack
    out = wide.join(extra, ["lot_id", "pack_id"])
    out = out.select(*[c for c in out.columns if c != "shares"], "shares")
    if overrides is None:
        return out.select("*", F.lit(0).cast("bigint").alias("overridden"), F.lit(0).cast("bigint").alias("contested"))
    actions = overrides.groupBy("lot_id").agg(F.count_if(F.col("kind") == "override").alias("overridden"), F.count_if(F.col("kind") == "contest").alias("contested"))
    return out.join(actions, "lot_id", "left").fillna(0, ["overridden", "contested"])


def graded_bucket_table(bulbs: DataFrame, pack: Pack) -> DataFrame:
    """The smallest useful result: items and estimated shares per lot and bucket under one pack."""
    shares = L.lot_shares(graded_trays(bulbs, [pack]), [pack])
    by = shares.where(F.col("bucket") != "PROCURED").groupBy("lot_id", "bucket")
    pick = lambda basis, c: F.max(F.when(F.col("basis") == basis, F.col(c)))
    return by.agg(pick("count", "x").cast("bigint").alias("n"), pick("count", "est").alias("est_by_count"),
                  pick("weight", "est").alias("est_by_weight"))
