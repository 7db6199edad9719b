"""Pooled looks (earlier record layout): lot summaries, cluster-aware intervals, sample sufficiency.

Items come as (lot_id, look_index, tray_id, cls, size_grade, decision); all statistics are mergeable sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import Z95, half_up, num, round_half_up, wilson_percent
from lotlens.operators.measure import CLASS_NAMES, GRADES, class_name, decide, size_grade

OCCLUSION_1LOOK, OCCLUSION_2LOOK = 1.0, 1.0


def classified(items: DataFrame) -> DataFrame:
    """Add class, size band and decision to raw observations."""
    return (items.withColumn("class", class_name("cls")).withColumn("size_grade", size_grade("diameter_mm"))
            .withColumn("decision", decide("confidence")))


def pool_looks(items: DataFrame, factor1: float = OCCLUSION_1LOOK, factor2: float = OCCLUSION_2LOOK) -> DataFrame:
    """One row per lot: class and size counts over all observations, the worst look's defect rate, occlusion-corrected."""
    defect = F.col("class") != "sound"
    per_look = items.groupBy("lot_id", "look_index").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(defect).alias("k"),
        *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in CLASS_NAMES],
        *[F.count_if(F.col("size_grade") == g).alias(f"g_{g}") for g in GRADES],
        F.count_if(F.col("decision") == "REFER").alias("n_referred"))
    rate = F.col("k") / F.col("n")
    sums = ["n", *[f"n_{c}" for c in CLASS_NAMES], *[f"g_{g}" for g in GRADES], "n_referred"]
    lot = per_look.groupBy("lot_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_looks"), F.max(rate).alias("defect_rate_raw"),
        # the earliest look wins among equally bad ones
        F.max_by(F.struct("k", "n"), F.struct(rate, -F.col("look_index"))).alias("worst"))
    trays = items.groupBy("lot_id").agg(F.count_distinct("tray_id").alias("d")).select(
        "lot_id", F.when(F.col("d") > 0, F.col("d")).otherwise(F.lit(1)).cast("bigint").alias("n_trays"))
    factor = F.when(F.col("n_looks") >= 2, F.lit(factor2)).otherwise(F.lit(factor1))
    lo, hi = wilson_percent("g_A", "n")
    out = lot.join(trays, "lot_id").withColumn("occlusion_factor", factor)
    return (out.withColumn("grade_a_pct", F.col("g_A") * 100.0 / F.col("n")).withColumn("grade_a_lo", lo).withColumn("grade_a_hi", hi)
            .withColumn("defect_pct_raw", F.col("defect_rate_raw") * 100.0)
            .withColumn("defect_pct", F.least(F.lit(1.0), F.col("defect_rate_raw") / F.col("occlusion_factor")) * 100.0)
            .withColumn("worst_k", F.col("worst.k")).withColumn("worst_n", F.col("worst.n")).drop("worst", "defect_rate_raw"))


def defect_interval(pooled: DataFrame) -> DataFrame:
    """Wilson bounds of the worst look, both ends divided by the occlusion factor and limited to 100 %."""
    lo, hi = wilson_percent("worst_k", "worst_n")
    c = F.when(F.col("occlusion_factor") > 0, F.col("occlusion_factor")).otherwise(F.lit(1.0))
    return pooled.select("lot_id", "worst_k", "worst_n", F.least(F.lit(100.0), lo / c).alias("defect_lo"),
                         F.least(F.lit(100.0), hi / c).alias("defect_hi"))


def look_deff(n_looks, rho: float = 1.0):
    """Design effect of m repeated looks: 1 + (m - 1) * rho, rho limited to [0, 1]."""
    return F.lit(1.0) + (F.greatest(F.lit(1), num(n_looks)) - 1) * max(0.0, min(1.0, rho))


def grade_a_interval(pooled: DataFrame, rho: float = 1.0) -> DataFrame:
    """Grade-A interval crediting every physical item once however often it was seen."""
    d = look_deff("n_looks", rho)
    lo, hi = wilson_percent("g_A", "n", d)
    return pooled.select("lot_id", F.col("n").alias("n_observations"), F.floor(F.col("n") / d).alias("n_effective"), d.alias("design_effect"),
                         F.when(d == 1.0, "wilson-independent").otherwise("wilson-clustered-two-look").alias("method"),
                         lo.alias("grade_a_lo"), hi.alias("grade_a_hi"), F.col("grade_a_lo").alias("pooled_lo"), F.col("grade_a_hi").alias("pooled_hi"))


def pooled_defect_interval(items: DataFrame, pooled: DataFrame) -> DataFrame:
    """All sightings over all observations; each tray's observations are divided by the looks that touched it."""
    tray = F.coalesce(F.nullif(F.col("tray_id"), F.lit("")), F.lit("_"))
    per_tray = (items.groupBy("lot_id", tray.alias("tray"), "look_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") != "sound").alias("k"))
                .groupBy("lot_id", "tray").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("m")))
    lot = per_tray.groupBy("lot_id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") / F.col("m")).alias("n_eff"), F.count(F.lit(1)).alias("trays"))
    d = F.col("n") / F.col("n_eff")
    lo, hi = wilson_percent("k", "n", d)
    pct = F.col("k") * 100.0 / F.col("n")
    return lot.join(pooled.select("lot_id", "defect_pct"), "lot_id").select(
        "lot_id", pct.alias("pooled_pct"), lo.alias("pooled_lo"), hi.alias("pooled_hi"), F.floor("n_eff").alias("n_effective"), d.alias("design_effect"),
        "trays", (F.col("defect_pct") - pct).alias("gap_points"))


def sample_sufficiency(lots: DataFrame, target: float = 6.0, n="n", pct="grade_a_pct", looks="n_looks") -> DataFrame:
    """Does the sample reach the promised half-width, and how many more observations would?"""
    m = F.greatest(F.lit(1), F.least(num(looks), F.greatest(F.lit(1), num(n))))
    p = F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), num(pct))) / 100.0, F.lit(0.5))
    base = lots.withColumn("_d", look_deff(m)).withColumn("_p", p)
    lo, hi = wilson_percent(half_up(F.col("_p") * num(n)), n, F.col("_d"))
    w = target / 100.0
    distinct = F.ceil(F.lit(Z95 * Z95) * F.col("_p") * (F.lit(1.0) - F.col("_p")) / (w * w))
    out = base.withColumn("n_required_distinct", distinct).withColumn("n_required_observations", F.ceil(F.col("n_required_distinct") * F.col("_d")))
    extra = F.greatest(F.lit(0), F.col("n_required_observations") - num(n))
    return out.select("lot_id", num(n).alias("n_observations"), round_half_up((hi - lo) / 2.0, 4).alias("half_width"), "n_required_distinct", "n_required_observations",
                      F.col("_d").alias("design_effect"), F.greatest(F.lit(1), F.floor(num(n) / F.col("_d"))).alias("n_effective"),
                      extra.cast("bigint").alias("extra_needed"), F.when(extra == 0, "SUFFICIENT").otherwise("MORE_DATA").alias("verdict"))
