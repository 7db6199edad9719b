"""Comparing independent gradings of one lot, and what grade mixes are worth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import half_up, num
from lotlens.functions.ordered import previous

def erfc(x) -> Column:
    """Complementary error function of x >= 0 as an expression; below 1e-14 it is 0.

    1 - 2/sqrt(pi) x exp(-x^2) (1 + 2x^2/3 (1 + 2x^2/5 (1 + ...))), whose terms are all positive.
    """
    x = num(x).cast("double")
    y, nest = x * x * 2.0, F.lit(1.0)
    for odd in range(181, 1, -2):
        nest = y / float(odd) * nest + 1.0
    value = F.lit(1.0) - x * F.exp(-x * x) * nest * (2.0 / math.sqrt(math.pi))
    return F.when(x.isNull(), x).when(x > 5.6, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), value))


def two_proportion_z(ka, na, kb, nb) -> Column:
    """Pooled two-proportion z; 0 when there is no evidence either way."""
    ka, na, kb, nb = (num(v).cast("double") for v in (ka, na, kb, nb))
    p = (ka + kb) / (na + nb)
    se = F.sqrt(p * (F.lit(1.0) - p) * (F.lit(1.0) / na + F.lit(1.0) / nb))
    return F.when((na > 0) & (nb > 0) & (se > 0), (ka / na - kb / nb) / se).otherwise(F.lit(0.0))


def two_sided_p(z) -> Column:
    return erfc(F.abs(num(z)) / math.sqrt(2.0))


def normal_quantile(q: float) -> float:
    """Standard normal quantile by bisection on erfc (a constant, computed once on the driver)."""
    lo, hi = -10.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < q else (lo, mid)
    return (lo + hi) / 2


def successive_gradings(gradings: DataFrame) -> DataFrame:
    """Comparison requests: each grading of a lot against the one before it (a_id, b_id)."""
    p = previous(gradings.select("lot_ref", "id"), "id", {"a_id": "id"}, ["lot_ref"])
    return p.where(F.col("a_id").isNotNull()).select("a_id", F.col("id").alias("b_id"))


def requested_pairs(requests: DataFrame, gradings: DataFrame) -> DataFrame:
    """Both sides of every requested comparison, joined by id; a lot is never paired with itself all-against-all."""
    cols = [c for c in gradings.columns if c != "id"]
    side = lambda s: gradings.select(F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    return requests.where(F.col("a_id") != F.col("b_id")).join(side("a"), "a_id").join(side("b"), "b_id")


def compare_gradings(pairs: DataFrame, alpha: float = 0.05, min_gap: float = 10.0) -> DataFrame:
    """AGREE when intervals touch, DISPUTE when the gap is large and significant, else REVIEW.

    Expects a_/b_ columns pct, lo, hi (percent) and n. Agreement yields an estimate weighted by inverse squared width.
    """
    pct = lambda s: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(f"{s}_pct")))
    x = pairs
    for s in ("a", "b"):
        c = lambda v: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(v)))
        x = (x.withColumn(f"{s}_pct", pct(s)).withColumn(f"{s}_lo", F.least(c(f"{s}_lo"), F.col(f"{s}_pct")))
             .withColumn(f"{s}_hi", F.greatest(c(f"{s}_hi"), F.col(f"{s}_pct")))
             .withColumn(f"{s}_k", half_up(F.col(f"{s}_pct") * F.col(f"{s}_n") / 100.0)))
    overlap = F.greatest("a_lo", "b_lo") <= F.least("a_hi", "b_hi")
    x = x.withColumn("z", two_proportion_z("a_k", "a_n", "b_k", "b_n")).withColumn("gap", F.abs(F.col("a_pct") - F.col("b_pct"))).withColumn("overlap", overlap)
    significant = F.abs("z") > normal_quantile(1.0 - alpha / 2.0)
    verdict = F.when(F.col("overlap"), "AGREE").when(significant & (F.col("gap") >= min_gap), "DISPUTE").otherwise("REVIEW")
    w = lambda s: F.greatest(F.lit(1e-9), F.pow(F.col(f"{s}_hi") - F.col(f"{s}_lo"), F.lit(2.0)))
    both = (F.col("a_pct") / w("a") + F.col("b_pct") / w("b")) / (F.lit(1.0) / w("a") + F.lit(1.0) / w("b"))
    return x.withColumn("verdict", verdict).withColumn("combined_pct", F.when(F.col("verdict") != "DISPUTE", both))


# Demonstration rates in rupees per quintal.
DEFAULT_RATES = {"A": 2400.0, "B": 1800.0, "C": 1200.0, "UNDERSIZED": 800.0, "UNKNOWN": 1000.0}


def price_band(mix: DataFrame, rates: DataFrame) -> DataFrame:
    """Central price of a grade mix and its band when Grade A moves to its interval bounds.

    mix(lot_id, grade, pct, ci_lo, ci_hi) in long form; the other grades absorb the shift pro rata.
    """
    known = mix.join(rates, "grade").withColumn("pct", F.greatest(F.lit(0.0), F.col("pct")))
    lot = known.groupBy("lot_id").agg(
        F.sum("pct").alias("total"), F.sum(F.col("pct") * F.col("rate")).alias("value"), F.max("ci_lo").alias("lo"), F.max("ci_hi").alias("hi"),
        F.max(F.when(F.col("grade") == "A", F.col("pct"))).alias("a"), F.max(F.when(F.col("grade") == "A", F.col("rate"))).alias("rate_a"))
    lot = lot.where(F.col("total") > 0)
    central = F.col("value") / F.col("total")
    a = F.col("a") * 100.0 / F.col("total")
    rest_value = central - a * F.col("rate_a") / 100.0
    clamp = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))

    def shifted(target):
        scaled = target * F.col("rate_a") / 100.0 + F.when(a < 100.0, rest_value * (F.lit(100.0) - target) / (F.lit(100.0) - a)).otherwise(F.lit(0.0))
        return F.when(F.col("a").isNull(), central).otherwise(scaled)
    p1, p2 = shifted(clamp(F.col("lo"))), shifted(clamp(F.col("hi")))
    out = lot.select("lot_id", central.alias("central"), F.least(p1, p2).alias("band_low"), F.greatest(p1, p2).alias("band_high"))
    limits = rates.agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"))
    return (out.withColumn("floor_price", limits.select("lo").scalar()).withColumn("ceiling_price", limits.select("hi").scalar()))


def grade_mix(pooled: DataFrame, lo: str = "grade_a_lo", hi: str = "grade_a_hi") -> DataFrame:
    """Long grade mix of pooled lots for pricing."""
    rows = ", ".join(f"named_struct('grade', '{g}', 'pct', 100.0D * g_{g} / n)" for g in DEFAULT_RATES)
    return pooled.selectExpr("lot_id", f"{lo} AS ci_lo", f"{hi} AS ci_hi", f"inline(array({rows}))")


def price_exposure(lots: DataFrame, quintals: str, points: str, rates: dict[str, float] | None = None) -> DataFrame:
    """Rupees at stake when ``points`` of Grade A are really B or really C, over the lot's mass."""
    r = rates or DEFAULT_RATES
    return (lots.withColumn("exposure_to_b", F.col(points) * ((r["A"] - r["B"]) / 100.0) * F.col(quintals))
            .withColumn("exposure_to_c", F.col(points) * ((r["A"] - r["C"]) / 100.0) * F.col(quintals)))
