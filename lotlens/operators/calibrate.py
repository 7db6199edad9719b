"""Confidence calibration and detection scoring."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import num
from lotlens.functions.ordered import linear_percentiles, running_sums

EPS = 1e-6


def reliability_bins(pairs: DataFrame, n_bins: int = 10, min_count: int = 1) -> DataFrame:
    """Equal-width confidence bins, the last one closed; empty bins are present with NULL means."""
    b = F.least(F.floor(F.col("conf") * n_bins), F.lit(n_bins - 1)).cast("int")
    got = pairs.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"), F.avg("correct").alias("accuracy"))
    bins = pairs.sparkSession.sql(f"SELECT explode(sequence(0, {n_bins - 1})) AS bin")
    j = bins.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    keep = F.col("n") >= min_count
    return j.select("bin", (F.col("bin") / n_bins).alias("lo"), ((F.col("bin") + 1) / n_bins).alias("hi"), "n",
                    F.when(keep, F.col("mean_conf")).alias("mean_conf"), F.when(keep, F.col("accuracy")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected and maximum calibration error over non-empty bins. One row."""
    gap = F.abs(F.col("mean_conf") - F.col("accuracy"))
    return bins.where(F.col("n") > 0).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.sum("n").alias("n"))


def recommend_threshold(pairs: DataFrame, target: float = 0.95, min_support: int = 30) -> DataFrame:
    """Smallest cut whose inclusive top slice meets the target with enough support. One row; NULLs when no cut does."""
    c = pairs.groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k"))
    r = running_sums(c, "conf", {"support": F.col("n"), "hits": F.col("k")}, descending=True)
    total = c.agg(F.sum("n").alias("t")).scalar()
    ok = (F.col("support") >= min_support) & (F.col("hits") / F.col("support") >= target - 1e-12)
    row = F.struct(F.col("conf").alias("threshold"), "support", (F.col("hits") / F.col("support")).alias("achieved"))
    best = r.agg(F.min(F.when(ok, row)).alias("b"))
    return best.select("b.threshold", "b.achieved", "b.support").withColumn("referred", total - F.col("support"))


def logit(p) -> Column:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1.0 - EPS), num(p)))
    return F.ln(q / (F.lit(1.0) - q))


def apply_temperature(conf, temperature) -> Column:
    """Confidence with its logit divided by a temperature."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(conf) / num(temperature)))


def _losses(counts: DataFrame, temps: Sequence[float]) -> DataFrame:
    """Mean binary cross-entropy per temperature over distinct (conf, correct) counts."""
    g = counts.select("conf", "correct", "n", F.explode(F.array(*[F.lit(float(x)) for x in temps])).alias("temperature"))
    p = F.greatest(F.lit(EPS), F.least(F.lit(1.0 - EPS), apply_temperature("conf", "temperature")))
    bce = -(F.col("correct") * F.ln(p) + (F.lit(1) - F.col("correct")) * F.ln(F.lit(1.0) - p))
    return g.groupBy("temperature").agg((F.sum(bce * F.col("n")) / F.sum("n")).alias("loss"))


def temperature_grid(lo: float = 0.05, hi: float = 20.0, points: int = 61) -> list[float]:
    a, b = math.log(lo), math.log(hi)
    return [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]


def temperature_losses(pairs: DataFrame, temps: Sequence[float] | None = None) -> DataFrame:
    counts = pairs.groupBy("conf", "correct").agg(F.count(F.lit(1)).alias("n"))
    return _losses(counts, temps or temperature_grid())


def fit_temperature(pairs: DataFrame, lo: float = 0.05, hi: float = 20.0, points: int = 61, refine: int = 41, rounds: int = 3) -> DataFrame:
    """Temperature minimising cross-entropy: a log grid, then ever finer grids around the best point so far.

    Each round divides the step by half the points of its grid, so three rounds reach about 1e-5 of the temperature. All
    run over distinct (conf, correct) counts in one query. Confidences pinned at one half fit nothing and return 1. One
    row with losses and calibration errors before and after.
    """
    counts = pairs.groupBy("conf", "correct").agg(F.count(F.lit(1)).alias("n"))
    at = _losses(counts, temperature_grid(lo, hi, points)).agg(F.min_by("temperature", F.struct("loss", "temperature")).alias("t")).scalar()
    step = (math.log(hi) - math.log(lo)) / (points - 1)
    p = F.greatest(F.lit(EPS), F.least(F.lit(1.0 - EPS), apply_temperature("conf", "temperature")))
    bce = -(F.col("correct") * F.ln(p) + (F.lit(1) - F.col("correct")) * F.ln(F.lit(1.0) - p))
    for _ in range(rounds):
        factors = [math.exp(step * (2.0 * i / (refine - 1) - 1.0)) for i in range(refine)]
        around = counts.select("conf", "correct", "n", at.alias("_t")).select("*", F.explode(F.array(*[F.lit(x) for x in factors])).alias("_f"))
        around = around.withColumn("temperature", F.least(F.lit(hi), F.greatest(F.lit(lo), F.col("_t") * F.col("_f"))))
        losses = around.groupBy("temperature").agg((F.sum(bce * F.col("n")) / F.sum("n")).alias("loss"))
        best = losses.agg(F.min_by("temperature", F.struct("loss", "temperature")).alias("t"), F.min("loss").alias("loss"))
        at, step = best.select("t").scalar(), step * 2 / (refine - 1)
    pinned = counts.agg((F.max(F.abs(logit("conf"))) < 1e-6).alias("pinned")).scalar()
    before = _losses(counts, [1.0]).select("loss").scalar()
    out = best.select(F.when(pinned, F.lit(1.0)).otherwise(F.col("t")).alias("temperature"), before.alias("bce_before"),
                      F.when(pinned, before).otherwise(F.col("loss")).alias("bce_after"))
    scaled = pairs.select("correct", "conf", out.select("temperature").scalar().alias("_t")).select("correct", apply_temperature("conf", "_t").alias("conf"))
    ece = lambda d: calibration_error(reliability_bins(d)).select("ece").scalar()
    return out.withColumn("ece_before", ece(pairs)).withColumn("ece_after", ece(scaled)).withColumn("improved", F.col("ece_after") < F.col("ece_before"))


def precision_recall(matched: DataFrame, n_truth: Column, threshold: float) -> DataFrame:
    """Precision over calls at a cut and recall over all truths. One row."""
    called = F.col("conf") >= threshold
    s = matched.agg(F.count_if(called).alias("called"), F.count_if(called & (F.col("correct") == 1)).alias("tp")).withColumn("n_truth", n_truth)
    p, r = F.col("tp") / F.col("called"), F.col("tp") / F.col("n_truth")
    ok = (F.col("called") > 0) & (F.col("n_truth") > 0)
    f1 = F.when(p + r > 0, p * r * 2.0 / (p + r)).otherwise(F.lit(0.0))
    return s.select("called", "tp", "n_truth", F.when(ok, p).alias("precision"), F.when(ok, r).alias("recall"), F.when(ok, f1).alias("f1"))


def per_tray_errors(trays: DataFrame) -> DataFrame:
    """Signed and absolute errors with one and two looks; a missing second look falls back to the first and is flagged.

    trays(tray_id, true_a, true_d, a1, d1, a2, d2) in percent.
    """
    two = F.col("a2").isNotNull() & F.col("d2").isNotNull()
    x = trays.withColumn("n_looks_used", F.when(two, 2).otherwise(1)).withColumn("_a2", F.when(two, F.col("a2")).otherwise(F.col("a1"))).withColumn("_d2", F.when(two, F.col("d2")).otherwise(F.col("d1")))
    cols = []
    for name, pred, true in (("grade_a_1look", "a1", "true_a"), ("defect_1look", "d1", "true_d"), ("grade_a_2look", "_a2", "true_a"), ("defect_2look", "_d2", "true_d")):
        e = F.col(pred) - F.col(true)
        cols += [F.col(pred).alias(f"pred_{name}"), e.alias(f"err_{name}"), F.abs(e).alias(f"abs_err_{name}")]
    return x.select("tray_id", "n_looks_used", F.col("true_a").alias("true_grade_a_pct"), F.col("true_d").alias("true_defect_pct"), *cols)


METRICS = ("grade_a_1look", "grade_a_2look", "defect_1look", "defect_2look")


def long_errors(errors: DataFrame) -> DataFrame:
    rows = ", ".join(f"named_struct('metric', '{m}', 'err', err_{m})" for m in METRICS)
    return errors.selectExpr("tray_id", f"inline(array({rows}))").withColumn("abs_err", F.abs("err"))


def error_report(errors: DataFrame) -> DataFrame:
    """n, mean absolute error, 95th percentile and bias per metric."""
    e = long_errors(errors)
    s = e.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("abs_err").alias("mae"), F.avg("err").alias("bias"))
    return s.join(linear_percentiles(e, "abs_err", {"p95": 0.95}, ["metric"]), "metric")


def error_histogram(errors: DataFrame, metrics: Sequence[str] = ("grade_a_1look", "grade_a_2look"), bins: int = 20) -> DataFrame:
    """Counts of absolute errors in equal bins up to 1.05 times the largest (at least 1)."""
    e = long_errors(errors).where(F.col("metric").isin(*metrics))
    top = e.agg((F.greatest(F.max("abs_err"), F.lit(1.0)) * 1.05).alias("t")).scalar()
    return (e.select("metric", F.least(F.floor(F.col("abs_err") / top * bins), F.lit(bins - 1)).cast("int").alias("bin"))
            .groupBy("metric", "bin").agg(F.count(F.lit(1)).alias("n")))


def worst_trays(errors: DataFrame, metric: str = "grade_a_1look", k: int = 5) -> DataFrame:
    return errors.orderBy(F.desc(f"abs_err_{metric}"), "tray_id").limit(k).select("tray_id", f"abs_err_{metric}", f"err_{metric}", "n_looks_used")


def refer_rate(items: DataFrame, threshold: float = 0.75, by: Sequence[str] = ()) -> DataFrame:
    return items.groupBy(*by).agg(F.avg((F.col("confidence") < threshold).cast("int")).alias("refer_rate"), F.count(F.lit(1)).alias("n"))
