"""Centre roll-ups, drift, tray truth, field repeatability and robustness summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import num
from lotlens.functions.ordered import linear_percentiles, row_index
from lotlens.operators.agreement import icc1

MEAN = F.avg


def median_size(items: DataFrame, by: str = "lot_id", size: str = "size_min") -> DataFrame:
    """Upper median of an integer size per lot. Sizes are 16-bit, so distinct values per lot are few."""
    from lotlens.functions.ordered import value_ranks
    r = value_ranks(items, size, [by])
    return r.groupBy(by).agg((F.min(F.when(F.col("cum") >= F.floor(F.col("total") / 2) + 1, F.col(size))) / 10.0).alias("median_mm"))


def fleet_dashboard(latest: DataFrame) -> DataFrame:
    """Per centre, from latest receipts only: lots, items, mean Grade A and refer share, human actions, tiers, demo flag."""
    tiers = ("aruco", "a4", "coin", "intrinsics")
    return latest.groupBy("centre").agg(
        F.count(F.lit(1)).alias("lots"), F.sum("n_bulbs").alias("bulbs"), F.avg("grade_a").alias("mean_grade_a"),
        F.avg("refer").alias("mean_refer"), F.sum("n_actions").alias("actions"),
        (F.sum("n_overrides") * 100.0 / F.sum("n_bulbs")).alias("overrides_per_100"),
        *[F.count_if(F.col("tier") == x).alias(f"tier_{x}") for x in tiers], F.bool_or("demo").alias("demo"))


def fleet_size_series(latest: DataFrame, items: DataFrame) -> DataFrame:
    """Median item size of each lot in receipt order per centre, as rows: a centre's history has no length limit."""
    j = latest.join(median_size(items), "lot_id")
    return row_index(j, "issued_at", ["centre"], "seq", tie=["lot_id"]).select("centre", "seq", "lot_id", "median_mm")


def home_kpis(lots: DataFrame, latest: DataFrame, captures: DataFrame, today: str) -> DataFrame:
    """Usable items, lots created today, signed lots and their mean procured share: one row."""
    usable = captures.agg(F.count_if(F.col("excluded").isNull()).alias("usable_bulbs"))
    j = lots.join(latest.select("lot_id", "procured"), "lot_id", "left")
    base = j.agg(F.count_if(F.date_format("purchase_date", "yyyy-MM-dd") == today).alias("lots_today"),
                 F.count("procured").alias("signed_lots"), F.avg("procured").alias("mean_procured"))
    return base.withColumn("usable_bulbs", usable.scalar())


def guard_failure_share(telemetry: DataFrame) -> DataFrame:
    """Share of failing scans and refused presses per key: telemetry(key, scans, failed, refused)."""
    return telemetry.groupBy("key").agg(F.sum("scans").alias("scans"), F.sum("failed").alias("failed"), F.sum("refused").alias("refused"),
                                        (F.sum("failed") / F.sum("scans")).alias("failing_share"))


def gate_failures(captures: DataFrame, by_gate: str = "by_gate") -> DataFrame:
    """Failed scans per gate from per-capture maps."""
    return captures.select(F.explode(by_gate).alias("gate", "n")).groupBy("gate").agg(F.sum("n").alias("n"))


def repeatability(runs: DataFrame, value: str = "grade_a") -> DataFrame:
    """Mean and sample sd overall, by phone and by light, from one pass over grouping sets."""
    g = runs.groupingSets([("phone",), ("light",), ()], "phone", "light").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    kind = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "phone").otherwise("light")
    return g.select(kind.alias("factor"), F.coalesce("phone", "light", F.lit("all")).alias("level"), "n", "mean", "sd")


def repeatability_icc(runs: DataFrame, value: str = "grade_a") -> DataFrame:
    """ICC(1,1) over phone x light conditions with at least two runs."""
    cond = runs.select(F.concat_ws("|", "phone", "light").alias("grp"), F.col(value).alias("v"))
    return icc1(cond, "grp", "v", min_size=2)


def drift_report(centres: DataFrame, runs: DataFrame, baseline_runs: int = 7, limit: float = -5.0) -> DataFrame:
    """Latest reference score against the mean of the first runs, per centre; RECALIBRATE below the limit.

    The baseline uses a row_number <= k filter, which Spark applies before the shuffle (window group limit), and the latest
    score is an aggregate.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("centre_id").orderBy("run_at", "id")
    base = (runs.select("centre_id", "run_at", "id", "score", F.row_number().over(w).alias("_k")).where(F.col("_k") <= baseline_runs)
            .groupBy("centre_id").agg(F.avg("score").alias("baseline")))
    latest = runs.groupBy("centre_id").agg(F.max_by("score", F.struct("run_at", "id")).alias("latest"), F.count(F.lit(1)).alias("n_runs"))
    r = latest.join(base, "centre_id").withColumnRenamed("centre_id", "id")
    j = centres.join(r, "id", "left").withColumn("drift", F.col("latest") - F.col("baseline"))
    status = F.when(F.col("latest").isNull(), "NO DATA").when(F.col("drift") < limit, "RECALIBRATE").otherwise("CALIBRATED")
    return j.withColumn("status", status)


def tray_truth_summary(trays: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Trays, items, mean per tray, Grade-A and defect shares and class totals: one row."""
    defects = sum((F.col(c) for c in classes), F.lit(0))
    return trays.agg(F.count(F.lit(1)).alias("trays"), F.sum("n_total").alias("bulbs"), (F.sum("n_total") / F.count(F.lit(1))).alias("mean_per_tray"),
                     (F.sum("n_grade_a") * 100.0 / F.sum("n_total")).alias("grade_a_pct"), (F.sum(defects) * 100.0 / F.sum("n_total")).alias("defect_pct"),
                     F.avg(F.when(F.col("n_total") > 0, defects / F.col("n_total"))).alias("mean_tray_rate"), *[F.sum(c).alias(c) for c in classes])


def occlusion_factors(trays: DataFrame) -> DataFrame:
    """Defects seen over defects present for one look and for the better of two: mixed trays with both looks and some truth.

    trays(composition, truth, look1, look2). Falls back to all trays when none is mixed.
    """
    ok = trays.where((F.col("truth") > 0) & F.col("look1").isNotNull() & F.col("look2").isNotNull())
    any_mixed = trays.agg(F.coalesce(F.bool_or(F.col("composition") == "mixed"), F.lit(False)).alias("m")).scalar()
    used = ok.where((F.col("composition") == "mixed") | ~any_mixed)
    better = F.greatest("look1", "look2")
    return used.agg(F.count(F.lit(1)).alias("used"), F.sum("truth").alias("truth"), (F.sum("look1") / F.sum("truth")).alias("factor_1look"),
                    (F.sum(better) / F.sum("truth")).alias("factor_2look")).withColumn("gate_pass", F.col("factor_2look") > F.col("factor_1look"))


def height_factor(pairs: DataFrame, truth: str = "ref_mm", raw: str = "method_mm") -> DataFrame:
    """Mean truth/raw ratio with mean and 95th-percentile absolute error before and after applying it: one row."""
    ok = pairs.where(num(raw) > 0)
    factor = ok.agg(F.avg(num(truth) / num(raw)).alias("f")).scalar()
    e = ok.select(F.lit("x").alias("k"), factor.alias("factor"), num(truth).alias("t"), num(raw).alias("r"))
    e = e.withColumn("before", F.abs(F.col("r") - F.col("t"))).withColumn("after", F.abs(F.col("r") * F.col("factor") - F.col("t")))
    mae = e.agg(F.max("factor").alias("factor"), F.count(F.lit(1)).alias("n"), F.avg("before").alias("mae_before"), F.avg("after").alias("mae_after"))
    p = lambda c: linear_percentiles(e, c, {"p": 0.95}).scalar()
    return mae.withColumn("p95_before", p("before")).withColumn("p95_after", p("after"))


def robustness(perturbed: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """Per perturbation: mean relative count change, mean absolute score change, share of flipped decisions."""
    b = base.select("id", F.col("n_items").alias("n0"), F.col("score").alias("s0"))
    j = perturbed.join(b, "id")
    flip = (F.col("score") >= threshold) != (F.col("s0") >= threshold)
    return j.groupBy("perturbation").agg(F.count(F.lit(1)).alias("photos"), F.avg(F.abs(F.col("n_items") - F.col("n0")) / F.greatest(F.lit(1), F.col("n0"))).alias("count_change"),
                                         F.avg(F.abs(F.col("score") - F.col("s0"))).alias("score_change"), F.avg(flip.cast("int")).alias("flips"))


def dispute_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("lot_id").agg(F.count_if(F.col("disputed") == 1).alias("n_disputed"), F.count(F.lit(1)).alias("n_items"))


def recent_lots(lots: DataFrame, centres: DataFrame, n: int = 20, centre_id: int | None = None) -> DataFrame:
    """Newest gradings with their centre, optionally of one centre."""
    x = lots if centre_id is None else lots.where(F.col("centre_id") == centre_id)
    c = centres.select(F.col("id").alias("centre_id"), F.col("name").alias("centre_name"))
    return x.join(c, "centre_id").orderBy(F.desc("id")).limit(n)
