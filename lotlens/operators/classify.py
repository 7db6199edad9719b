"""Classifier scores: AUC, confusion, threshold choice, model comparison, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import num, round_half_up, wilson
from lotlens.functions.ordered import nearest_rank, running_sums


def image_scores(crops: DataFrame, score: str = "score") -> DataFrame:
    """Worst crop per image: image_id, label, variety, qty, split, score."""
    keys = [c for c in ("image_id", "label", "variety", "qty", "split") if c in crops.columns]
    return crops.groupBy(*keys).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("score"))


def score_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with their positives and negatives; all ordered statistics start from this."""
    return scored.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC with ties at one half, per group; NULL without both classes."""
    c = running_sums(score_counts(scored, by), "score", {"cum_neg": F.col("neg")}, by)
    below = F.col("cum_neg") - F.col("neg")
    s = c.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (below + F.col("neg") * 0.5)).alias("u"))
    return s.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def confusion_at(scored: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Sensitivity, specificity (with Wilson bounds) and accuracy at a threshold, per group."""
    pos, neg, hit = F.col("label") == 1, F.col("label") == 0, F.col("score") >= threshold
    s = scored.groupBy(*by).agg(F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"), F.count_if(pos & hit).alias("tp"), F.count_if(neg & ~hit).alias("tn"))
    sl, sh = wilson("tp", "n_pos")
    pl, ph = wilson("tn", "n_neg")
    safe = lambda a, b: F.when(b > 0, a / b)
    return s.select(*by, "n_pos", "n_neg", safe(F.col("tp"), F.col("n_pos")).alias("sensitivity"), sl.alias("sens_lo"), sh.alias("sens_hi"),
                    safe(F.col("tn"), F.col("n_neg")).alias("specificity"), pl.alias("spec_lo"), ph.alias("spec_hi"),
                    safe(F.col("tp") + F.col("tn"), F.col("n_pos") + F.col("n_neg")).alias("accuracy"))


def subgroups(scored: DataFrame) -> DataFrame:
    """Rows of every reported slice: all, each variety, each quantity."""
    tags = F.array(F.lit("all"), F.concat(F.lit("variety="), "variety"), F.concat(F.lit("qty="), "qty"))
    return scored.select("label", "score", F.explode(tags).alias("slice"))


def subgroup_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    s = subgroups(scored)
    a = auc(s, ["slice"]).select("slice", "auc")
    return confusion_at(s, threshold, ["slice"]).join(a, "slice")


def youden_curve(scored: DataFrame) -> DataFrame:
    """Sensitivity and specificity at every distinct score used as an inclusive threshold."""
    c = running_sums(score_counts(scored), "score", {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")})
    totals = score_counts(scored).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = totals.select("p").scalar(), totals.select("n").scalar()
    tp, tn = p - (F.col("cum_pos") - F.col("pos")), F.col("cum_neg") - F.col("neg")
    return c.select("score", (tp / p).alias("sensitivity"), (tn / n).alias("specificity"))


def youden_threshold(scored: DataFrame, digits: int | None = 3) -> DataFrame:
    """Score maximising sensitivity + specificity - 1; the smallest score wins ties. ``digits`` rounds the terms first."""
    r = (lambda c: round_half_up(c, digits)) if digits is not None else num
    j = r("sensitivity") + r("specificity") - 1.0
    return youden_curve(scored).agg(F.max_by("score", F.struct(j, -F.col("score"))).alias("threshold"), F.max(j).alias("j"))


def threshold_grid(items: DataFrame, gates: Sequence[float]) -> DataFrame:
    """Photo hit rates and healthy-item failures for each gate: items(photo, label, p, rot, blackening, fails).

    Items under the gate count as clean. Items are reduced once per photo to one value and count per gate; only the photos'
    tallies go on to the gates.
    """
    gates = list(dict.fromkeys(float(x) for x in gates))
    spots, worst, failed = F.col("rot") + F.col("blackening"), [], []
    for i, gate in enumerate(gates):
        open_ = F.col("p") >= F.lit(gate)
        worst.append(F.max(F.when(open_, spots).otherwise(F.lit(0.0))).alias(f"w{i}"))
        failed.append(F.count_if(open_ & F.col("fails")).alias(f"f{i}"))
    per = items.select("photo", "label", "p", "rot", "blackening", "fails").groupBy("photo", "label").agg(*worst, F.count(F.lit(1)).alias("n"), *failed)
    sick = F.col("label") == 1
    sums = [F.count_if(sick).alias("sick"), F.count_if(~sick).alias("well"), F.sum(F.when(~sick, F.col("n"))).alias("n")]
    for i in range(len(gates)):
        hit = F.col(f"w{i}") > 0.03
        sums += [F.count_if(sick & hit).alias(f"t{i}"), F.count_if(~sick & hit).alias(f"h{i}"), F.sum(F.when(~sick, F.col(f"f{i}"))).alias(f"f{i}")]
    total = per.agg(F.count(F.lit(1)).alias("photos"), *sums).where("photos > 0")
    each = [F.struct(F.lit(gate).alias("gate"), F.col(f"t{i}").alias("t"), F.col(f"h{i}").alias("h"), F.col(f"f{i}").alias("f")) for i, gate in enumerate(gates)]
    s = total.select("sick", "well", "n", F.inline(F.array(*each)))
    s = s.select("gate", (F.col("t") / F.col("sick")).alias("tpr"), (F.col("h") / F.col("well")).alias("fpr"), (F.col("f") / F.col("n")).alias("healthy_fail"))
    return s.withColumn("objective", F.col("tpr") - F.col("fpr") - F.col("healthy_fail"))


def best_gate(grid: DataFrame) -> DataFrame:
    return grid.agg(F.max_by("gate", F.struct("objective", -F.col("gate"))).alias("gate"), F.max("objective").alias("objective"))


def high_threshold(crops: DataFrame, floor: float = 0.5, default: float = 0.9) -> DataFrame:
    """95th percentile (index floor(0.95 (n-1))) of healthy multi-item crops, at least ``floor``; ``default`` without any."""
    from lotlens.functions.ordered import value_ranks
    ok = crops.where((F.col("qty") == "multiple") & (F.col("label") == 0))
    r = value_ranks(ok, "score")
    pick = r.agg(F.min(F.when(F.col("cum") >= F.floor((F.col("total") - 1) * 0.95) + 1, F.col("score"))).alias("q"))
    return pick.select(F.coalesce(F.greatest(F.lit(floor), F.col("q")), F.lit(default)).alias("high_threshold"))


def ship_rule(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ship the new model only if its AUC is higher on the same items. One row."""
    from lotlens.operators.joins import missing_from, same_items
    j = same_items(old, new)
    a = auc(j.select("label", F.col("score_a").alias("score")))
    b = auc(j.select("label", F.col("score_b").alias("score"))).select("auc").scalar()
    missing = missing_from(old, new).agg(F.count(F.lit(1)).alias("m")).scalar()
    return a.select((F.col("n_pos") + F.col("n_neg")).alias("n_items"), F.col("auc").alias("auc_old"), b.alias("auc_new"), missing.alias("old_only")).withColumn("ship", F.col("auc_new") > F.col("auc_old"))


def latency(df: DataFrame, ms: str = "ms", by: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank p50 and p95 with mean and maximum."""
    q = nearest_rank(df, ms, {"p50": 0.5, "p95": 0.95}, by)
    m = df.groupBy(*by).agg(F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))
    return q.join(m, list(by)) if by else q.withColumn("mean_ms", m.select("mean_ms").scalar()).withColumn("max_ms", m.select("max_ms").scalar())
