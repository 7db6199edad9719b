"""What-if deterioration: nested severities over items or over lot summaries, and what they do to the payout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import wilson_percent
from lotlens.operators.disputes import DEFAULT_RATES, price_band
from lotlens.operators.measure import CLASS_NAMES, GRADES
from lotlens.operators.pooled import look_deff

DEFECT_CLASSES = CLASS_NAMES[1:]


def item_uniform(seed: str = "what-if") -> str:
    """SQL for a stable uniform in [0, 1) per item: the same item gets the same number at every severity."""
    return f"CAST(conv(substr(md5(concat_ws('|', '{seed}', lot_id, id)), 1, 8), 16, 10) AS BIGINT) / 4294967296D"


def what_if_bulbs(items: DataFrame, severities: Sequence[float], seed: str = "what-if") -> DataFrame:
    """Per lot and severity: items degraded, sound items by size band, defects.

    A sound item degrades when its uniform is below the severity, so larger severities contain smaller ones. The class
    it turns into follows the lot's own defect mix (rotten when there is none). n_flagged counts every item under the
    severity, n_degraded only the sound ones among them.
    """
    mix = items.groupBy("lot_id").agg(*[F.count_if(F.col("class") == c).alias(f"d_{c}") for c in DEFECT_CLASSES])
    x = items.selectExpr("lot_id", "id", "class", "size_grade", f"{item_uniform(seed)} AS u",
                         f"CAST(conv(substr(md5(concat_ws('|', '{seed}', lot_id, id)), 9, 8), 16, 10) AS BIGINT) / 4294967296D AS v")
    x = x.join(mix, "lot_id")
    total = " + ".join(f"d_{c}" for c in DEFECT_CLASSES)
    running, whens = [], []
    for c in DEFECT_CLASSES:
        running.append(f"d_{c}")
        whens.append(f"WHEN v * ({total}) < {' + '.join(running)} THEN '{c}'")
    x = x.withColumn("target", F.expr(f"CASE WHEN {total} = 0 THEN 'rotten' {' '.join(whens)} ELSE 'rotten' END"))
    levels = ", ".join(f"{float(s)}D" for s in severities)
    g = x.selectExpr("lot_id", "class", "size_grade", "target", "u", f"explode(array({levels})) AS severity")
    flagged, sound = F.col("u") < F.col("severity"), F.col("class") == "sound"
    hit = flagged & sound
    return g.groupBy("lot_id", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("n_flagged"), F.count_if(hit).alias("n_degraded"), F.count_if(~sound | hit).alias("n_defects"),
        F.count_if(F.col("size_grade") == "A").alias("band_a"), *[F.count_if(sound & ~flagged & (F.col("size_grade") == s)).cast("double").alias(f"s_{s}") for s in GRADES],
        *[F.count_if(hit & (F.col("target") == c)).alias(f"to_{c}") for c in DEFECT_CLASSES])


def what_if_aggregate(pooled: DataFrame, severities: Sequence[float]) -> DataFrame:
    """The same from lot summaries: floor(severity x sound) items degrade and every size band shrinks alike."""
    levels = ", ".join(f"{float(s)}D" for s in severities)
    x = pooled.selectExpr("*", f"explode(array({levels})) AS severity")
    x = x.withColumn("k", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("severity"))) * F.col("n_sound")))
    scale = (F.col("n_sound") - F.col("k")) / F.col("n")
    return x.select("lot_id", "severity", "n", F.col("k").alias("n_degraded"), (F.col("n") - F.col("n_sound") + F.col("k")).alias("n_defects"),
                    F.col("g_A").alias("band_a"), *[(F.col(f"g_{s}") * scale).alias(f"s_{s}") for s in GRADES])


def saleable(sim: DataFrame, looks: DataFrame) -> DataFrame:
    """Saleable Grade A with its cluster-aware interval, and the defect rate; looks(lot_id, n_looks)."""
    x = sim.join(looks, "lot_id")
    lo, hi = wilson_percent("s_A", "n", look_deff("n_looks"))
    return (x.withColumn("saleable_pct", F.col("s_A") * 100.0 / F.col("n")).withColumn("saleable_lo", lo).withColumn("saleable_hi", hi)
            .withColumn("defect_pct", F.col("n_defects") * 100.0 / F.col("n")))


def payout(sim: DataFrame) -> DataFrame:
    """Price of the remaining sound mix and value per delivered quintal, with changes against severity 0."""
    total = " + ".join(f"s_{s}" for s in GRADES)
    value = " + ".join(f"s_{s} * {DEFAULT_RATES[s]}D" for s in GRADES)
    x = sim.selectExpr("*", f"IF({total} > 0, ({value}) / ({total}), NULL) AS price").withColumn("value_index", F.col("price") * (F.col("n") - F.col("n_defects")) / F.col("n"))
    base = x.where(F.col("severity") == 0).select("lot_id", F.col("saleable_pct").alias("_a"), F.col("defect_pct").alias("_d"), F.col("price").alias("_p"), F.col("value_index").alias("_v"))
    j = x.join(base, "lot_id")
    pct = lambda a, b: F.when(F.col(b) != 0, (F.col(a) - F.col(b)) * 100.0 / F.col(b))
    return j.select("lot_id", "severity", "price", "value_index", (F.col("saleable_pct") - F.col("_a")).alias("saleable_points"), (F.col("defect_pct") - F.col("_d")).alias("defect_points"),
                    (F.col("price") - F.col("_p")).alias("payout_change"), pct("price", "_p").alias("payout_pct"), (F.col("value_index") - F.col("_v")).alias("value_change"), pct("value_index", "_v").alias("value_pct"))


__all__ = ["what_if_bulbs", "what_if_aggregate", "saleable", "payout", "price_band"]
