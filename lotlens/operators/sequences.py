"""Batch forms of the event-driven operators: runs, resets and sessions over ordered events.

Every order-dependent step uses sliced running totals, so one key with a large part of all events is still spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.ordered import running_sums
from lotlens.sources.packs import Pack


def sequential_sprt(trays: DataFrame, pack: Pack) -> DataFrame:
    """Decision after each tray in order, until the test stops or the tray cap is reached: one row per lot.

    trays(lot_id, tray, bad, n). decided_at is the number of trays used.
    """
    upper, lower = math.log((1 - pack.beta) / pack.alpha), math.log(pack.beta / (1 - pack.alpha))
    l1, l0 = math.log(pack.p1 / pack.p0), math.log((1 - pack.p1) / (1 - pack.p0))
    r = running_sums(trays, "tray", {"cum_bad": "bad", "cum_n": "n", "k": F.lit(1).cast("bigint")}, ["lot_id"])
    r = r.withColumn("llr", F.col("cum_bad") * l1 + (F.col("cum_n") - F.col("cum_bad")) * l0)
    step = (F.when(F.col("llr") >= upper, "REJECT_LOT").when(F.col("llr") <= lower, "ACCEPT_LOT")
            .when(F.col("k") >= pack.max_trays, "REFER_TO_HUMAN"))
    r = r.withColumn("step", step)
    stop = F.min(F.when(F.col("step").isNotNull(), F.struct("k", "step", "llr")))
    last = F.max(F.struct("k", "llr"))
    out = r.groupBy("lot_id").agg(stop.alias("s"), last.alias("z"))
    return out.select("lot_id", F.coalesce("s.step", F.lit("SAMPLE_MORE")).alias("decision"), F.coalesce("s.k", "z.k").alias("decided_at"), F.coalesce("s.llr", "z.llr").alias("llr"))


def _run_position(events: DataFrame, key: str, order: str, good: str, tie: str) -> DataFrame:
    """Add ``run``: length of the unbroken sequence of good events ending at each row (0 on a bad one)."""
    g = F.col(good).cast("bigint")
    r = running_sums(events, order, {"_good": g, "_bad": F.lit(1) - g}, [key], tie=[tie])
    # Good events counted before the run began, i.e. at the bad event that opened it.
    base = r.groupBy(key, "_bad").agg(F.coalesce(F.max(F.when(~F.col(good), F.col("_good"))), F.lit(0)).alias("_base"))
    j = r.join(base.select(F.col(key).alias("_k"), F.col("_bad").alias("_b"), "_base"), (F.col(key) == F.col("_k")) & (F.col("_bad") == F.col("_b")))
    return j.withColumn("run", F.when(F.col(good), F.col("_good") - F.col("_base")).otherwise(F.lit(0))).select(*events.columns, "run")


def steady_scans(scans: DataFrame, k: int = 3) -> DataFrame:
    """Scans completing k passing scans in a row; a failing scan or a trigger starts the count again."""
    r = _run_position(scans, "key", "ts", "pass", "event_id")
    return r.where((F.col("run") > 0) & (F.col("run") % k == 0)).select("key", "event_id", "ts", (F.col("run") / k).cast("bigint").alias("nth"))


def guard_telemetry(scans: DataFrame, refusals: int = 2) -> DataFrame:
    """Scan statistics between shots: scans, failures, refused presses, whether the shot was forced, and every gate's failures.

    failed_gates is "gate:count" of each gate that failed, in order of name, joined by commas.
    """
    shot = F.col("shot").cast("bigint")
    r = running_sums(scans, "ts", {"_shots": shot}, ["key"], tie=["event_id"]).withColumn("shot_no", F.col("_shots") - shot)
    # A few gates: counts by gate first, then one short list per shot.
    by_gate = r.groupBy("key", "shot_no", "gate").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("pass")).alias("_failed"),
                                                      F.count_if(F.col("press") & ~F.col("pass")).alias("_bad"), F.bool_or("shot").alias("_shot"))
    bad_press = F.sum("_bad")
    gates = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_failed") > 0, F.concat("gate", F.lit(":"), F.col("_failed").cast("string"))))), ",")
    return by_gate.groupBy("key", "shot_no").agg(
        F.sum("_n").alias("scans"), F.sum("_failed").alias("failed"), gates.alias("failed_gates"), F.least(F.lit(refusals), bad_press).cast("bigint").alias("refused"),
        (bad_press > refusals).alias("forced"), F.bool_or("_shot").alias("closed"))


def activity_sessions(events: DataFrame, gap_minutes: int = 15) -> DataFrame:
    """Sessions closed by more than ``gap_minutes`` without an event: user_id, start and last event (text), number of events.

    Sessions merge before and after one exchange (set spark.sql.sessionWindow.merge.sessions.in.local.partition for long
    histories of few users).
    """
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    session = F.session_window("ts", f"{gap_minutes} minutes 1 microsecond")
    return (rows.groupBy("user_id", session).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
            .select("user_id", text("a").alias("started"), text("b").alias("last_event"), "n"))


def daily_drift(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Mean reference score per centre and day against the centre's baseline: baseline(centre_id, baseline)."""
    d = runs.groupBy("centre_id", F.date_format("run_at", "yyyy-MM-dd").alias("day")).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return d.join(baseline, "centre_id").withColumn("drift", F.col("score") - F.col("baseline"))
