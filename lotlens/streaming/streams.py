"""Structured Streaming forms of the event-driven operators.

Each function takes and returns a streaming DataFrame (or starts nothing); the caller picks sink, trigger and checkpoint
(``sinks``). Order-dependent operators handle each key's rows in event time across micro-batches (``keyed``).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.operators.text import trusted_time
from lotlens.operators.trust import IDENTITY
from lotlens.sources.packs import Pack
from lotlens.streaming.keyed import in_order
from lotlens.streaming.sinks import drain, feed, tail, upsert


def sprt_stream(trays: DataFrame, pack: Pack, delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """One decision row per tray (lot_id, tray, bad, n, at), in order of its time, until the lot's test stops; later trays are ignored.

    A lot silent for longer than ``idle`` starts a new test.
    """
    upper, lower = math.log((1 - pack.beta) / pack.alpha), math.log(pack.beta / (1 - pack.alpha))
    l1, l0 = math.log(pack.p1 / pack.p0), math.log((1 - pack.p1) / (1 - pack.p0))
    cap = pack.max_trays

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        bad, n, k, done = state
        if done:
            return state, []
        tray, bad, n, k = row[1], bad + row[2], n + row[3], k + 1
        llr = bad * l1 + (n - bad) * l0
        decision = "REJECT_LOT" if llr >= upper else "ACCEPT_LOT" if llr <= lower else "REFER_TO_HUMAN" if k >= cap else "SAMPLE_MORE"
        return (bad, n, k, decision != "SAMPLE_MORE"), [(tray, k, llr, decision)]
    found = in_order(trays, "lot_id", "at", "tray", {"bad": "long", "n": "long"}, step, (0, 0, 0, False), "bad long, n long, k int, done boolean",
                     "tray int, k int, llr double, decision string", delay, idle)
    return found.withColumnRenamed("key", "lot_id")


def _streak(df: DataFrame, key: str, good: str, k: int, delay: str, idle: str | None, cooldown_us: int = 0) -> DataFrame:
    """Events completing k good events in a row per key; events inside the cooldown after a trigger do not count."""
    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        run, until = state
        us, event, ok = row
        if us < until:
            return state, []
        run = run + 1 if ok else 0
        return ((0, us + cooldown_us), [(event,)]) if run == k else ((run, until), [])
    return in_order(df, key, "ts", "event_id", {good: "boolean"}, step, (0, 0), "run long, until long", "event_id long", delay, idle)


def steady_scan_stream(scans: DataFrame, k: int = 3, delay: str = "1 hour", idle: str | None = "1 day") -> DataFrame:
    """Scans completing k passing scans in a row: key, event_id. A failing scan, a trigger or idle time starts the count again."""
    return _streak(scans, "key", "pass", k, delay, idle)


def lockout_stream(attempts: DataFrame, tries: int = 5, cooldown_seconds: int = 30, delay: str = "1 hour", idle: str | None = "30 days") -> DataFrame:
    """Attempts that lock a user out: key, event_id. Attempts inside the cooldown do not count; success or idle time resets."""
    return _streak(attempts, "user_id", "failed", tries, delay, idle, cooldown_seconds * 1_000_000)


def guard_stream(scans: DataFrame, refusals: int = 2, delay: str = "1 hour", idle: str | None = "30 days") -> DataFrame:
    """Telemetry row at every shot: scans and failures since the one before, by gate too, refused presses, forced or not."""
    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        scans_, failed, refused, forced, shots, gates = state
        _, _, ok, press, shot, gate = row
        scans_, failed = scans_ + 1, failed + (not ok)
        if not ok and gate is not None:
            by_gate = json.loads(gates)
            by_gate[gate] = by_gate.get(gate, 0) + 1
            gates = json.dumps(by_gate)
        if press and not ok:
            forced, refused = forced or refused >= refusals, min(refusals, refused + 1)
        if not shot:
            return (scans_, failed, refused, forced, shots, gates), []
        named = ",".join(f"{g}:{n}" for g, n in sorted(json.loads(gates).items()))
        return (0, 0, 0, False, shots + 1, "{}"), [(shots, scans_, failed, named, refused, forced)]
    return in_order(scans, "key", "ts", "event_id", {"pass": "boolean", "press": "boolean", "shot": "boolean", "gate": "string"}, step, (0, 0, 0, False, 0, "{}"),
                    "scans long, failed long, refused long, forced boolean, shots long, gates string",
                    "shot_no long, scans long, failed long, failed_gates string, refused long, forced boolean", delay, idle)


def first_records(lots: DataFrame, event_time: str = "created_ts", delay: str = "24 hours", keys=IDENTITY) -> DataFrame:
    """Idempotent retries: the first record per identity key within the watermark delay."""
    filled = lots.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("farmer_name", "officer_name") if c in lots.columns})
    return filled.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def trusted_stream(records: DataFrame, client: str, server: str, delay: str = "24 hours") -> DataFrame:
    """Records with vetted times; the watermark then follows the trusted time."""
    at, reason = trusted_time(client, server)
    return records.select("*", at, reason).withWatermark("trusted_at", delay)


def current_actions(actions: DataFrame) -> DataFrame:
    """Latest action per item, for update mode: lot_id, bulb_id, kind, to_bucket, who, seq."""
    a = actions.groupBy("lot_id", "bulb_id").agg(F.max_by(F.struct("kind", "to_bucket", "who", "seq"), "seq").alias("a"))
    return a.select("lot_id", "bulb_id", "a.*")


def session_stream(events: DataFrame, gap: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions closed by inactivity."""
    s = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_event"))
    return s.select("user_id", F.col("session_window.start").alias("started"), "last_event", "n")


def daily_drift_stream(runs: DataFrame, baseline: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily mean score per centre joined to the static baseline; a centre without one has no drift."""
    d = runs.withWatermark("run_at", delay).groupBy("centre_id", F.window("run_at", "1 day")).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    j = d.join(baseline, "centre_id", "left")
    return j.select("centre_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "score", "n", (F.col("score") - F.col("baseline")).alias("drift"))


__all__ = ["sprt_stream", "steady_scan_stream", "lockout_stream", "guard_stream", "first_records", "trusted_stream", "current_actions",
           "session_stream", "daily_drift_stream", "tail", "drain", "feed", "upsert"]
