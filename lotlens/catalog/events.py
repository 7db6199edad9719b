"""Queries over event sequences: batch forms with SQL twins, and streaming runs over the event table."""

from __future__ import annotations

import uuid

from pyspark.errors.exceptions.base import StreamingQueryException
from pyspark.sql import functions as F

from lotlens.catalog.core import query, shared
from lotlens.catalog.measures import S4, S6, r4, r6
from lotlens.operators import lots as L
from lotlens.operators import sequences as Q
from lotlens.operators import trust as T
from lotlens.operators.dataset import group_cap
from lotlens.operators.text import trusted_time
from lotlens.plans import grade as G
from lotlens.plans.session import shared_folder
from lotlens.sources import packs as P
from lotlens.sources.commits import committed
from lotlens.streaming import streams as S


def run_folder(spark) -> str:
    """A fresh folder for one run, under the shared folder."""
    return f"{shared_folder(spark)}/lotlens-run-{uuid.uuid4().hex}"


def played(t, rows, time: str, run, mode: str = "append", **how):
    """The result of a stream over rows that arrive in several files, up to six hours late and out of order."""
    folder = run_folder(t.spark)
    return S.drain(run(S.feed(rows, folder, time, **how)), folder, mode)


DELAY = "6 hours"
#: Rows of the first third of the month that arrive with its last slice, far behind every watermark.
HELD = "event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-10 00:00:00'"


def _trays(t):
    pack = [P.default_pack()]
    trays = L.add_pack_sums(G.graded_trays(t("bulbs"), pack), pack)
    return trays.select("lot_id", "tray", "bad", "n")


shared("o_seq", """SELECT *, CASE WHEN llr >= ln(0.9/0.05) THEN 'REJECT_LOT' WHEN llr <= ln(0.1/0.95) THEN 'ACCEPT_LOT' WHEN k >= 8 THEN 'REFER_TO_HUMAN' END AS step FROM (
 SELECT lot_id, row_number() OVER w AS k, sum((c_u + c_r)*ln(0.25/0.1) + (n - c_u - c_r)*ln(0.75/0.9)) OVER w AS llr FROM {o_trays} WHERE pack_id = 'in-psf-2026-07-30-a-only' WINDOW w AS (PARTITION BY lot_id ORDER BY tray))""")


@query("M01_sequential_sprt", f"""SELECT lot_id, coalesce(arg_min(step, k) FILTER (WHERE step IS NOT NULL), 'SAMPLE_MORE') AS decision, coalesce(min(k) FILTER (WHERE step IS NOT NULL), max(k)) AS decided_at,
 {S4('coalesce(arg_min(llr, k) FILTER (WHERE step IS NOT NULL), arg_max(llr, k))')} AS llr FROM {{o_seq}} GROUP BY lot_id""")
def _(t):
    return Q.sequential_sprt(_trays(t), P.default_pack()).withColumn("llr", r4("llr"))


@query("M01_sprt_stream", f"""SELECT lot_id, coalesce(arg_min(step, k) FILTER (WHERE step IS NOT NULL), 'SAMPLE_MORE') AS decision, coalesce(min(k) FILTER (WHERE step IS NOT NULL), max(k)) AS decided_at,
 {S4('coalesce(arg_min(llr, k) FILTER (WHERE step IS NOT NULL), arg_max(llr, k))')} AS llr FROM {{o_seq}} GROUP BY lot_id""")
def _(t):
    trays = _trays(t).withColumn("at", F.timestamp_seconds(F.lit(1_750_000_000) + F.pmod("lot_id", F.lit(5000)) * 60 + F.col("tray") * 600))
    steps = played(t, trays, "at", lambda s: S.sprt_stream(s, P.default_pack(), DELAY, "30 days"))
    last = steps.groupBy("lot_id").agg(F.max(F.struct("k", "decision", "llr")).alias("x"))
    return last.select("lot_id", "x.decision", F.col("x.k").cast("bigint").alias("decided_at"), r4("x.llr").alias("llr"))


def _runs_sql(src: str, key: str, good: str, k: int, idle_us: int = 0) -> str:
    gap = f"(SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY ts, event_id) > {idle_us}, false) AS gap FROM {src})" if idle_us else f"(SELECT *, false AS gap FROM {src})"
    return f"""SELECT {key}, event_id FROM (SELECT *, row_number() OVER (PARTITION BY {key}, island ORDER BY ts, event_id) - first_bad AS run FROM (SELECT *, CAST(max(CASE WHEN NOT {good} THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, island) AS BIGINT) AS first_bad
 FROM (SELECT *, sum(CASE WHEN {good} AND NOT gap THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS island FROM {gap}))) WHERE {good} AND run % {k} = 0"""


@query("M02_steady_scans", _runs_sql("{scans}", "key", "pass", 3))
def _(t):
    return Q.steady_scans(t("scans")).select("key", "event_id")


# A key silent for more than half a day starts its count again.
@query("M02_steady_scans_stream", _runs_sql("{scans}", "key", "pass", 3, 43_200_000_000))
def _(t):
    return played(t, t("scans"), "ts", lambda s: S.steady_scan_stream(s, 3, DELAY, "12 hours"))


_GUARD = """SELECT key, shot_no, count(*) AS scans, count(*) FILTER (WHERE NOT pass) AS failed, concat_ws(',', {gates}) AS failed_gates, least(2, count(*) FILTER (WHERE press AND NOT pass)) AS refused, count(*) FILTER (WHERE press AND NOT pass) > 2 AS forced{extra}
 FROM (SELECT * REPLACE (event_id % 7 = 1 AS press), CAST(sum(CASE WHEN shot THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id) - CASE WHEN shot THEN 1 ELSE 0 END AS BIGINT) AS shot_no FROM {scans}) GROUP BY key, shot_no""".replace("{gates}", ", ".join(f"CASE WHEN count(*) FILTER (WHERE gate = '{g}') > 0 THEN '{g}:' || count(*) FILTER (WHERE gate = '{g}') END"
                                                          for g in ("glare", "level", "sharp", "tray")))


@query("M03_guard_telemetry", _GUARD.replace("{extra}", ", bool_or(shot) AS closed"))
def _(t):
    return Q.guard_telemetry(t("scans").withColumn("press", F.col("event_id") % 7 == 1))


@query("M03_guard_telemetry_stream", _GUARD.replace("{extra}", "") + " HAVING bool_or(shot)")
def _(t):
    return played(t, t("scans").withColumn("press", F.col("event_id") % 7 == 1), "ts", lambda s: S.guard_stream(s, 2, DELAY, "60 days"))


@query("M04_idempotent_retries", "SELECT min(id) AS id, count(*) AS n_copies FROM (SELECT * FROM {ledger_base} UNION ALL SELECT * REPLACE (id + 1000000 AS id) FROM {ledger_base} WHERE id % 4 = 0) GROUP BY centre_id, lot_ref, coalesce(farmer_name,''), coalesce(officer_name,''), n_bulbs, n_looks, grade_a_pct, ci_low, ci_high, defect_pct")
def _(t):
    b = t("ledger_base")
    again = b.where("id % 4 = 0").withColumn("id", F.col("id") + 1000000)
    return T.dedupe_finalised(b.unionByName(again)).select("id", "n_copies")


@query("M04_first_records_stream", "SELECT o_custkey, o_totalprice, count(DISTINCT o_orderstatus || o_orderpriority) AS n FROM {orders} GROUP BY o_custkey, o_totalprice")
def _(t):
    o = t("orders").withColumn("created_ts", F.col("o_orderdate").cast("timestamp"))
    o = o.unionByName(o.where("o_orderkey % 5 = 0"))  # every fifth record is sent again
    first = played(t, o, "created_ts", lambda s: S.first_records(s, delay="10000 days", keys=("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")))
    return first.where("o_custkey is not null").groupBy("o_custkey", "o_totalprice").agg(F.count(F.lit(1)).alias("n"))


@query("M05_clock_skew", """SELECT event_id, abs(event_id % 80 - 40) <= 24 AS kept_client,
 strftime(CASE WHEN abs(event_id % 80 - 40) <= 24 THEN ts + to_hours(CAST(event_id % 80 - 40 AS INT)) ELSE ts END, '%Y-%m-%d %H:%M:%S') AS trusted_at FROM {events}""")
def _(t):
    e = t("events").withColumn("client", F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 80 - 40).cast("int")), "yyyy-MM-dd HH:mm:ss"))
    at, reason = trusted_time("client", F.col("ts").cast("timestamp"))
    return e.select("event_id", reason.isNull().alias("kept_client"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("trusted_at"))


@query("M05_trusted_days_stream", f"""SELECT strftime(trusted, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE kept) AS n_client FROM (
 SELECT abs(event_id % 80 - 40) <= 24 AS kept, CASE WHEN abs(event_id % 80 - 40) <= 24 THEN ts + to_hours(CAST(event_id % 80 - 40 AS INT)) ELSE ts END AS trusted FROM {{events}} WHERE NOT ({HELD})) GROUP BY 1""")
def _(t):
    e = t("events").withColumn("client", F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 80 - 40).cast("int")), "yyyy-MM-dd HH:mm:ss"))

    def days(stream):
        vetted = S.trusted_stream(stream.withColumn("server", F.col("ts").cast("timestamp")), "client", "server", "54 hours")  # a day either way, and the feed's six hours
        counted = vetted.groupBy(F.window("trusted_at", "1 day")).agg(F.count("event_id").alias("n"), F.count_if(F.col("event_id").isNotNull() & F.col("reason").isNull()).alias("n_client"))
        return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "n_client")
    return played(t, e, "ts", days, held=F.expr(HELD)).where("n > 0")


@query("M06_current_actions", "SELECT lot_id, bulb_id, kind, to_bucket, who FROM {o_last}")
def _(t):
    changes = played(t, t("overrides"), "at", S.current_actions, "update", disorder="400 days")
    return S.upsert(changes, ["lot_id", "bulb_id"]).where("bulb_id is not null").select("lot_id", "bulb_id", "kind", "to_bucket", "who")


@query("M07_ledger_tail", "SELECT o_custkey % 6 AS centre_id, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 101 = 0) AS n_disputed FROM {orders} GROUP BY 1")
def _(t):
    folder, out = run_folder(t.spark), "rows"
    e = S.feed(t("orders"), folder, "o_orderdate").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 6).alias("centre_id"), (F.col("o_orderkey") % 101 == 0).alias("disputed"))

    def lost(batch, number):  # as if the driver ended after the second batch's rows were written and before they were entered
        if number == 1:
            batch.write.parquet(f"{folder}/{out}/data/batch=1/attempt=lost")
            raise RuntimeError("lost")
    try:
        S.tail(e, f"{folder}/{out}", f"{folder}/checkpoint", lost).awaitTermination()
    except StreamingQueryException:
        S.tail(e, f"{folder}/{out}", f"{folder}/checkpoint").awaitTermination()
    rows = committed(t.spark, f"{folder}/{out}", e.schema).where("id is not null")
    return rows.groupBy("centre_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("disputed").alias("n_disputed"))


@query("M08_activity_sessions", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
 SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 900000000 THEN 1 ELSE 0 END AS fresh FROM {events})) GROUP BY user_id, sid""")
def _(t):
    return Q.activity_sessions(t("events"))


@query("M08_session_stream", f"""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
 SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 900000000 THEN 1 ELSE 0 END AS fresh FROM {{events}} WHERE NOT ({HELD}))) GROUP BY user_id, sid""")
def _(t):
    found = played(t, t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", lambda s: S.session_stream(s, delay=DELAY), held=F.expr(HELD))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.where("user_id is not null").select("user_id", text("started").alias("started"), text("last_event").alias("last_event"), "n")


@query("M09_failure_lockouts", """SELECT key, event_id FROM (WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS us, failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {auth_events}),
 s AS (SELECT key, event_id, k, CASE WHEN failed THEN 1 ELSE 0 END AS run, CAST(0 AS BIGINT) AS until, false AS fired FROM e WHERE k = 1 UNION ALL
  SELECT e.key, e.event_id, e.k, CASE WHEN e.us < s.until THEN s.run WHEN e.failed AND s.run < 4 THEN s.run + 1 ELSE 0 END, CASE WHEN e.us >= s.until AND e.failed AND s.run = 4 THEN e.us + 604800000000 ELSE s.until END,
   e.us >= s.until AND e.failed AND s.run = 4 FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1) SELECT * FROM s) WHERE fired""")
def _(t):
    # Events lie days apart, so the cooldown does too.
    return played(t, t("auth_events"), "ts", lambda s: S.lockout_stream(s, 5, 7 * 86400, DELAY, "60 days"))


_DRIFT = f"""SELECT d.centre_id, d.day, {S6('d.score')} AS score, d.n, {S6('d.score - b.baseline')} AS drift FROM (SELECT centre_id, strftime(run_at, '%Y-%m-%d') AS day, avg(score) AS score, count(*) AS n FROM {{reference_runs}} GROUP BY 1, 2) d
 JOIN (SELECT centre_id, avg(score) AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY centre_id ORDER BY run_at) AS k FROM {{reference_runs}}) WHERE k <= 7 GROUP BY 1) b ON b.centre_id = d.centre_id"""


def _baseline(t):
    return group_cap(t("reference_runs"), 7, ["centre_id"], "run_at").groupBy("centre_id").agg(F.avg("score").alias("baseline"))


@query("M10_daily_drift", _DRIFT)
def _(t):
    d = Q.daily_drift(t("reference_runs"), _baseline(t))
    return d.select("centre_id", "day", r6("score").alias("score"), "n", r6("drift").alias("drift"))


@query("M10_daily_drift_stream", _DRIFT)
def _(t):
    runs = t("reference_runs").withColumn("run_at", F.col("run_at").cast("timestamp"))
    d = played(t, runs, "run_at", lambda s: S.daily_drift_stream(s, _baseline(t), DELAY)).where("drift is not null")
    return d.select("centre_id", "day", r6("score").alias("score"), "n", r6("drift").alias("drift"))
