"""Queries over rules, verdicts and lot estimation, with SQL twins written against the rule table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lotlens.catalog.core import query, shared
from lotlens.functions.numeric import percent, round_half_up
from lotlens.operators import lots as L
from lotlens.operators import rules as R
from lotlens.plans import grade as G
from lotlens.plans.session import materialise
from lotlens.sources import packs as P

REPLICATES = P.default_pack().bootstrap_b  # every published pack has as many


def r6(c):
    return round_half_up(c, 6)


# ---- shared SQL: outcomes, verdicts, looks, trays, totals -----------------------------------------------
_frac = lambda m: (f"SELECT lot_id, bulb_id, '{m}' AS measure, {m} AS v, "  # noqa: E731
                   f"fsd*2*sqrt(least(1.0, greatest(0.0, coalesce({m},0)/1000.0))*(1-least(1.0, greatest(0.0, coalesce({m},0)/1000.0)))) AS sd FROM {{bulbs}}")
shared("o_measures", " UNION ALL ".join(
    ["SELECT lot_id, bulb_id, 'size' AS measure, size_min AS v, CAST(size_sd AS DOUBLE) AS sd FROM {bulbs}"]
    + [_frac(m) for m in P.DEFECTS]
    + [f"SELECT lot_id, bulb_id, '{m}' AS measure, CAST({c} AS INT) AS v, CAST(0 AS DOUBLE) AS sd FROM {{bulbs}}" for m, c in R.SHAPE_COLUMNS.items()]))
_ok = lambda e: f"CASE op WHEN '<=' THEN {e} <= lim WHEN '<' THEN {e} < lim WHEN '>=' THEN {e} >= lim WHEN '>' THEN {e} > lim ELSE {e} = lim END"
_show = lambda e: (f"CASE WHEN measure IN ('double','bottleneck','split') THEN (CASE WHEN {e} <> 0 THEN 'YES' ELSE 'NO' END) "  # noqa: E731
                   f"ELSE (CASE WHEN ({e}) % 10 = 0 THEN CAST(({e})//10 AS VARCHAR) ELSE CAST(({e})//10 AS VARCHAR) || '.' || CAST(({e}) % 10 AS VARCHAR) END)"
                   " || CASE WHEN measure = 'size' THEN 'MM' ELSE 'PCT' END END")
shared("o_outcomes", f"""
SELECT *, CASE WHEN outcome = 'na' THEN 'NOT_ASSESSED_' || upper(measure)
  ELSE (CASE WHEN outcome = 'borderline' THEN 'BORDERLINE_' ELSE '' END) || upper(measure) || '_' || {_show('v')} || '_' ||
   (CASE op WHEN '<=' THEN 'GT' WHEN '<' THEN 'GE' WHEN '>=' THEN 'LT' WHEN '>' THEN 'LE' ELSE 'NE' END) || '_' || {_show('lim')} END AS code
FROM (SELECT *, CASE WHEN v IS NULL THEN 'na' WHEN ({_ok('v - margin')}) AND ({_ok('v + margin')}) THEN 'pass'
   WHEN NOT ({_ok('v - margin')}) AND NOT ({_ok('v + margin')}) THEN 'fail' ELSE 'borderline' END AS outcome
 FROM (SELECT m.lot_id, m.bulb_id, m.v, r.*, CASE WHEN op = '==' THEN 0 ELSE CAST(floor(m.sd*p.k_sigma + 0.5) AS INT) END AS margin
  FROM {{o_measures}} m JOIN {{pack_rules}} r ON m.measure = r.measure JOIN {{packs}} p ON p.pack_id = r.pack_id))
""")
shared("o_stages", """
SELECT lot_id, bulb_id, pack_id, stage, bucket, bool_or(outcome='fail') AS failed, bool_or(outcome='borderline') AS border,
 list(code ORDER BY rule_ord) FILTER (WHERE outcome='fail') AS fails, list(code ORDER BY rule_ord) FILTER (WHERE outcome='borderline') AS borders,
 list(code ORDER BY rule_ord) FILTER (WHERE outcome='na') AS nas
FROM {o_outcomes} GROUP BY ALL
""")
shared("o_decided", """
SELECT *, CASE WHEN stage=0 AND failed THEN 'REJECT' WHEN border AND NOT failed THEN 'REFER' WHEN stage>0 AND NOT failed THEN bucket END AS decided
FROM {o_stages}
""")
shared("o_first", """
SELECT lot_id, bulb_id, pack_id, min(stage) FILTER (WHERE decided IS NOT NULL) AS at_stage FROM {o_decided} GROUP BY ALL
""")
shared("o_verdicts", """
SELECT b.lot_id, b.bulb_id, b.tray, b.look, b.w, p.pack_id,
 CASE WHEN b.conf < p.min_conf THEN 'REFER' ELSE coalesce(d.decided, 'REJECT') END AS bucket, b.conf, p.min_conf, f.at_stage
FROM {bulbs} b CROSS JOIN {packs} p JOIN {o_first} f ON f.lot_id=b.lot_id AND f.bulb_id=b.bulb_id AND f.pack_id=p.pack_id
LEFT JOIN {o_decided} d ON d.lot_id=b.lot_id AND d.bulb_id=b.bulb_id AND d.pack_id=p.pack_id AND d.stage=f.at_stage
""")
shared("o_reason_lists", """
SELECT v.lot_id, v.bulb_id, v.pack_id, v.bucket, v.conf, v.min_conf, v.at_stage,
 coalesce(flatten(list(CASE WHEN s.stage = 0 AND v.at_stage IS DISTINCT FROM 0 THEN []
   WHEN v.at_stage IS NULL OR s.stage < v.at_stage THEN coalesce(s.fails, [])
   WHEN s.stage = v.at_stage AND v.bucket='REJECT' THEN coalesce(s.fails, [])
   WHEN s.stage = v.at_stage AND v.bucket='REFER' THEN coalesce(s.borders, []) ELSE [] END ORDER BY s.stage)), []) AS cl,
 coalesce(flatten(list(CASE WHEN v.at_stage IS NULL OR s.stage <= v.at_stage THEN coalesce(s.nas, []) ELSE [] END ORDER BY s.stage)), []) AS nl
FROM {o_verdicts} v JOIN {o_stages} s ON s.lot_id=v.lot_id AND s.bulb_id=v.bulb_id AND s.pack_id=v.pack_id
GROUP BY v.lot_id, v.bulb_id, v.pack_id, v.bucket, v.conf, v.min_conf, v.at_stage
""")
shared("o_reasons", """
SELECT lot_id, bulb_id, pack_id, bucket, CASE WHEN conf < min_conf THEN 'LOW_CONFIDENCE_' || conf || '_LT_' || min_conf
  WHEN at_stage IS NULL THEN array_to_string(list_filter(cl, lambda x, i: list_position(cl, x) = i), '|') ELSE array_to_string(cl, '|') END AS codes,
 CASE WHEN conf < min_conf THEN '' ELSE array_to_string(nl, '|') END AS notes FROM {o_reason_lists}
""")
shared("o_last", """
SELECT lot_id, bulb_id, kind, who, to_bucket, reason FROM (SELECT *, row_number() OVER (PARTITION BY lot_id, bulb_id ORDER BY seq DESC) AS k FROM {overrides}) WHERE k = 1
""")
shared("o_final", """
SELECT v.lot_id, v.bulb_id, v.tray, v.look, v.w, v.pack_id, v.bucket AS ai,
 CASE WHEN o.kind IS NULL THEN v.bucket WHEN o.kind = 'contest' THEN 'REFER' ELSE coalesce(o.to_bucket, v.bucket) END AS bucket,
 CASE WHEN o.kind IS NOT NULL THEN o.who || ':' || o.kind || ':' || o.reason END AS actor
FROM {o_verdicts} v LEFT JOIN {o_last} o ON o.lot_id=v.lot_id AND o.bulb_id=v.bulb_id
""")


def _looks_sql(src: str) -> str:
    sums = ", ".join(f"CAST(sum(CASE WHEN bucket='{b}' THEN 1 ELSE 0 END) AS BIGINT) AS c_{s}, "
                     f"CAST(sum(CASE WHEN bucket='{b}' THEN w ELSE 0 END) AS BIGINT) AS w_{s}" for b, s in L.SHORT.items())
    return f"SELECT lot_id, pack_id, tray, look, count(*) AS n, CAST(sum(w) AS BIGINT) AS w, {sums} FROM {src} GROUP BY ALL"


def _trays_sql(src: str) -> str:
    return f"""SELECT * EXCLUDE (k) FROM (SELECT *, count(*) OVER (PARTITION BY lot_id, pack_id, tray) AS n_looks,
 row_number() OVER (PARTITION BY lot_id, pack_id, tray ORDER BY 1 - c_a/n DESC, look) AS k FROM {src}) WHERE k = 1"""


def _selected_sql(src: str) -> str:
    """Trays in long form: one row per tray and share selector with (x, n)."""
    proc = "CASE WHEN p.procured = 'GRADE_A' THEN {0}_a ELSE {0}_a + {0}_u END"
    parts = []
    for basis, b, x, n in L.SELECTORS:
        e = proc.format(x[0]) if b == "PROCURED" else x
        parts.append(f"SELECT t.lot_id, t.pack_id, t.tray, '{basis}' AS basis, '{b}' AS bucket, {e} AS x, {n} AS m, n AS items "
                     f"FROM {src} t JOIN {{packs}} p ON p.pack_id = t.pack_id")
    return " UNION ALL ".join(parts)


def _shares_sql(src: str) -> str:
    return f"""
SELECT s.lot_id, s.pack_id, s.basis, s.bucket, any_value(g.k) AS n_trays, any_value(g.items) AS n, any_value(g.p) AS p,
 CASE WHEN any_value(g.k) < 2 OR any_value(g.p) <= 0 OR any_value(g.p) >= 1 THEN 1 ELSE greatest(1, least(
  (any_value(g.k)/(any_value(g.k)-1.0))*sum(pow(s.x - g.p*s.m, 2))/pow(any_value(g.tot),2)/(any_value(g.p)*(1-any_value(g.p))/any_value(g.tot)),
  any_value(g.tot)/any_value(g.k))) END AS deff
FROM {src} s JOIN (SELECT lot_id, pack_id, basis, bucket, count(*) AS k, sum(x) AS xs, sum(m) AS tot, sum(items) AS items, sum(x)/sum(m) AS p
  FROM {src} GROUP BY ALL) g ON g.lot_id=s.lot_id AND g.pack_id=s.pack_id AND g.basis=s.basis AND g.bucket=s.bucket
GROUP BY s.lot_id, s.pack_id, s.basis, s.bucket"""


def _boot_sql(trays: str, b: int, seed: str, level: float = 0.95) -> str:
    lo, hi = L.quantile_positions(b, level)
    sums = ", ".join(f"sum({c}) AS {c}" for c in ["n", "w", *L.COUNTS, *L.WEIGHTS])
    proc = "CASE WHEN p.procured = 'GRADE_A' THEN {0}_a ELSE {0}_a + {0}_u END"
    long = " UNION ALL ".join(
        f"SELECT s.lot_id, s.pack_id, rep, '{basis}' AS basis, '{bk}' AS bucket, ({proc.format(x[0]) if bk == 'PROCURED' else x})/{n} AS v "
        f"FROM sums s JOIN {{packs}} p ON p.pack_id = s.pack_id" for basis, bk, x, n in L.SELECTORS)
    return f"""
SELECT lot_id, pack_id, basis, bucket, list_sort(list(v))[{lo + 1}] AS lo, list_sort(list(v))[{hi + 1}] AS hi FROM (
 WITH idx AS (SELECT *, row_number() OVER (PARTITION BY lot_id, pack_id ORDER BY tray) - 1 AS i, count(*) OVER (PARTITION BY lot_id, pack_id) AS k FROM {trays}),
 seeds AS (SELECT DISTINCT lot_id, pack_id, k, {seed} AS seed FROM idx WHERE k >= 3),
 draws AS (SELECT lot_id, pack_id, rep, CAST('0x' || substr(md5(seed || '|' || rep || '|' || (j // 4)), 1 + 8*(j % 4), 8) AS BIGINT) % k AS i
   FROM seeds, range({b}) r(rep), range(8) d(j) WHERE j < k),
 sums AS (SELECT d.lot_id, d.pack_id, d.rep, {sums} FROM draws d JOIN idx t ON t.lot_id=d.lot_id AND t.pack_id=d.pack_id AND t.i=d.i GROUP BY ALL)
 {long}) GROUP BY ALL"""


def _intervals_sql(shares: str, boot: str) -> str:
    return f"""
SELECT lot_id, pack_id, basis, bucket, n_trays, n, p, deff, floor(100*p*100+0.5)/100 AS est,
 CASE WHEN n_trays >= 3 THEN 'cluster-bootstrap' ELSE 'wilson-deff' END AS method,
 floor(100*(CASE WHEN n_trays >= 3 THEN lo ELSE greatest(0, (k/ne + 3.8416/(2*ne) - 1.96*sqrt((k/ne)*(1-k/ne)/ne + 3.8416/(4*ne*ne)))/(1+3.8416/ne)) END)*100+0.5)/100 AS ci_lo,
 floor(100*(CASE WHEN n_trays >= 3 THEN hi ELSE least(1, (k/ne + 3.8416/(2*ne) + 1.96*sqrt((k/ne)*(1-k/ne)/ne + 3.8416/(4*ne*ne)))/(1+3.8416/ne)) END)*100+0.5)/100 AS ci_hi
FROM (SELECT *, floor(p*ne+0.5) AS k FROM (SELECT s.*, b.lo, b.hi, greatest(1, floor(s.n/s.deff+0.5)) AS ne FROM {shares} s
 LEFT JOIN {boot} b ON b.lot_id=s.lot_id AND b.pack_id=s.pack_id AND b.basis=s.basis AND b.bucket=s.bucket))"""


def _decision_sql(trays: str, shares: str) -> str:
    return f"""
SELECT *, CASE WHEN rs > refer_share_max OR (sprt_decision='SAMPLE_MORE' AND n_trays >= max_trays) THEN 'REFER_TO_HUMAN' ELSE sprt_decision END AS decision,
 CASE WHEN sprt_decision <> 'SAMPLE_MORE' THEN 0 WHEN abs(drift) > 1e-9 THEN CAST(greatest(1, ceil(((CASE WHEN drift > 0 THEN upper ELSE lower END) - llr)/drift)) AS BIGINT) ELSE -1 END AS trays_more
FROM (SELECT *, CASE WHEN llr >= upper THEN 'REJECT_LOT' WHEN llr <= lower THEN 'ACCEPT_LOT' ELSE 'SAMPLE_MORE' END AS sprt_decision,
 (n/n_trays)*(rate*l1 + (1-rate)*l0)/d AS drift
FROM (SELECT *, (bad*l1 + (n-bad)*l0)/d AS llr, least(0.999, greatest(0.001, bad/greatest(1,n))) AS rate
FROM (SELECT t.lot_id, t.pack_id, count(*) AS n_trays, max(n_looks) AS n_looks, CAST(sum(t.n) AS BIGINT) AS n, sum(c_f)/sum(t.n) AS rs,
  sum(CASE WHEN p.bad = 'REJECT' THEN c_r ELSE c_u + c_r END) AS bad, any_value(p.max_trays) AS max_trays, any_value(p.refer_share_max) AS refer_share_max,
  any_value(ln((1-beta)/alpha)) AS upper, any_value(ln(beta/(1-alpha))) AS lower, any_value(ln(p1/p0)) AS l1, any_value(ln((1-p1)/(1-p0))) AS l0,
  greatest(1, any_value(s.deff)) AS d
 FROM {trays} t JOIN {{packs}} p ON p.pack_id=t.pack_id JOIN {shares} s ON s.lot_id=t.lot_id AND s.pack_id=t.pack_id AND s.basis='count' AND s.bucket='GRADE_A'
 GROUP BY t.lot_id, t.pack_id)))"""


_OWN_SEED = "sha256('lot-bootstrap|' || CAST(lot_id AS VARCHAR))"
_SEED = f"CASE WHEN lot_id % 2 = 0 THEN 'recorded-' || CAST(lot_id AS VARCHAR) ELSE {_OWN_SEED} END"


def _seeds(t):
    """Every second lot has a recorded sampling seed."""
    return t("lots").where("lot_id % 2 = 0").select("lot_id", F.concat(F.lit("recorded-"), F.col("lot_id").cast("string")).alias("sampling_seed"))


for suffix, src in (("", "{o_verdicts}"), ("_h", "{o_final}")):  # _h: after human actions
    shared(f"o_looks{suffix}", _looks_sql(src))
    shared(f"o_trays{suffix}", _trays_sql("{o_looks%s}" % suffix))
    shared(f"o_sel{suffix}", _selected_sql("{o_trays%s}" % suffix))
    shared(f"o_shares{suffix}", _shares_sql("{o_sel%s}" % suffix))
    shared(f"o_boot{suffix}", _boot_sql("{o_trays%s}" % suffix, REPLICATES, _SEED if suffix else _OWN_SEED))
    shared(f"o_intervals{suffix}", _intervals_sql("{o_shares%s}" % suffix, "{o_boot%s}" % suffix))
    shared(f"o_decisions{suffix}", _decision_sql("{o_trays%s}" % suffix, "{o_shares%s}" % suffix))

_HEAD = """SELECT i.lot_id, i.pack_id, max(CASE WHEN bucket='GRADE_A' THEN est END) AS grade_a, max(CASE WHEN bucket='URS' THEN est END) AS urs,
 max(CASE WHEN bucket='REJECT' THEN est END) AS reject, max(CASE WHEN bucket='REFER' THEN est END) AS refer,
 max(CASE WHEN bucket='GRADE_A' THEN ci_lo END) AS grade_a_lo, max(CASE WHEN bucket='GRADE_A' THEN ci_hi END) AS grade_a_hi,
 max(CASE WHEN bucket='PROCURED' THEN est END) AS procured, max(CASE WHEN bucket='PROCURED' THEN ci_lo END) AS procured_lo,
 max(CASE WHEN bucket='PROCURED' THEN ci_hi END) AS procured_hi, any_value(d.decision) AS decision{extra}
FROM {{o_intervals{s}}} i JOIN {{o_decisions{s}}} d ON d.lot_id=i.lot_id AND d.pack_id=i.pack_id WHERE basis='weight' GROUP BY i.lot_id, i.pack_id"""
shared("o_headline", _HEAD.replace("{extra}", "").replace("{s}", "").replace("{{", "{").replace("}}", "}"))
_EXTRA = (", any_value(d.n_trays) AS n_trays, any_value(d.n_looks) AS n_looks, any_value(d.n) AS n_items, "
          "floor(100*any_value(d.rs)*100+0.5)/100 AS refer_share, any_value(d.trays_more) AS trays_more")
_GRADED = _HEAD.replace("{extra}", _EXTRA).replace("{s}", "_h").replace("{{", "{").replace("}}", "}")
shared("o_graded", _GRADED)


# ---- queries ----------------------------------------------------------------------------------------------

@query("graded_bucket_table", """
SELECT lot_id, bucket, max(CASE WHEN basis='count' THEN CAST(floor(p*n+0.5) AS BIGINT) END) AS n, max(CASE WHEN basis='count' THEN floor(100*p*100+0.5)/100 END) AS est_by_count,
 max(CASE WHEN basis='weight' THEN floor(100*p*100+0.5)/100 END) AS est_by_weight
FROM {o_shares} WHERE pack_id='in-psf-2026-07-30-a-only' AND bucket <> 'PROCURED' GROUP BY lot_id, bucket""")
def _(t):
    return G.graded_bucket_table(t("bulbs"), P.default_pack())


@query("R01_eval_rules", """SELECT pack_id, stage, CAST(rule_ord AS INT) AS rule_ord, measure, outcome, count(*) AS n, CAST(sum(margin) AS BIGINT) AS margin_sum
FROM {o_outcomes} GROUP BY ALL""")
def _(t):
    out = R.eval_rules(t("bulbs"), t("pack_rules"), t("packs"))
    return out.groupBy("pack_id", "stage", "rule_ord", "measure", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("margin").alias("margin_sum"))


@query("R02_adjudicate", "SELECT lot_id, bulb_id, bucket, codes, notes FROM {o_reasons} WHERE pack_id='in-psf-2026-07-30-a-only'")
def _(t):
    v = R.adjudicate(t("bulbs"), [P.default_pack()])
    return v.select("lot_id", "bulb_id", "bucket", F.array_join("codes", "|").alias("codes"), F.array_join("notes", "|").alias("notes"))


@query("R02_adjudicate_all_packs", """SELECT pack_id, bucket, codes, notes, count(*) AS n FROM {o_reasons} GROUP BY ALL""")
def _(t):
    v = R.adjudicate(t("bulbs"), P.PACKS)
    return (v.select("pack_id", "bucket", F.array_join("codes", "|").alias("codes"), F.array_join("notes", "|").alias("notes"))
            .groupBy("pack_id", "bucket", "codes", "notes").agg(F.count(F.lit(1)).alias("n")))


@query("R02_verdicts_from_rule_table", "SELECT lot_id, pack_id, bucket, count(*) AS n FROM {o_verdicts} GROUP BY ALL")
def _(t):
    outcomes = R.eval_rules(t("bulbs"), t("pack_rules"), t("packs"))
    v = R.verdicts_from_outcomes(outcomes, t("bulbs"), t("packs"), t("pack_rules"))
    return v.groupBy("lot_id", "pack_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("R03_apply_overrides", "SELECT lot_id, bulb_id, ai, bucket AS final, actor FROM {o_final} WHERE pack_id='in-psf-2026-07-30-a-only'")
def _(t):
    v = R.bucket_verdicts(t("bulbs"), [P.default_pack()], ("lot_id", "bulb_id"))
    return R.apply_overrides(v, t("overrides")).select("lot_id", "bulb_id", "ai", "final", "actor")


@query("R04_time_travel", """SELECT lot_id, pack_id, max(CASE WHEN bucket='GRADE_A' THEN est END) AS grade_a, max(CASE WHEN bucket='PROCURED' THEN est END) AS procured
FROM (SELECT *, floor(100*p*100+0.5)/100 AS est FROM {o_shares_h}) WHERE basis='weight' GROUP BY lot_id, pack_id""")
def _(t):
    s = L.lot_shares(G.graded_trays(t("bulbs"), P.PACKS, t("overrides")), P.PACKS).where(F.col("basis") == "weight")
    return s.groupBy("lot_id", "pack_id").agg(F.max(F.when(F.col("bucket") == "GRADE_A", F.col("est"))).alias("grade_a"),
                                              F.max(F.when(F.col("bucket") == "PROCURED", F.col("est"))).alias("procured"))


@query("R05_pack_in_force", """SELECT l.lot_id, CAST(l.purchase_date AS VARCHAR) AS purchase_date, p.pack_id FROM {lots} l JOIN {packs} p
 ON CAST(l.purchase_date AS VARCHAR) BETWEEN p.effective_from AND coalesce(p.effective_to, '9999-12-31')""")
def _(t):
    return R.pack_in_force(t("lots"), P.PACKS).select("lot_id", F.col("purchase_date").cast("string").alias("purchase_date"),
                                                       F.col("pack_id"))


@query("R06_pack_limits", """WITH lim AS (SELECT pack_id, measure, lim FROM (SELECT *, row_number() OVER (PARTITION BY pack_id, measure
  ORDER BY (stage > 0) DESC, stage, CASE WHEN stage > 0 THEN -rule_ord ELSE rule_ord END) AS k FROM {pack_rules} WHERE measure NOT IN ('size','double','bottleneck','split')) WHERE k = 1)
SELECT l.pack_id, l.measure, any_value(l.lim) AS lim, count(*) AS n_items, count(*) FILTER (WHERE m.v > l.lim) AS n_over FROM lim l JOIN {o_measures} m ON m.measure = l.measure GROUP BY l.pack_id, l.measure""")
def _(t):
    m = R.unpivot_measures(t("bulbs"), ("lot_id",))
    j = m.join(R.pack_limits(t("pack_rules")), "measure")
    return j.groupBy("pack_id", "measure").agg(F.max("lim").alias("lim"), F.count(F.lit(1)).alias("n_items"),
                                               F.count_if(F.col("value") > F.col("lim")).alias("n_over"))


@query("R09_reason_census", """SELECT reason, n FROM (SELECT regexp_replace(code, '^(.*?)_[\\d.]+(PCT|MM)_', '\\1_x_') AS reason, count(*) AS n
 FROM (SELECT unnest(string_split(codes, '|')) AS code FROM {o_reasons} WHERE pack_id='in-psf-2026-07-30-a-only' AND codes <> '') GROUP BY 1) ORDER BY n DESC, reason LIMIT 14""")
def _(t):
    return R.reason_census(R.adjudicate(t("bulbs"), [P.default_pack()]), 14)


@query("P28_reason_template", """SELECT pack_id, regexp_replace(code, '^(.*?)_[\\d.]+(PCT|MM)_', '\\1_x_') AS reason, count(*) AS n
 FROM (SELECT pack_id, unnest(string_split(codes, '|')) AS code FROM {o_reasons} WHERE codes <> '') GROUP BY ALL""")
def _(t):
    v = R.adjudicate(t("bulbs"), P.PACKS, ())
    return v.select("pack_id", F.explode("codes").alias("c")).groupBy("pack_id", R.reason_template("c").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("P27_reason_code", """SELECT code, count(*) AS n FROM {o_outcomes} WHERE outcome IN ('fail','borderline') AND pack_id='in-psf-2026-06-relaxed-b' GROUP BY code""")
def _(t):
    pack = P.pack_by_id("in-psf-2026-06-relaxed-b")
    b = R.with_margins(t("bulbs"), [pack])
    os_ = [R.Outcome(r, pack) for _, _, rules in pack.stages() for r in rules]
    codes = ", ".join(f"CASE WHEN {o.fail} THEN {o.code()} WHEN {o.border} THEN {o.code(True)} END" for o in os_)
    return b.selectExpr(f"explode(array_compact(array({codes}))) AS code").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("P03_size_of", """SELECT CAST(p.size_metric AS VARCHAR) AS metric, lot_id, CAST(sum(CASE p.size_metric WHEN 'min_feret' THEN size_min WHEN 'max_feret' THEN size_max
  ELSE CAST(floor((size_min+size_max)/2.0+0.5) AS INT) END) AS BIGINT) AS size_sum FROM {bulbs}, (VALUES ('min_feret'),('max_feret'),('mean_feret')) p(size_metric) GROUP BY ALL""")
def _(t):
    metrics = F.explode(F.array(*[F.lit(m) for m in ("min_feret", "max_feret", "mean_feret")])).alias("metric")
    b = t("bulbs").select("lot_id", "size_min", "size_max", metrics)
    return b.groupBy("metric", "lot_id").agg(F.sum(R.size_of(F.col("metric"))).alias("size_sum"))


@query("A01_look_aggregates", "SELECT *, floor(100*(1 - c_a/n)*100+0.5)/100 AS non_a_pct FROM {o_looks}")
def _(t):
    return G.graded_looks(t("bulbs"), P.PACKS).withColumn("non_a_pct", percent(L.non_grade_a()))


@query("A02_merge_looks", "SELECT * EXCLUDE (look) FROM {o_trays}")
def _(t):
    return G.graded_trays(t("bulbs"), P.PACKS)


@query("A02_merge_looks_mean", "SELECT lot_id, pack_id, tray, " + ", ".join(f"floor(avg({c})*1e6+0.5)/1e6 AS {c}" for c in L.TALLY) + ", count(*) AS n_looks FROM {o_looks} GROUP BY ALL")
def _(t):
    m = L.merge_looks(G.graded_looks(t("bulbs"), P.PACKS), "mean")
    return m.select("lot_id", "pack_id", "tray", *[r6(c).alias(c) for c in L.TALLY], "n_looks")


@query("A03_lot_shares", "SELECT lot_id, pack_id, basis, bucket, n_trays, CAST(n AS DOUBLE) AS n, floor(p*1e6+0.5)/1e6 AS p, floor(100*p*100+0.5)/100 AS est FROM {o_shares}")
def _(t):
    s = L.lot_shares(G.graded_trays(t("bulbs")), P.PACKS)
    return s.select("lot_id", "pack_id", "basis", "bucket", "n_trays", "n", r6("p").alias("p"), "est")


@query("A04_design_effect", "SELECT lot_id, pack_id, basis, bucket, floor(deff*1e6+0.5)/1e6 AS deff FROM {o_shares}")
def _(t):
    s = L.lot_shares(G.graded_trays(t("bulbs")), P.PACKS)
    return s.select("lot_id", "pack_id", "basis", "bucket", r6("deff").alias("deff"))


@query("A05_wilson", """SELECT lot_id, pack_id, tray, look, floor(1e6*greatest(0,(c_a/n + 3.8416/(2*n) - 1.96*sqrt((c_a/n)*(1-c_a/n)/n + 3.8416/(4.0*n*n)))/(1+3.8416/n))+0.5)/1e6 AS lo,
 floor(1e6*least(1,(c_a/n + 3.8416/(2*n) + 1.96*sqrt((c_a/n)*(1-c_a/n)/n + 3.8416/(4.0*n*n)))/(1+3.8416/n))+0.5)/1e6 AS hi FROM {o_looks}""")
def _(t):
    from lotlens.functions.numeric import wilson
    lo, hi = wilson("c_a", "n")
    return G.graded_looks(t("bulbs")).select("lot_id", "pack_id", "tray", "look", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query("A06_lot_intervals", "SELECT lot_id, pack_id, basis, bucket, est, ci_lo, ci_hi, method FROM {o_intervals}")
def _(t):
    i, _d = G.lot_results(G.graded_trays(t("bulbs")), P.PACKS)
    return i.select("lot_id", "pack_id", "basis", "bucket", "est", "ci_lo", "ci_hi", "method")


@query("A07_jeffreys")
def _(t):
    s = L.with_jeffreys(L.lot_shares(G.graded_trays(t("bulbs")), P.PACKS))
    return s.select("lot_id", "pack_id", "basis", "bucket", "est", "bayes_lo", "bayes_hi")


@query("A08_cluster_bootstrap", "SELECT lot_id, pack_id, basis, bucket, floor(lo*1e6+0.5)/1e6 AS lo, floor(hi*1e6+0.5)/1e6 AS hi FROM {o_boot}")
def _(t):
    b = L.cluster_bootstrap(materialise(G.graded_trays(t("bulbs"))), P.PACKS)
    return b.select("lot_id", "pack_id", "basis", "bucket", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("A08_cluster_bootstrap_joined", "SELECT lot_id, pack_id, basis, bucket, floor(lo*1e6+0.5)/1e6 AS lo, floor(hi*1e6+0.5)/1e6 AS hi FROM {o_boot}")
def _(t):
    b = L.cluster_bootstrap(materialise(G.graded_trays(t("bulbs"))), P.PACKS, row_trays=4)
    return b.select("lot_id", "pack_id", "basis", "bucket", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("A09_sprt", "SELECT lot_id, pack_id, sprt_decision, trays_more, floor(llr*1e4+0.5)/1e4 AS llr, floor(upper*1e6+0.5)/1e6 AS upper, floor(lower*1e6+0.5)/1e6 AS lower FROM {o_decisions}")
def _(t):
    s = L.sprt(L.lot_totals(G.graded_trays(t("bulbs")), P.PACKS), P.PACKS)
    return s.select("lot_id", "pack_id", "sprt_decision", "trays_more", round_half_up("llr", 4).alias("llr"), r6("upper").alias("upper"), r6("lower").alias("lower"))


@query("A10_lot_decision", "SELECT lot_id, pack_id, floor(100*rs*100+0.5)/100 AS refer_share, decision FROM {o_decisions}")
def _(t):
    s = L.sprt(L.lot_totals(G.graded_trays(t("bulbs")), P.PACKS), P.PACKS)
    return L.lot_decision(s, P.PACKS).select("lot_id", "pack_id", "refer_share", "decision")


_R2 = lambda c: f"floor({c}*100+0.5)/100"


@query("A11_grade_lots", f"""SELECT g.*, {_R2('d.d')} AS deff, {_R2('d.llr')} AS llr, {_R2('d.upper')} AS llr_reject, {_R2('d.lower')} AS llr_accept, coalesce(a.o, 0) AS overridden, coalesce(a.c, 0) AS contested
FROM {{o_graded}} g JOIN {{o_decisions_h}} d ON d.lot_id = g.lot_id AND d.pack_id = g.pack_id
LEFT JOIN (SELECT lot_id, count(*) FILTER (WHERE kind = 'override') AS o, count(*) FILTER (WHERE kind = 'contest') AS c FROM {{overrides}} GROUP BY lot_id) a ON a.lot_id = g.lot_id""")
def _(t):
    return G.grade_lots(t("bulbs"), P.PACKS, t("overrides"), seeds=_seeds(t)).drop("shares")


@query("A11_all_shares", """SELECT lot_id, pack_id, basis, bucket, CAST(floor(p*n+0.5) AS BIGINT) AS k, est, ci_lo, ci_hi, method, true AS bounded FROM {o_intervals_h}""")
def _(t):
    g = G.grade_lots(t("bulbs"), P.PACKS, t("overrides"), seeds=_seeds(t)).select("lot_id", "pack_id", F.inline("shares"))
    bounded = (F.col("bayes_lo") <= F.col("est") + 0.5) & (F.col("bayes_hi") >= F.col("est") - 0.5)
    return g.withColumn("bounded", bounded).drop("bayes_lo", "bayes_hi")


@query("A11_mean_of_looks", """SELECT lot_id, bucket, CAST(floor(sum(x)/sum(m)*10000+0.5) AS BIGINT) AS basis_points FROM (SELECT lot_id, tray, unnest(['GRADE_A', 'URS', 'REJECT', 'REFER']) AS bucket,
 unnest([avg(w_a), avg(w_u), avg(w_r), avg(w_f)]) AS x, avg(w) AS m FROM {o_looks} WHERE pack_id = 'in-psf-2026-07-30-a-only' GROUP BY lot_id, tray) GROUP BY lot_id, bucket""")
def _(t):
    packs = [replace(P.default_pack(), look_merge="mean")]
    s = L.lot_shares(G.graded_trays(t("bulbs"), packs), packs).where("basis = 'weight' AND bucket <> 'PROCURED'")
    return s.select("lot_id", "bucket", F.floor(F.col("p") * 10000 + 0.5).alias("basis_points"))


@query("A12_headline", "SELECT * FROM {o_headline}")
def _(t):
    return L.headline(*G.lot_results(G.graded_trays(t("bulbs")), P.PACKS))


@query("A13_indicative_value", """SELECT h.lot_id, h.pack_id, CAST(floor(l.declared_kg/100.0*2400*h.procured_lo/100+0.5) AS BIGINT) AS value_low,
 CAST(floor(l.declared_kg/100.0*2400*h.procured/100+0.5) AS BIGINT) AS value_mid, CAST(floor(l.declared_kg/100.0*2400*h.procured_hi/100+0.5) AS BIGINT) AS value_high
FROM {o_headline} h JOIN {lots} l ON l.lot_id = h.lot_id""")
def _(t):
    h = L.headline(*G.lot_results(G.graded_trays(t("bulbs")), P.PACKS))
    j = h.join(t("lots").select("lot_id", "declared_kg"), "lot_id")
    return j.select("lot_id", "pack_id", *L.indicative_value("declared_kg", 2400.0, "procured_lo", "procured", "procured_hi"))


@query("A14_look_spread", """SELECT lot_id, pack_id, count(*) AS n_repeat_trays, floor(avg(hi-lo)*1e4+0.5)/1e4 AS mean_spread, max(hi-lo) AS max_spread, floor(avg(v2-v1)*1e4+0.5)/1e4 AS mean_second_change
FROM (SELECT lot_id, pack_id, tray, max(v) AS hi, min(v) AS lo, max(CASE WHEN k=1 THEN v END) AS v1, max(CASE WHEN k=2 THEN v END) AS v2, count(*) AS c
 FROM (SELECT *, floor(100*(1 - c_a/n)*100+0.5)/100 AS v, row_number() OVER (PARTITION BY lot_id, pack_id, tray ORDER BY look) AS k FROM {o_looks}) GROUP BY ALL)
WHERE c > 1 GROUP BY ALL""")
def _(t):
    return L.look_spread(G.graded_looks(t("bulbs")))
