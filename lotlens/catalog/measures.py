"""Queries over measurements, text hygiene, pooled looks, disputes and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.catalog.core import query, shared
from lotlens.functions.numeric import round_half_up, wilson_percent
from lotlens.operators import disputes as D
from lotlens.operators import measure as M
from lotlens.operators import pooled as K
from lotlens.operators import text as X
from lotlens.sources.packs import DEFECTS


def r6(c):
    return round_half_up(c, 6)


def r4(c):
    return round_half_up(c, 4)


S6 = "floor(({})*1e6+0.5)/1e6".format
S4 = "floor(({})*1e4+0.5)/1e4".format

ITEM_KEY = ["capture_id", "pos"]


def captures(t, *fields):
    """Nested captures as stored: one row per photo with its items in order; with ``fields`` of items, these alone are read.

    Items of one photo have places of their own, so other fields need not be carried to order them. Rows without a photo's
    id meet in groups where places repeat, and there all fields decide the order.
    """
    body = [c for c in t("raw_items").columns if c not in ("capture_id", "lot_id", "tray", "look", "shot_at", "pos")]
    if not fields:
        return _nested(t("raw_items"), body)
    named = F.col("l_suppkey").isNotNull() & F.col("l_orderkey").isNotNull()  # a photo's id is made of both
    known, lost = (t.over("raw_items", lineitem=t("lineitem").where(rows)) for rows in (named, ~named))
    return _nested(known, fields).unionByName(_nested(lost, body).withColumn("bulbs", F.transform("bulbs", lambda b: F.struct(*[b[c].alias(c) for c in fields]))))


def _nested(raw, body):
    nested = raw.groupBy("capture_id", "lot_id", "tray", "look", "shot_at").agg(F.array_sort(F.collect_list(F.struct("pos", *body))).alias("bulbs"))
    return nested.withColumn("bulbs", F.transform("bulbs", lambda b: b.dropFields("pos")))


@query("P01_usable_bulbs", """SELECT lot_id, 'b' || (row_number() OVER (PARTITION BY lot_id ORDER BY shot_at, capture_id, pos) - 1) AS bulb_id, capture_id, pos FROM {raw_items} WHERE excluded IS NULL""")
def _(t):
    text = captures(t, "excluded").withColumn("at", F.date_format("shot_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))  # as captures store it
    return M.usable_bulbs(text).select("lot_id", "bulb_id", "capture_id", "pos")


_Q = lambda c, k: f"CAST(floor({c}*{k}.0+0.5) AS INT)"


@query("P02_quantise", f"""SELECT capture_id, pos, {_Q('min_mm', 10)} AS size_min, {_Q('max_mm', 10)} AS size_max, greatest(1, {_Q('sd_mm', 10)}) AS size_sd,
 {', '.join(f"{_Q(d + '_share', 1000)} AS {d}" for d in DEFECTS)}, {_Q('fsd', 1000)} AS fsd, {_Q('conf', 1000)} AS conf, least(65535, {_Q('weight_g', 10)}) AS w, least(65535, {_Q('weight_sd_g', 10)}) AS wsd FROM {{raw_items}}""")
def _(t):
    q = M.quantise(t("raw_items"))
    return q.select(*ITEM_KEY, "size_min", "size_max", "size_sd", *DEFECTS, "fsd", "conf", "w", "wsd")


@query("P04_height_correct", f"SELECT capture_id, pos, {S6('CASE WHEN cam_mm > 0 THEN min_mm/(1+min_mm/(2*cam_mm)) ELSE min_mm END')} AS d FROM {{raw_items}}")
def _(t):
    return t("raw_items").select(*ITEM_KEY, r6(M.height_correct("min_mm", "cam_mm")).alias("d"))


@query("P05_size_sigma", f"""SELECT capture_id, pos, {S6('''sqrt(pow(min_mm*(CASE tier WHEN 'aruco' THEN 0.006 WHEN 'a4' THEN 0.015 WHEN 'coin' THEN 0.03 ELSE 0.25 END),2)+pow(1.5*mm_per_px,2)
 +pow(CASE WHEN cam_mm > 0 THEN min_mm*min_mm/(2*cam_mm*cam_mm)*cam_sd_mm ELSE 0 END,2))''')} AS sigma FROM {{raw_items}}""")
def _(t):
    return t("raw_items").select(*ITEM_KEY, r6(M.size_sigma("min_mm", "tier", "mm_per_px", "cam_mm", "cam_sd_mm")).alias("sigma"))


@query("P06_predict_weight", f"SELECT capture_id, pos, {S6('0.95*pi()/6/1000*pow(min_mm,3)')} AS grams, {S6('0.18*(0.95*pi()/6/1000*pow(min_mm,3))')} AS sd FROM {{raw_items}}")
def _(t):
    g, sd = M.predict_weight("min_mm")
    return t("raw_items").select(*ITEM_KEY, r6(g).alias("grams"), r6(sd).alias("sd"))


@query("P07_fold_second_opinion", f"""SELECT capture_id, pos, gated, disagree, {S6('CASE WHEN disagree THEN least(conf, 0.45) ELSE conf END')} AS conf, {S6('CASE WHEN gated THEN 0 ELSE rot_share END')} AS rot_share,
 {S6('CASE WHEN gated THEN 0 ELSE blackening_share END')} AS blackening_share, {S6('1/(1+exp(neck_share - p1))')} AS p_soft
FROM (SELECT *, p1 < 0.2 AS gated, p1 >= 0.2 AND p1 >= 0.7 AND rot_share + blackening_share < 0.01 AS disagree FROM {{raw_items}})""")
def _(t):
    f = M.fold_second_opinion(t("raw_items"), "p1", 0.7, 0.2)
    return f.select(*ITEM_KEY, "gated", "disagree", r6("conf").alias("conf"), r6("rot_share").alias("rot_share"), r6("blackening_share").alias("blackening_share"),
                    r6(M.logit_probability("neck_share", "p1")).alias("p_soft"))


@query("P08_exclusion_reason", """SELECT capture_id, pos, CASE WHEN edge THEN 'edge' WHEN tier <> 'intrinsics' AND (max_mm < 22 OR min_mm > 120) THEN 'small' WHEN sprouting_share > 0.6 THEN 'shape'
 WHEN aspect > 3.0 OR solidity < 0.6 THEN 'shape' END AS excluded FROM {raw_items}""")
def _(t):
    return t("raw_items").select(*ITEM_KEY, M.exclusion_reason().alias("excluded"))


@query("P09_shape_flags", "SELECT capture_id, pos, solidity < 0.86 AS is_double, solidity < 0.78 AS is_split, neck_share > 0.12 AND aspect > 1.3 AS is_bottleneck FROM {raw_items}")
def _(t):
    return t("raw_items").select(*ITEM_KEY, *M.shape_flags())


@query("P10_confidence", f"""SELECT capture_id, pos, {S6('''greatest(0.05, 0.95 - CASE WHEN area_px < 900 THEN 0.35 ELSE 0 END - CASE WHEN solidity < 0.8 THEN 0.25 ELSE 0 END
 - CASE WHEN n_ref < 50 THEN 0.2 ELSE 0 END - CASE WHEN tier = 'intrinsics' THEN 0.05 ELSE 0 END)''')} AS conf FROM {{raw_items}}""")
def _(t):
    return t("raw_items").select(*ITEM_KEY, r6(M.confidence()).alias("conf"))


@query("P11_capture_gates", """SELECT event_id, first_failed, n_ok, first_failed IS NULL AS all_ok FROM (SELECT event_id,
 CASE WHEN tilt > 12 THEN 'level' WHEN sharp < 55 THEN 'sharp' WHEN light < 25 OR light > 92 THEN 'exposure' WHEN clipped > 0.12 THEN 'glare' WHEN NOT target_found THEN 'target' WHEN n_items < 1 THEN 'bulbs' END AS first_failed,
 CAST(6 - (CASE WHEN tilt > 12 THEN 1 ELSE 0 END + CASE WHEN sharp < 55 THEN 1 ELSE 0 END + CASE WHEN light < 25 OR light > 92 THEN 1 ELSE 0 END + CASE WHEN clipped > 0.12 THEN 1 ELSE 0 END + CASE WHEN NOT target_found THEN 1 ELSE 0 END + CASE WHEN n_items < 1 THEN 1 ELSE 0 END) AS INT) AS n_ok FROM {frames})""")
def _(t):
    g = t("frames").select("event_id", M.capture_gates().alias("g"))
    return g.select("event_id", M.first_failing_gate("g").alias("first_failed"), F.size(F.filter("g", lambda x: x["ok"])).alias("n_ok"),
                    F.forall("g", lambda x: x["ok"]).alias("all_ok"))


@query("P12_tilt", f"SELECT event_id, {S6('degrees(acos(greatest(-1, least(1, cos(radians(beta))*cos(radians(gamma))))))')} AS tilt FROM {{frames}}")
def _(t):
    return t("frames").select("event_id", r6(M.tilt("beta", "gamma")).alias("tilt"))


@query("P13_capture_verdict", """SELECT event_id, brightness IS NOT NULL AS checked, coalesce(brightness < 40 OR brightness > 246, false) AS blocked,
 CASE WHEN brightness < 40 THEN 'dark' WHEN brightness > 246 THEN 'overexposed' END AS reason,
 concat_ws('|', CASE WHEN brightness BETWEEN 40 AND 246 AND brightness < 70 THEN 'dim' END, CASE WHEN brightness BETWEEN 40 AND 246 AND sharpness < 20 THEN 'blurry' END) AS warnings FROM {frames}""")
def _(t):
    v = t("frames").select("event_id", *M.capture_verdict())
    return v.withColumn("warnings", F.array_join("warnings", "|"))


# ---- earlier layout ---------------------------------------------------------------------------------------
shared("o_obs", """SELECT id, lot_id, look_index, tray_id, disputed, confidence, diameter_mm,
 CASE WHEN cls IN ('sound','rotten','sprouted','black_smut','damaged_skin','doubles') THEN cls
  ELSE coalesce(list_extract(['sound','rotten','sprouted','black_smut','damaged_skin','doubles'], CASE WHEN TRY_CAST(cls AS INT) BETWEEN 0 AND 5 THEN TRY_CAST(cls AS INT) + 1 END), 'sound') END AS class,
 CASE WHEN diameter_mm IS NULL THEN 'UNKNOWN' WHEN diameter_mm >= 80 THEN 'A' WHEN diameter_mm >= 50 THEN 'B' WHEN diameter_mm >= 30 THEN 'C' ELSE 'UNDERSIZED' END AS size_grade,
 CASE WHEN confidence >= 0.75 THEN 'ACCEPT' ELSE 'REFER' END AS decision FROM {observations}""")
shared("o_pool", f"""SELECT lot_id, count(*) AS n, count(DISTINCT look_index) AS n_looks, greatest(1, count(DISTINCT tray_id)) AS n_trays,
 {', '.join(f"count(*) FILTER (WHERE class='{c}') AS n_{c}" for c in M.CLASS_NAMES)}, {', '.join(f"count(*) FILTER (WHERE size_grade='{g}') AS g_{g}" for g in M.GRADES)},
 count(*) FILTER (WHERE decision='REFER') AS n_referred, 100.0*count(*) FILTER (WHERE size_grade='A')/count(*) AS grade_a_pct FROM {{o_obs}} GROUP BY lot_id""")
shared("o_worst", """SELECT lot_id, n AS worst_n, k AS worst_k, 100*(k/n) AS defect_pct FROM (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY k/n DESC, look_index) AS rk
 FROM (SELECT lot_id, look_index, count(*) AS n, count(*) FILTER (WHERE class <> 'sound') AS k FROM {o_obs} GROUP BY ALL)) WHERE rk = 1""")


def _wp(k, n, side):
    sign, best = ("-", "greatest(0,") if side == "lo" else ("+", "least(1,")
    return f"100*{best}(({k})/({n}) + 3.8416/(2*({n})) {sign} 1.96*sqrt((({k})/({n}))*(1-({k})/({n}))/({n}) + 3.8416/(4.0*({n})*({n}))))/(1+3.8416/({n})))"


@query("P14_size_grade", "SELECT size_grade, count(*) AS n FROM {o_obs} GROUP BY 1")
def _(t):
    return t("observations").groupBy(M.size_grade().alias("size_grade")).agg(F.count(F.lit(1)).alias("n"))


@query("P15_decide", "SELECT id, decision FROM {o_obs}")
def _(t):
    return t("observations").select("id", M.decide().alias("decision"))


@query("P16_class_name", "SELECT id, class FROM {o_obs}")
def _(t):
    return t("observations").select("id", M.class_name().alias("class"))


_RAWLABEL = "concat_ws('-', CASE WHEN p_partkey % 3 = 0 THEN 'Black Smut' WHEN p_partkey % 3 = 1 THEN 'SPROUTED_x' ELSE p_name END, CASE WHEN p_partkey % 7 = 0 THEN 'Good Item' ELSE p_type END)"


@query("P17_remap_labels", "SELECT p_partkey AS id, CASE " + " ".join(f"WHEN contains(c, '{a.replace('_', '')}') THEN '{b}'" for a, b in X.LABEL_MAP) +
       f" END AS label FROM (SELECT p_partkey, replace(replace(replace(lower({_RAWLABEL}),'-',''),' ',''),'_','') AS c FROM {{part}}) WHERE label IS NOT NULL")
def _(t):
    return t("part").select(F.col("p_partkey").alias("id"), X.remap_label(F.expr(_RAWLABEL)).alias("label")).where("label IS NOT NULL")


@query("P18_polygon_to_box", f"""SELECT vec_id, n, {S6('CASE WHEN n = 4 THEN e[1] ELSE (list_min(list_transform(range(1, n, 2), lambda i: e[i])) + list_max(list_transform(range(1, n, 2), lambda i: e[i])))/2 END')} AS xc,
 {S6('CASE WHEN n = 4 THEN e[4] ELSE list_max(list_transform(range(2, n+1, 2), lambda i: e[i])) - list_min(list_transform(range(2, n+1, 2), lambda i: e[i])) END')} AS h
FROM (SELECT vec_id, CAST(n AS INT) AS n, list_transform(embedding[1:n], lambda x: CAST(x AS DOUBLE)) AS e FROM (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 4 ELSE len(embedding) END AS n FROM {{embeddings}}))""")
def _(t):
    n = F.when(F.col("vec_id") % 2 == 0, 4).otherwise(F.size("embedding"))
    e = t("embeddings").select("vec_id", n.alias("n"), F.slice(F.col("embedding").cast("array<double>"), F.lit(1), n).alias("e"))
    b = e.select("vec_id", "n", X.polygon_to_box("e").alias("b"))
    return b.select("vec_id", "n", r6("b.xc").alias("xc"), r6("b.h").alias("h"))


@query("P20_clean_text", """SELECT conv_id, turn, trim(regexp_replace(name, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), chr(9) || ' ') AS text, CAST(NULL AS VARCHAR) AS error,
 CASE WHEN length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) > 120 THEN 'too long' END AS body_error FROM {submissions}""")
def _(t):
    s = t("submissions")
    name = X.clean_text("name", 200)
    body = X.clean_text("text", 120, normalise=False)[1]
    return s.select("conv_id", "turn", *name, body.alias("body_error"))


@query("P21_trusted_time", """SELECT conv_id, turn, CASE WHEN client_at = '2026-05-10 08:00:00' THEN '2026-05-10 08:00:00' ELSE '2026-05-10 20:00:00' END AS trusted_at,
 CASE WHEN client_at IS NULL THEN NULL WHEN client_at = '' THEN 'not usable text' WHEN client_at = 'yesterday' THEN 'unreadable' WHEN client_at = '2026-05-10 08:00:00' THEN NULL ELSE 'clock off by more than the tolerance' END AS reason FROM {submissions}""")
def _(t):
    s = t("submissions").withColumn("server_at", F.lit("2026-05-10 20:00:00").cast("timestamp"))
    out = s.select("conv_id", "turn", *X.trusted_time("client_at", "server_at"))
    return out.withColumn("trusted_at", F.date_format("trusted_at", "yyyy-MM-dd HH:mm:ss"))


@query("P22_finite_or_reject", """SELECT conv_id, turn, CASE WHEN turn % 5 = 2 THEN conv_id + 0.25::DOUBLE END AS number, CASE WHEN turn % 5 = 3 THEN 'not a number' WHEN turn % 5 = 4 THEN 'not finite' END AS error FROM {submissions}""")
def _(t):
    return t("submissions").select("conv_id", "turn", *X.finite_or_reject("lat"))


_SHOTS = """CASE WHEN turn % 4 = 0 THEN concat('data:image/jpeg;base64,', {b64}) WHEN turn % 4 = 1 THEN concat('data:image/png;base64,', {b64}) WHEN turn % 4 = 2 THEN 'data:image/jpeg;base64,' ELSE concat('data:image/jpeg;base64,', {b64}) END"""


@query("P23_valid_shots", """SELECT conv_id AS lot_id, count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE NOT ok) AS n_skipped, CAST(coalesce(sum(n_bytes) FILTER (WHERE ok), 0) AS BIGINT) AS total_bytes
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn % 4 IN (0, 3) AND octet_length(encode(text)) BETWEEN 1 AND 524288 AS ok, octet_length(encode(text)) AS n_bytes FROM {conversations}) WHERE k <= 12 GROUP BY conv_id""")
def _(t):
    shot = F.expr(_SHOTS.replace("{b64}", "base64(encode(text, 'UTF-8'))"))
    lots = (t("conversations").select("conv_id", "turn", F.struct(shot.alias("annotated"), F.col("role").alias("tray_id")).alias("s")).groupBy(F.col("conv_id").alias("lot_id"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]).alias("shots")))
    size = X.valid_shots(lots).groupBy("lot_id").agg(F.sum("n_bytes").alias("total_bytes"))
    return X.shot_counts(lots).join(size, "lot_id", "left").select("lot_id", "n_valid", F.col("n_skipped").cast("bigint"), F.coalesce("total_bytes", F.lit(0).cast("bigint")).alias("total_bytes"))


@query("P24_parse_manifest", """SELECT conv_id, turn, CASE WHEN conv_id % 5 IN (0, 4) THEN 0 ELSE 1 END AS n_rows, CASE WHEN conv_id % 5 IN (1, 2) THEN 'lot/' || conv_id END AS path,
 CASE WHEN conv_id % 5 IN (1, 2, 3) THEN CAST(length(text) AS BIGINT) END AS bytes, CASE WHEN conv_id % 5 IN (1, 2, 3) THEN role END AS tray_id FROM {conversations}""")
def _(t):
    # Unreadable text, a plain list, a list with a number in it, an object without a path, and an object that is in no list.
    fields = [F.col("turn").cast("int").alias("look_index"), F.col("role").alias("tray_id"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("bigint").alias("bytes")]
    whole = F.to_json(F.struct(*fields, F.concat(F.lit("lot/"), F.col("conv_id").cast("string")).alias("path")))
    kind = F.col("conv_id") % 5
    text = (F.when(kind == 0, "not json").when(kind == 1, F.concat(F.lit("["), whole, F.lit("]"))).when(kind == 2, F.concat(F.lit(" [1, "), whole, F.lit(", null]")))
            .when(kind == 3, F.concat(F.lit("["), F.to_json(F.struct(*fields)), F.lit("]"))).otherwise(whole))
    m = t("conversations").select("conv_id", "turn", X.parse_manifest(text).alias("m"))
    first = F.get("m", F.lit(0))
    return m.select("conv_id", "turn", F.size("m").alias("n_rows"), first["path"].alias("path"), first["bytes"].alias("bytes"), first["tray_id"].alias("tray_id"))


@query("P25_bulb_snapshot", "SELECT id, lot_id, look_index, class AS cls, confidence, diameter_mm, size_grade, decision, disputed FROM {o_obs}")
def _(t):
    b = K.classified(t("observations")).drop("cls").withColumnRenamed("class", "cls")
    return X.bulb_snapshot(b)


@query("P30_certifiable", """SELECT id, CASE scale_source WHEN 'homography' THEN 1.0::DOUBLE WHEN 'single_marker' THEN 0.7::DOUBLE ELSE 0.25::DOUBLE END AS scale_confidence, calibrated AND scale_source <> 'mat_edge' AS certifiable FROM {ledger_base}""")
def _(t):
    return t("ledger_base").select("id", *M.certifiable())


@query("P29_fails_grade_a", "SELECT capture_id, pos, coalesce(blackening_share,0) > 0.05 OR coalesce(spots_share,0) > 0.1 OR coalesce(sunburn_share,0) > 0.02 OR coalesce(peeled_share,0) > 0.1 OR coalesce(rot_share,0) > 0.01 OR coalesce(sprouting_share,0) > 0.01 AS fails FROM {raw_items}")
def _(t):
    return t("raw_items").select(*ITEM_KEY, M.fails_grade_a().alias("fails"))


_POOL_COLS = ["n", *[f"n_{c}" for c in M.CLASS_NAMES], *[f"g_{g}" for g in M.GRADES], "n_referred", "n_looks", "n_trays"]


@query("A15_pool_looks", f"""SELECT p.lot_id, {', '.join('p.' + c for c in _POOL_COLS)}, {S6('p.grade_a_pct')} AS grade_a_pct, {S6(_wp('p.g_A', 'p.n', 'lo'))} AS grade_a_lo, {S6(_wp('p.g_A', 'p.n', 'hi'))} AS grade_a_hi,
 {S6('w.defect_pct')} AS defect_pct, CAST(w.worst_k AS BIGINT) AS worst_k, w.worst_n FROM {{o_pool}} p JOIN {{o_worst}} w ON w.lot_id = p.lot_id""")
def _(t):
    p = K.pool_looks(K.classified(t("observations")))
    return p.select("lot_id", *_POOL_COLS, *[r6(c).alias(c) for c in ("grade_a_pct", "grade_a_lo", "grade_a_hi", "defect_pct")], "worst_k", "worst_n")


@query("A16_defect_interval", f"SELECT lot_id, worst_k, worst_n, {S6('least(100, (' + _wp('worst_k', 'worst_n', 'lo') + ')/0.8)')} AS defect_lo, {S6('least(100, (' + _wp('worst_k', 'worst_n', 'hi') + ')/0.8)')} AS defect_hi FROM {{o_worst}}")
def _(t):
    d = K.defect_interval(K.pool_looks(K.classified(t("observations")), 0.8, 0.8))
    return d.select("lot_id", "worst_k", "worst_n", r6("defect_lo").alias("defect_lo"), r6("defect_hi").alias("defect_hi"))


@query("A17_grade_a_interval", f"""SELECT lot_id, n AS n_observations, CAST(floor(n/d) AS BIGINT) AS n_effective, d AS design_effect, CASE WHEN d = 1 THEN 'wilson-independent' ELSE 'wilson-clustered-two-look' END AS method,
 {S6(_wp('g_A/d', 'n/d', 'lo'))} AS grade_a_lo, {S6(_wp('g_A/d', 'n/d', 'hi'))} AS grade_a_hi FROM (SELECT *, 1 + (n_looks - 1)*0.7::DOUBLE AS d FROM {{o_pool}})""")
def _(t):
    g = K.grade_a_interval(K.pool_looks(K.classified(t("observations"))), 0.7)
    return g.select("lot_id", "n_observations", "n_effective", "design_effect", "method", r6("grade_a_lo").alias("grade_a_lo"), r6("grade_a_hi").alias("grade_a_hi"))


@query("A18_pooled_defect_interval", f"""SELECT q.lot_id, {S6('100.0*k/n')} AS pooled_pct, {S6(_wp('k/(n/ne)', 'n/(n/ne)', 'lo'))} AS pooled_lo, {S6(_wp('k/(n/ne)', 'n/(n/ne)', 'hi'))} AS pooled_hi, CAST(floor(ne) AS BIGINT) AS n_effective,
 {S6('n/ne')} AS design_effect, trays, {S6('w.defect_pct - 100.0*k/n')} AS gap_points FROM (SELECT lot_id, sum(n) AS n, sum(k) AS k, sum(n/m) AS ne, count(*) AS trays FROM
 (SELECT lot_id, coalesce(tray_id, '_') AS tr, count(*) AS n, count(*) FILTER (WHERE class <> 'sound') AS k, count(DISTINCT look_index) AS m FROM {{o_obs}} GROUP BY ALL) GROUP BY lot_id) q JOIN {{o_worst}} w ON w.lot_id = q.lot_id""")
def _(t):
    items = K.classified(t("observations"))
    d = K.pooled_defect_interval(items, K.pool_looks(items))
    return d.select("lot_id", *[r6(c).alias(c) for c in ("pooled_pct", "pooled_lo", "pooled_hi")], "n_effective", r6("design_effect").alias("design_effect"), "trays", r6("gap_points").alias("gap_points"))


@query("A19_sample_sufficiency", f"""SELECT lot_id, n AS n_observations, {S4('(' + _wp('floor(p*n+0.5)/d', 'n/d', 'hi') + ' - ' + _wp('floor(p*n+0.5)/d', 'n/d', 'lo') + ')/2')} AS half_width, CAST(rd AS BIGINT) AS n_required_distinct, CAST(ceil(rd*d) AS BIGINT) AS n_required_observations,
 CAST(d AS DOUBLE) AS design_effect, CAST(greatest(1, floor(n/d)) AS BIGINT) AS n_effective, CAST(greatest(0, ceil(rd*d) - n) AS BIGINT) AS extra_needed, CASE WHEN ceil(rd*d) <= n THEN 'SUFFICIENT' ELSE 'MORE_DATA' END AS verdict
FROM (SELECT *, ceil(3.8416*p*(1-p)/(0.03*0.03)) AS rd FROM (SELECT *, grade_a_pct/100 AS p, n_looks::DOUBLE AS d FROM {{o_pool}}))""")
def _(t):
    return K.sample_sufficiency(K.pool_looks(K.classified(t("observations"))), 3.0)


# ---- disputes and prices ----------------------------------------------------------------------------------
shared("o_pairs", """SELECT lag(id) OVER (PARTITION BY lot_ref ORDER BY id) AS a_id, id AS b_id FROM {ledger_base}""")
shared("o_compare", """SELECT *, CASE WHEN ovl THEN 'AGREE' WHEN abs(z) > 1.959963984540054 AND gap >= 10 THEN 'DISPUTE' ELSE 'REVIEW' END AS verdict FROM (
 SELECT *, CASE WHEN se > 0 THEN (a_k/a_n - b_k/b_n)/se ELSE 0 END AS z FROM (SELECT *, sqrt(((a_k+b_k)/(a_n+b_n))*(1-(a_k+b_k)/(a_n+b_n))*(1.0/a_n+1.0/b_n)) AS se FROM (
 SELECT p.a_id, p.b_id, x.grade_a_pct AS a_pct, x.ci_low AS a_lo, x.ci_high AS a_hi, x.n_bulbs AS a_n, floor(x.grade_a_pct*x.n_bulbs/100+0.5) AS a_k,
  y.grade_a_pct AS b_pct, y.ci_low AS b_lo, y.ci_high AS b_hi, y.n_bulbs AS b_n, floor(y.grade_a_pct*y.n_bulbs/100+0.5) AS b_k, abs(x.grade_a_pct - y.grade_a_pct) AS gap,
  greatest(x.ci_low, y.ci_low) <= least(x.ci_high, y.ci_high) AS ovl FROM {o_pairs} p JOIN {ledger_base} x ON x.id = p.a_id JOIN {ledger_base} y ON y.id = p.b_id)))""")


def _pairs(t):
    g = t("ledger_base").select("id", "lot_ref", F.col("grade_a_pct").alias("pct"), F.col("ci_low").alias("lo"), F.col("ci_high").alias("hi"), F.col("n_bulbs").alias("n"))
    return D.requested_pairs(D.successive_gradings(g), g.drop("lot_ref"))


@query("J15_paired_gradings", "SELECT a_id, b_id, a_pct, b_pct, a_n, b_n FROM {o_compare}")
def _(t):
    return _pairs(t).select("a_id", "b_id", "a_pct", "b_pct", "a_n", "b_n")


@query("A20_two_proportion_z", f"SELECT a_id, b_id, {S6('z')} AS z FROM {{o_compare}}")
def _(t):
    return D.compare_gradings(_pairs(t)).select("a_id", "b_id", r6("z").alias("z"))


@query("A20_two_sided_p", f"""SELECT a_id, b_id, {S6('z')} AS z, {S6("greatest(0, 1 - 2*least(abs(z), 8.0)/3000*list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i % 1000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5*pow(least(abs(z), 8.0)*i/1000.0, 2))/sqrt(2*pi()))))")} AS p FROM {{o_compare}}""")
def _(t):
    return D.compare_gradings(_pairs(t)).select("a_id", "b_id", r6("z").alias("z"), r6(D.two_sided_p("z")).alias("p"))


@query("A21_compare_gradings", f"""SELECT a_id, b_id, verdict, {S6('gap')} AS gap, ovl AS overlap, {S6('''CASE WHEN verdict <> 'DISPUTE' THEN
 (a_pct/greatest(1e-9,pow(a_hi-a_lo,2)) + b_pct/greatest(1e-9,pow(b_hi-b_lo,2)))/(1/greatest(1e-9,pow(a_hi-a_lo,2)) + 1/greatest(1e-9,pow(b_hi-b_lo,2))) END''')} AS combined_pct FROM {{o_compare}}""")
def _(t):
    return D.compare_gradings(_pairs(t)).select("a_id", "b_id", "verdict", r6("gap").alias("gap"), "overlap", r6("combined_pct").alias("combined_pct"))


shared("o_price", f"""SELECT lot_id, n, a, c AS central, CASE WHEN a < 100 THEN lo*24 + (c - a*24)*(100-lo)/(100-a) ELSE lo*24 END AS p1, CASE WHEN a < 100 THEN hi*24 + (c - a*24)*(100-hi)/(100-a) ELSE hi*24 END AS p2
 FROM (SELECT lot_id, n, 100.0*g_A/n AS a, (2400.0*g_A + 1800*g_B + 1200*g_C + 800*g_UNDERSIZED + 1000*g_UNKNOWN)/n AS c, {_wp('g_A', 'n', 'lo')} AS lo, {_wp('g_A', 'n', 'hi')} AS hi FROM {{o_pool}})""")


@query("A22_price_band", f"SELECT lot_id, {S4('central')} AS central, {S4('least(p1,p2)')} AS band_low, {S4('greatest(p1,p2)')} AS band_high, 800.0::DOUBLE AS floor_price, 2400.0::DOUBLE AS ceiling_price FROM {{o_price}}")
def _(t):
    b = D.price_band(D.grade_mix(K.pool_looks(K.classified(t("observations")))), t("rates"))
    return b.select("lot_id", *[r4(c).alias(c) for c in ("central", "band_low", "band_high")], "floor_price", "ceiling_price")


@query("A23_price_exposure", f"SELECT l.lot_id, {S4('(g.grade_a_hi - g.grade_a_lo)/2*6*l.declared_kg/100')} AS exposure_to_b, {S4('(g.grade_a_hi - g.grade_a_lo)/2*12*l.declared_kg/100')} AS exposure_to_c FROM {{lots}} l JOIN (SELECT lot_id, {_wp('g_A', 'n', 'lo')} AS grade_a_lo, {_wp('g_A', 'n', 'hi')} AS grade_a_hi FROM {{o_pool}}) g ON g.lot_id = l.lot_id")
def _(t):
    p = K.pool_looks(K.classified(t("observations"))).select("lot_id", ((F.col("grade_a_hi") - F.col("grade_a_lo")) / 2).alias("points"))
    j = p.join(t("lots").select("lot_id", (F.col("declared_kg") / 100.0).alias("quintals")), "lot_id")
    e = D.price_exposure(j, "quintals", "points")
    return e.select("lot_id", r4("exposure_to_b").alias("exposure_to_b"), r4("exposure_to_c").alias("exposure_to_c"))
