"""Queries over rater agreement, classifier scores, calibration, dataset checks and what-if sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.catalog.core import query, shared
from lotlens.catalog.measures import S4, S6, _wp, r4, r6
from lotlens.operators import agreement as A
from lotlens.operators import calibrate as C
from lotlens.operators import classify as Y
from lotlens.operators import dataset as D
from lotlens.operators import joins as J
from lotlens.operators import lots as L
from lotlens.operators import pooled as K
from lotlens.operators import whatif as W
from lotlens.functions.ordered import running_sums, value_ranks
from lotlens.plans import grade as G
from lotlens.sources import packs as P


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


# ---- agreement ---------------------------------------------------------------------------------------------
shared("o_full", "SELECT r.* FROM {ratings} r WHERE item IN (SELECT item FROM {ratings} GROUP BY item HAVING count(*) = 3) AND item IN (SELECT item FROM {model_grades})")


def _full(t):
    return t("ratings").join(J.rated_by_all(t("ratings"), t("model_grades"), 3), "item")


@query("E01_fleiss_kappa", f"""SELECT n_items, {S6('pb')} AS p_bar, {S6('pe')} AS p_e, {S6('(pb-pe)/(1-pe)')} AS kappa FROM (SELECT count(*) AS n_items, avg((sq-n)/(n*(n-1))) AS pb FROM (SELECT item, sum(c) AS n, sum(c*c) AS sq FROM
 (SELECT item, grade, count(*) AS c FROM {{o_full}} GROUP BY ALL) GROUP BY item)), (SELECT sum(pow(c/t, 2)) AS pe FROM (SELECT count(*) AS c FROM {{o_full}} GROUP BY grade), (SELECT count(*) AS t FROM {{o_full}}))""")
def _(t):
    return rounded(A.fleiss_kappa(_full(t)), "p_bar", "p_e", "kappa")


def _kappa_sql(src: str, by: str = "") -> str:
    g, j = (f"{by}, ", f"{by}") if by else ("", "")
    on = f"p.{by} = q.{by}" if by else "true"
    return f"""SELECT {('p.' + by + ', ') if by else ''}p.n, {S6('p.po')} AS agreement, {S6('CASE WHEN q.pe = 1 THEN 1 ELSE (p.po-q.pe)/(1-q.pe) END')} AS kappa FROM
 (SELECT {g}count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po FROM {src} {('GROUP BY ' + j) if by else ''}) p JOIN
 (SELECT {('x.' + by + ', ') if by else ''}sum(x.c*y.c)/any_value(pow(x.t,2)) AS pe FROM (SELECT {g}a, count(*) AS c, sum(count(*)) OVER ({('PARTITION BY ' + j) if by else ''}) AS t FROM {src} GROUP BY {g}a) x
  JOIN (SELECT {g}b, count(*) AS c FROM {src} GROUP BY {g}b) y ON x.a = y.b {('AND x.' + by + ' = y.' + by) if by else ''} {('GROUP BY x.' + by) if by else ''}) q ON {on}"""


shared("o_two", "SELECT x.grade AS a, y.grade AS b FROM {ratings} x JOIN {ratings} y ON x.item = y.item WHERE x.rater = 'r1' AND y.rater = 'r2'")


@query("E02_cohen_kappa", _kappa_sql("{o_two}"))
def _(t):
    r = t("ratings")
    p = r.where("rater = 'r1'").select("item", F.col("grade").alias("a")).join(r.where("rater = 'r2'").select("item", F.col("grade").alias("b")), "item")
    return rounded(A.cohen_kappa(p), "agreement", "kappa")


@query("E03_bland_altman", f"""SELECT tier, count(*) AS n, {S6('avg(method_mm-ref_mm)')} AS bias, {S6('stddev_samp(method_mm-ref_mm)')} AS sd, {S6('avg(abs(method_mm-ref_mm))')} AS mae,
 {S6('avg(method_mm-ref_mm) - 1.96*stddev_samp(method_mm-ref_mm)')} AS loa_lo, {S6('avg(method_mm-ref_mm) + 1.96*stddev_samp(method_mm-ref_mm)')} AS loa_hi FROM {{size_pairs}} GROUP BY tier""")
def _(t):
    return rounded(A.bland_altman(t("size_pairs"), "method_mm", "ref_mm", ["tier"]), "bias", "sd", "mae", "loa_lo", "loa_hi")


_MAJ = "CASE WHEN count(*) FILTER (WHERE c = m) > 1 THEN '?' ELSE max(CASE WHEN c = m THEN grade END) END"
shared("o_majority", f"SELECT item, {_MAJ} AS majority FROM (SELECT *, max(c) OVER (PARTITION BY item) AS m FROM (SELECT item, grade, count(*) AS c FROM {{o_full}} GROUP BY ALL)) GROUP BY item")


@query("E05_majority", "SELECT item, majority FROM {o_majority}")
def _(t):
    return A.majority(_full(t))


shared("o_rest", f"SELECT rater, own AS a, {_MAJ} AS b FROM (SELECT *, max(c) OVER (PARTITION BY item, rater) AS m FROM (SELECT x.item, x.rater, x.grade AS own, y.grade, count(*) AS c FROM {{o_full}} x JOIN {{o_full}} y ON x.item = y.item AND x.rater <> y.rater GROUP BY ALL)) GROUP BY item, rater, own")


@query("E06_rater_vs_rest", _kappa_sql("{o_rest}", "rater"))
def _(t):
    return rounded(A.rater_vs_rest(_full(t)), "agreement", "kappa")


shared("o_model", "SELECT m.grade AS a, j.majority AS b FROM {model_grades} m JOIN {o_majority} j ON j.item = m.item")


@query("E06_model_vs_humans", f"SELECT k.*, {S6('h')} AS mean_human_agreement, k.agreement >= h AS at_least_average FROM (" + _kappa_sql("{o_model}") + ") k, (SELECT avg(po) AS h FROM (SELECT rater, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po FROM {o_rest} GROUP BY rater))")
def _(t):
    return rounded(A.model_vs_humans(_full(t), t("model_grades")), "agreement", "kappa", "mean_human_agreement")


@query("E07_fit_weight_model", f"""SELECT tier, {S6('exp(la)*1e4')} AS a_e4, {S6('b')} AS b, {S6('sqrt(greatest(0, syy - b*sxy)/(n-2))')} AS residual_sd, n FROM (SELECT tier, regr_slope(y,x) AS b, regr_intercept(y,x) AS la, regr_syy(y,x) AS syy, regr_sxy(y,x) AS sxy, count(*) AS n FROM (SELECT tier, ln(method_mm) AS x, ln(weight_g) AS y FROM {{size_pairs}}) GROUP BY tier)""")
def _(t):
    m = A.fit_weight_model(t("size_pairs"), "method_mm", "weight_g", ["tier"])
    return m.select("tier", r6(F.col("a") * 1e4).alias("a_e4"), r6("b").alias("b"), r6("residual_sd").alias("residual_sd"), "n")


@query("E15_count_errors", f"""SELECT qty, count(*) AS n, {S6('avg(abs(e))')} AS mae, {S6('avg(CAST(e = 0 AS INT))')} AS exact, {S6('avg(CAST(abs(e) <= 1 AS INT))')} AS within1, {S6('avg(e)')} AS mean_error FROM (SELECT qty, n_items % 9 - id % 5 AS e FROM {{photos}}) GROUP BY qty""")
def _(t):
    p = t("photos").selectExpr("qty", "id % 5 AS truth", "n_items % 9 AS predicted")
    return rounded(A.count_errors(p, "truth", "predicted", ["qty"]), "mae", "exact", "within1", "mean_error")


@query("E16_interval_coverage", f"""SELECT count(*) AS n_lots, {S6('avg(abs(i.est - tr))')} AS mae, {S6('avg(CAST(tr BETWEEN i.ci_lo AND i.ci_hi AS INT))')} AS coverage FROM (SELECT *, CASE WHEN lot_id % 3 = 0 THEN est + 9.5 ELSE est - 0.4 END AS tr FROM {{o_intervals}} WHERE pack_id = 'in-psf-2026-07-30-a-only' AND basis = 'weight' AND bucket = 'GRADE_A') i""")
def _(t):
    pack = [P.default_pack()]
    i, _d = G.lot_results(G.graded_trays(t("bulbs"), pack), pack)
    a = i.where("basis = 'weight' AND bucket = 'GRADE_A'").withColumn("tr", F.when(F.col("lot_id") % 3 == 0, F.col("est") + 9.5).otherwise(F.col("est") - 0.4))
    return rounded(A.interval_coverage(a, "tr", "est", "ci_lo", "ci_hi"), "mae", "coverage")


# ---- classifiers -------------------------------------------------------------------------------------------
def _auc_sql(src: str, by: str, score: str = "score") -> str:
    return f"""SELECT {by}, sum(label) AS n_pos, sum(1-label) AS n_neg, (sum(CASE WHEN label = 1 THEN rk END) - sum(label)*(sum(label)+1)/2.0)/(sum(label)*sum(1-label)) AS auc
 FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1)/2.0 AS rk FROM {src}) GROUP BY {by}"""


@query("A33_image_score", f"SELECT image_id, label, qty, max(score) AS score FROM {{crops}} GROUP BY image_id, label, qty")
def _(t):
    return Y.image_scores(t("crops")).select("image_id", "label", "qty", "score")


@query("E08_auc", f"SELECT split, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, {S6('auc')} AS auc FROM (" + _auc_sql("{photos}", "split") + ")")
def _(t):
    return rounded(Y.auc(t("photos"), ["split"]), "auc")


_CONF = f"""count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, {S6('count(*) FILTER (WHERE label = 1 AND score >= 0.5)/count(*) FILTER (WHERE label = 1)')} AS sensitivity,
 {S6('count(*) FILTER (WHERE label = 0 AND score < 0.5)/count(*) FILTER (WHERE label = 0)')} AS specificity, {S6('count(*) FILTER (WHERE (label = 1) = (score >= 0.5))/count(*)')} AS accuracy,
 {S6(_wp('count(*) FILTER (WHERE label = 1 AND score >= 0.5)', 'count(*) FILTER (WHERE label = 1)', 'lo') + '/100')} AS sens_lo"""


@query("E09_confusion_at", f"SELECT split, {_CONF} FROM {{photos}} GROUP BY split")
def _(t):
    c = Y.confusion_at(t("photos"), 0.5, ["split"])
    return rounded(c, "sensitivity", "specificity", "accuracy", "sens_lo").select("split", "n_pos", "n_neg", "sensitivity", "specificity", "accuracy", "sens_lo")


shared("o_slices", "SELECT 'all' AS slice, label, score FROM {photos} WHERE split = 'holdout' UNION ALL SELECT 'variety=' || variety, label, score FROM {photos} WHERE split = 'holdout' UNION ALL SELECT 'qty=' || qty, label, score FROM {photos} WHERE split = 'holdout'")


@query("E10_subgroup_metrics", f"SELECT c.*, {S6('a.auc')} AS auc FROM (SELECT slice, {_CONF} FROM {{o_slices}} GROUP BY slice) c JOIN (" + _auc_sql("{o_slices}", "slice") + ") a ON a.slice = c.slice")
def _(t):
    m = Y.subgroup_metrics(t("photos").where("split = 'holdout'"), 0.5)
    return rounded(m, "sensitivity", "specificity", "accuracy", "sens_lo", "auc").select("slice", "n_pos", "n_neg", "sensitivity", "specificity", "accuracy", "sens_lo", "auc")


shared("o_youden", """SELECT c.score, sum(CASE WHEN p.label = 1 AND p.score >= c.score THEN 1 ELSE 0 END)/sum(p.label) AS sens, sum(CASE WHEN p.label = 0 AND p.score < c.score THEN 1 ELSE 0 END)/sum(1-p.label) AS spec
 FROM (SELECT DISTINCT score FROM {photos} WHERE split = 'tune') c, {photos} p WHERE p.split = 'tune' GROUP BY c.score""")


@query("E11_youden_threshold", f"SELECT arg_max(score, struct_pack(j := j, s := -score)) AS threshold, {S6('max(j)')} AS j FROM (SELECT score, floor(sens*1000+0.5)/1000 + floor(spec*1000+0.5)/1000 - 1 AS j FROM {{o_youden}})")
def _(t):
    return rounded(Y.youden_threshold(t("photos").where("split = 'tune'"), 3), "j")


@query("E11_youden_unrounded", f"SELECT arg_max(score, struct_pack(j := j, s := -score)) AS threshold, {S6('max(j)')} AS j FROM (SELECT score, sens + spec - 1 AS j FROM {{o_youden}})")
def _(t):
    return rounded(Y.youden_threshold(t("photos").where("split = 'tune'"), None), "j")


_GATES = [0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
_GRID = f"""SELECT gate, {S6('tpr')} AS tpr, {S6('fpr')} AS fpr, {S6('hf')} AS healthy_fail, {S6('tpr-fpr-hf')} AS objective FROM (SELECT gate, count(*) FILTER (WHERE label=1 AND worst > 0.03)/count(*) FILTER (WHERE label=1) AS tpr, count(*) FILTER (WHERE label=0 AND worst > 0.03)/count(*) FILTER (WHERE label=0) AS fpr,
 sum(f) FILTER (WHERE label=0)/sum(n) FILTER (WHERE label=0) AS hf FROM (SELECT gate, capture_id, label, max(CASE WHEN p1 >= gate THEN rot_share + blackening_share ELSE 0 END) AS worst, count(*) AS n, count(*) FILTER (WHERE p1 >= gate AND fails) AS f
 FROM (SELECT *, CAST(lot_id % 2 AS INT) AS label, coalesce(blackening_share,0) > 0.05 OR coalesce(spots_share,0) > 0.1 OR coalesce(sunburn_share,0) > 0.02 OR coalesce(peeled_share,0) > 0.1 OR coalesce(rot_share,0) > 0.01 OR coalesce(sprouting_share,0) > 0.01 AS fails FROM {{raw_items}}),
 (SELECT unnest({_GATES}::DOUBLE[]) AS gate) GROUP BY ALL) GROUP BY gate)"""


@query("E12_threshold_grid", _GRID)
def _(t):
    from lotlens.operators.measure import fails_grade_a
    items = t("raw_items").select(F.col("capture_id").alias("photo"), (F.col("lot_id") % 2).cast("int").alias("label"), F.col("p1").alias("p"), F.col("rot_share").alias("rot"), F.col("blackening_share").alias("blackening"), fails_grade_a().alias("fails"))
    return rounded(Y.threshold_grid(items, _GATES), "tpr", "fpr", "healthy_fail", "objective")


@query("E13_high_threshold", "SELECT greatest(0.5, list_sort(list(score))[CAST(floor(0.95*(count(*)-1)) AS INT) + 1]) AS high_threshold FROM {crops} WHERE split = 'tune' AND qty = 'multiple' AND label = 0")
def _(t):
    return Y.high_threshold(t("crops").where("split = 'tune'"))


shared("o_same", "SELECT 1 AS k, label, score, score_new FROM {photos} WHERE split = 'holdout' AND id % 5 <> 0")


@query("E14_ship_rule", f"SELECT CAST(a.n_pos + a.n_neg AS BIGINT) AS n_items, {S6('a.auc')} AS auc_old, {S6('b.auc')} AS auc_new, (SELECT count(*) FROM {{photos}} WHERE split = 'holdout' AND id % 5 = 0) AS old_only, b.auc > a.auc AS ship FROM (" + _auc_sql("{o_same}", "k") + ") a, (" + _auc_sql("{o_same}", "k", "score_new") + ") b")
def _(t):
    p = t("photos").where("split = 'holdout'")
    new = p.where("id % 5 <> 0").select("id", "label", F.col("score_new").alias("score"))
    return rounded(Y.ship_rule(p.select("id", "label", "score"), new), "auc_old", "auc_new")


@query("E26_latency_percentiles", f"SELECT qty, list_sort(list(ms))[least(count(*), CAST(floor(0.5*count(*)) AS BIGINT) + 1)] AS p50, list_sort(list(ms))[least(count(*), CAST(floor(0.95*count(*)) AS BIGINT) + 1)] AS p95, {S6('avg(ms)')} AS mean_ms, max(ms) AS max_ms FROM {{photos}} GROUP BY qty")
def _(t):
    return rounded(Y.latency(t("photos"), "ms", ["qty"]), "mean_ms")


@query("W04_average_rank", "SELECT score, any_value(rk) AS avg_rank, count(*) AS n FROM (SELECT score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2 AS rk FROM {photos}) GROUP BY score")
def _(t):
    v = value_ranks(t("photos"), "score")
    return v.select("score", (F.col("cum") - F.col("cnt") + 1 + (F.col("cnt") - 1) / 2).alias("avg_rank"), F.col("cnt").alias("n"))


@query("W03_running_totals", "SELECT conf, CAST(sum(n) OVER (ORDER BY conf DESC) AS BIGINT) AS support, CAST(sum(k) OVER (ORDER BY conf DESC) AS BIGINT) AS hits FROM (SELECT conf, count(*) AS n, sum(correct) AS k FROM {conf_pairs} GROUP BY conf)")
def _(t):
    c = t("conf_pairs").groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k"))
    return running_sums(c, "conf", {"support": "n", "hits": "k"}, descending=True).select("conf", "support", "hits")


# ---- calibration -------------------------------------------------------------------------------------------
_BINS = "SELECT b AS bin, count(conf) AS n, avg(conf) AS mc, avg(correct) AS acc FROM range(10) r(b) LEFT JOIN {conf_pairs} c ON least(floor(conf*10), 9) = b GROUP BY b"


@query("E17_reliability_bins", f"SELECT CAST(bin AS INT) AS bin, bin/10 AS lo, (bin+1)/10 AS hi, n, {S6('mc')} AS mean_conf, {S6('acc')} AS accuracy FROM ({_BINS})")
def _(t):
    return rounded(C.reliability_bins(t("conf_pairs")), "mean_conf", "accuracy")


@query("E18_calibration_error", f"SELECT {S6('sum(n*abs(mc-acc))/sum(n)')} AS ece, {S6('max(abs(mc-acc))')} AS mce, CAST(sum(n) AS BIGINT) AS n FROM ({_BINS}) WHERE n > 0")
def _(t):
    return rounded(C.calibration_error(C.reliability_bins(t("conf_pairs"))), "ece", "mce")


@query("E19_recommend_threshold", f"SELECT conf AS threshold, {S6('h/s')} AS achieved, s AS support, t - s AS referred FROM (SELECT conf, CAST(sum(n) OVER (ORDER BY conf DESC) AS BIGINT) AS s, sum(k) OVER (ORDER BY conf DESC) AS h, CAST(sum(n) OVER () AS BIGINT) AS t FROM (SELECT conf, count(*) AS n, sum(correct) AS k FROM {{conf_pairs}} GROUP BY conf)) WHERE s >= 30 AND h/s >= 0.7 - 1e-12 ORDER BY conf LIMIT 1")
def _(t):
    return rounded(C.recommend_threshold(t("conf_pairs"), 0.7, 30), "achieved")


_LOGIT = "ln(greatest(1e-6, least(1-1e-6, conf))/(1-greatest(1e-6, least(1-1e-6, conf))))"


@query("E20_apply_temperature", f"SELECT conf, {S6(f'1/(1+exp(-({_LOGIT})/1.7))')} AS scaled, count(*) AS n FROM {{conf_pairs}} GROUP BY conf")
def _(t):
    return t("conf_pairs").groupBy("conf").agg(F.count(F.lit(1)).alias("n")).select("conf", r6(C.apply_temperature("conf", 1.7)).alias("scaled"), "n")


_TEMPS = ", ".join(repr(x) for x in C.temperature_grid())


@query("E21_temperature_grid", f"""SELECT {S6('tt')} AS temperature, {S6('avg(-(correct*ln(p) + (1-correct)*ln(1-p)))')} AS loss FROM (SELECT correct, tt, greatest(1e-6, least(1-1e-6, 1/(1+exp(-({_LOGIT})/tt)))) AS p FROM {{conf_pairs}}, (SELECT unnest([{_TEMPS}]::DOUBLE[]) AS tt)) GROUP BY tt""")
def _(t):
    return rounded(C.temperature_losses(t("conf_pairs")), "temperature", "loss")


@query("E21_fit_temperature")
def _(t):
    return rounded(C.fit_temperature(t("conf_pairs")), "temperature", "bce_before", "bce_after", "ece_before", "ece_after")


@query("E22_precision_recall", f"""SELECT called, tp, n_truth, {S6('tp/called')} AS precision, {S6('tp/n_truth')} AS recall, {S6('2.0*(tp/called)*(tp/n_truth)/(tp/called + tp/n_truth)')} AS f1 FROM (
 SELECT count(*) FILTER (WHERE conf >= 0.5) AS called, count(*) FILTER (WHERE conf >= 0.5 AND g.gt IS NOT NULL) AS tp, (SELECT count(*) FROM {{boxes}}) AS n_truth FROM {{detections}} d LEFT JOIN {{o_greedy}} g ON g.pred_id = d.pred_id)""")
def _(t):
    m = J.greedy_match(t("detections"), t("boxes"), 0.5)
    truth = t("boxes").agg(F.count(F.lit(1)).alias("n")).scalar()
    return rounded(C.precision_recall(m, truth, 0.5), "precision", "recall", "f1")


shared("o_err", """SELECT tray_id, true_a, true_d, a1, d1, CASE WHEN a2 IS NULL OR d2 IS NULL THEN 1 ELSE 2 END AS n_looks_used, CASE WHEN a2 IS NULL OR d2 IS NULL THEN a1 ELSE a2 END AS a2, CASE WHEN a2 IS NULL OR d2 IS NULL THEN d1 ELSE d2 END AS d2 FROM {tray_estimates}""")
shared("o_errlong", "SELECT tray_id, 'grade_a_1look' AS metric, a1 - true_a AS err FROM {o_err} UNION ALL SELECT tray_id, 'grade_a_2look', a2 - true_a FROM {o_err} UNION ALL SELECT tray_id, 'defect_1look', d1 - true_d FROM {o_err} UNION ALL SELECT tray_id, 'defect_2look', d2 - true_d FROM {o_err}")


@query("E23_per_tray_errors", f"SELECT tray_id, n_looks_used, {S6('a1 - true_a')} AS err_grade_a_1look, {S6('abs(a2 - true_a)')} AS abs_err_grade_a_2look, {S6('d2')} AS pred_defect_2look, {S6('abs(d1 - true_d)')} AS abs_err_defect_1look FROM {{o_err}}")
def _(t):
    e = C.per_tray_errors(t("tray_estimates"))
    return e.select("tray_id", "n_looks_used", *[r6(c).alias(c) for c in ("err_grade_a_1look", "abs_err_grade_a_2look", "pred_defect_2look", "abs_err_defect_1look")])


@query("E24_error_report", f"SELECT metric, count(*) AS n, {S6('avg(abs(err))')} AS mae, {S6('quantile_cont(abs(err), 0.95)')} AS p95, {S6('avg(err)')} AS bias FROM {{o_errlong}} GROUP BY metric")
def _(t):
    return rounded(C.error_report(C.per_tray_errors(t("tray_estimates"))), "mae", "p95", "bias")


@query("E25_error_histogram", "SELECT metric, CAST(least(floor(abs(err)/top*20), 19) AS INT) AS bin, count(*) AS n FROM {o_errlong}, (SELECT greatest(max(abs(err)), 1)*1.05 AS top FROM {o_errlong} WHERE metric LIKE 'grade%') WHERE metric LIKE 'grade%' GROUP BY 1, 2")
def _(t):
    return C.error_histogram(C.per_tray_errors(t("tray_estimates")))


@query("E27_refer_rate", f"SELECT lot_id, {S6('avg(CAST(confidence < 0.75 AS INT))')} AS refer_rate, count(*) AS n FROM {{observations}} GROUP BY lot_id")
def _(t):
    return rounded(C.refer_rate(t("observations"), 0.75, ["lot_id"]), "refer_rate")


@query("L02_worst_trays", f"SELECT tray_id, {S6('abs(a1-true_a)')} AS abs_err, n_looks_used FROM {{o_err}} ORDER BY abs(a1-true_a) DESC, tray_id LIMIT 5")
def _(t):
    w = C.worst_trays(C.per_tray_errors(t("tray_estimates")))
    return w.select("tray_id", r6("abs_err_grade_a_1look").alias("abs_err"), "n_looks_used")


@query("L03_top_reasons", "SELECT reason, n FROM (SELECT regexp_replace(code, '^(.*?)_[\\d.]+(PCT|MM)_', '\\1_x_') AS reason, count(*) AS n FROM (SELECT unnest(string_split(codes, '|')) AS code FROM {o_reasons} WHERE pack_id='in-psf-2026-06-relaxed-a' AND codes <> '') GROUP BY 1) ORDER BY n DESC, reason LIMIT 5")
def _(t):
    from lotlens.operators import rules as R
    return R.reason_census(R.adjudicate(t("bulbs"), [P.pack_by_id("in-psf-2026-06-relaxed-a")], ()), 5)


@query("L04_largest_item", "SELECT image_id, crop_id, area_px FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area_px DESC, crop_id) AS k FROM {crops} WHERE qty = 'single') WHERE k = 1")
def _(t):
    c = t("crops").where("qty = 'single'")
    best = c.groupBy("image_id").agg(F.min(F.struct(-F.col("area_px"), F.col("crop_id"), F.col("area_px"))).alias("b"))
    return best.select("image_id", "b.crop_id", "b.area_px")


# ---- datasets ----------------------------------------------------------------------------------------------
@query("D01_block_split", "SELECT o_orderkey AS id, CASE CAST(floor(o_orderkey/25) AS BIGINT) % 5 WHEN 0 THEN 'tune' WHEN 4 THEN 'holdout' ELSE 'train' END AS split FROM {orders}")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), D.block_split("o_orderkey").alias("split"))


@query("D02_exclude_viewed", "SELECT id FROM {photos} WHERE id NOT IN (SELECT doc_id FROM {labels})")
def _(t):
    return D.exclude_viewed(t("photos"), t("labels").select(F.col("doc_id").alias("id"))).select("id")


@query("D03_even_spread", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY variety, qty, split ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY variety, qty, split) AS n FROM {photos}), range(40) r(k) WHERE k < least(40, n) AND i = floor(k*n/least(40, n))")
def _(t):
    return D.even_spread(t("photos"), 40, ["variety", "qty", "split"]).select("id")


@query("D04_draw_sacks", """SELECT lot_id, draw, sack, list_extract(['top','middle','bottom'], CAST('0x' || substr(h, 1, 8) AS BIGINT) % 3 + 1) AS layer FROM (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY h, sack) AS draw FROM (
 SELECT lot_id, sack, sha256(sha256(concat_ws('|', lot_id, farmer_code, officer_code, purchase_date, sacks, 7)) || '|' || sack) AS h FROM {lots}, range(1, 100) r(sack) WHERE sack <= sacks)) WHERE draw <= 7""")
def _(t):
    d = D.draw_sacks(t("lots"), 7)
    return d.select("lot_id", F.col("draw").cast("bigint"), F.col("sack").cast("bigint"), "layer")


@query("D05_suggested_draws", "SELECT lot_id, CAST(greatest(3, least(sacks, ceil(sqrt(sacks)))) AS BIGINT) AS draws FROM {lots}")
def _(t):
    return t("lots").select("lot_id", D.suggested_draws("sacks").cast("bigint").alias("draws"))


@query("D06_stride_cap", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY variety, qty ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY variety, qty) AS n FROM {photos}) WHERE i % CAST(ceil(n/1000) AS BIGINT) = 0")
def _(t):
    return D.stride_cap(t("photos"), 1000, ["variety", "qty"]).select("id")


_CLS = "CASE cls WHEN 0 THEN 'sound' WHEN 1 THEN 'rotten' WHEN 2 THEN 'sprouted' WHEN 3 THEN 'black_smut' WHEN 4 THEN 'damaged_skin' WHEN 5 THEN 'doubles' ELSE 'UNKNOWN_' || CAST(cls AS VARCHAR) END"
_CAPS = {"rotten": 600, "sprouted": 400, "black_smut": 250, "sound": 500}


_KEEP = "(s.c1 < 600 AND o.h1 = 1 OR s.c2 < 400 AND o.h2 = 1 OR s.c3 < 250 AND o.h3 = 1)"


@query("D07_capped_balance", f"""SELECT image_id, n_defects FROM (WITH RECURSIVE i AS (SELECT image_id, max(CAST(cls = 0 AS INT)) AS h0, max(CAST(cls = 1 AS INT)) AS h1, max(CAST(cls = 2 AS INT)) AS h2, max(CAST(cls = 3 AS INT)) AS h3
  FROM {{boxes}} WHERE cls IN (0,1,2,3) GROUP BY image_id),
 o AS (SELECT *, CAST(h1 + h2 + h3 AS BIGINT) AS n_defects, row_number() OVER (ORDER BY h1 + h2 + h3 DESC, image_id) AS k FROM i WHERE h1 + h2 + h3 > 0),
 s AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS image_id, CAST(0 AS BIGINT) AS n_defects, false AS kept, 0 AS c0, 0 AS c1, 0 AS c2, 0 AS c3 UNION ALL
  SELECT o.k, o.image_id, o.n_defects, {_KEEP}, s.c0 + CASE WHEN {_KEEP} THEN o.h0 ELSE 0 END, s.c1 + CASE WHEN {_KEEP} THEN o.h1 ELSE 0 END, s.c2 + CASE WHEN {_KEEP} THEN o.h2 ELSE 0 END, s.c3 + CASE WHEN {_KEEP} THEN o.h3 ELSE 0 END
  FROM s JOIN o ON o.k = s.k + 1 WHERE s.c1 < 600 OR s.c2 < 400 OR s.c3 < 250)
 SELECT image_id, n_defects FROM s WHERE kept UNION ALL
 SELECT image_id, 0 FROM (SELECT image_id, row_number() OVER (ORDER BY image_id) AS r FROM i WHERE h1 + h2 + h3 = 0) WHERE r <= (SELECT greatest(0, 500 - max(c0)) FROM s))""")
def _(t):
    name = F.expr("CASE cls WHEN 0 THEN 'sound' WHEN 1 THEN 'rotten' WHEN 2 THEN 'sprouted' WHEN 3 THEN 'black_smut' END")
    return D.capped_balance(t("boxes").select("image_id", name.alias("class")), _CAPS)


@query("D08_group_cap_and_holdout", "SELECT id, CASE WHEN CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10 THEN 'holdout' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY label, variety ORDER BY id) AS k FROM {photos}) WHERE k <= 1500")
def _(t):
    return D.group_cap(t("photos"), 1500, ["label", "variety"]).select("id", D.hash_holdout("id", 0.1).alias("part"))


@query("D09_inverse_frequency_weights", "SELECT id, floor(1e9/count(*) OVER (PARTITION BY label, qty)+0.5)/1e9 AS weight FROM {photos}")
def _(t):
    p = t("photos").withColumn("cell", F.concat_ws("|", "label", "qty"))
    from lotlens.functions.numeric import round_half_up
    return D.inverse_frequency_weights(p, "cell").select("id", round_half_up("weight", 9).alias("weight"))


@query("D10_correction_labels", "SELECT row_number() OVER (ORDER BY correction_id) - 1 + 9000000 AS image_id, label, correction_id FROM (SELECT correction_id, any_value(CASE to_bucket WHEN 'REJECT' THEN 1 WHEN 'GRADE_A' THEN 0 WHEN 'URS' THEN 0 END) AS label FROM {corrections} GROUP BY correction_id) WHERE label IS NOT NULL")
def _(t):
    c = t("corrections").groupBy("correction_id").agg(F.max("to_bucket").alias("to_bucket"))
    return D.correction_labels(c).select("image_id", "label", "correction_id")


@query("D11_cross_split_leakage", "SELECT hash, count(DISTINCT split) AS n_splits, count(*) AS n_images FROM {images} GROUP BY hash HAVING count(DISTINCT split) > 1")
def _(t):
    return D.cross_split_leakage(t("images"))


@query("D12_class_balance", f"SELECT class, coalesce(split, 'all') AS split, n, {S6('100.0*n/tot')} AS share, split IS NULL AND n < 9000 AS under, class LIKE 'UNKNOWN_%' AS unknown FROM (SELECT {_CLS} AS class, split, count(*) AS n FROM {{boxes}} GROUP BY GROUPING SETS ((1, 2), (1))), (SELECT count(*) AS tot FROM {{boxes}})".replace("GROUPING SETS ((1, 2), (1))", "GROUPING SETS ((cls, split), (cls))"))
def _(t):
    return rounded(D.class_balance(t("boxes"), 9000), "share")


@query("D13_box_count_outliers", "SELECT image_id, count(*) AS n_boxes FROM {boxes} GROUP BY image_id HAVING count(*) < 5 OR count(*) > 60")
def _(t):
    return D.box_count_outliers(t("boxes"))


@query("D14_qa_verdict", """SELECT leaks, uc AS unknown_classes, ul AS unlabelled, leaks + uc + ul AS blockers, CASE WHEN leaks + uc + ul = 0 THEN 'safe to train' ELSE 'fix before training' END AS verdict FROM (SELECT count(*) AS leaks FROM (SELECT hash FROM {images} GROUP BY hash HAVING count(DISTINCT split) > 1)),
 (SELECT count(DISTINCT cls) AS uc FROM {boxes} WHERE cls >= 6), (SELECT count(*) AS ul FROM {images} WHERE image_id NOT IN (SELECT image_id FROM {boxes}))""")
def _(t):
    return D.qa_verdict(t("images"), t("boxes"))


@query("J17_near_duplicates", """SELECT a.hash AS a, b.hash AS b, bit_count(xor(CAST('0x' || substr(a.hash,1,8) AS BIGINT), CAST('0x' || substr(b.hash,1,8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr(a.hash,9,8) AS BIGINT), CAST('0x' || substr(b.hash,9,8) AS BIGINT))) AS distance
 FROM (SELECT DISTINCT hash FROM {picture_hashes}) a JOIN (SELECT DISTINCT hash FROM {picture_hashes}) b ON a.hash < b.hash WHERE bit_count(xor(CAST('0x' || substr(a.hash,1,8) AS BIGINT), CAST('0x' || substr(b.hash,1,8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr(a.hash,9,8) AS BIGINT), CAST('0x' || substr(b.hash,9,8) AS BIGINT))) <= 5""")
def _(t):
    return D.near_duplicates(t("picture_hashes"))


@query("P26_box_sanity", "SELECT split, CASE WHEN (x1-x0)*(y1-y0) < 0.001 THEN 'tiny' WHEN (x1-x0)*(y1-y0) > 0.03 THEN 'huge' ELSE 'ok' END AS state, count(*) AS n FROM {boxes} GROUP BY 1, 2")
def _(t):
    from lotlens.operators.measure import box_sanity
    return t("boxes").groupBy("split", box_sanity(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), 0.001, 0.03).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("S14_provenance", f"SELECT coalesce(split, 'all') AS split, coalesce(class, 'all') AS class, count(*) AS n, CAST(sum(nb) AS BIGINT) AS n_bulbs FROM (SELECT split, CASE WHEN label = 1 THEN 'rotten' ELSE 'sound' END AS class, n_items AS nb FROM {{photos}}) GROUP BY CUBE (split, class)")
def _(t):
    from lotlens.sources.files import provenance_manifest, provenance_summary
    p = t("photos").select(F.col("id").alias("image_id"), "split", F.when(F.col("label") == 1, "rotten").otherwise("sound").alias("class"), F.lit("field").alias("source"), "variety", F.col("n_items").alias("n_bulbs"))
    return provenance_summary(provenance_manifest(p))


# ---- what-if -----------------------------------------------------------------------------------------------
_SEV = [0.0, 0.1, 0.3, 0.6]
_DEF = W.DEFECT_CLASSES
shared("o_sim", f"""SELECT lot_id, sev AS severity, count(*) AS n, count(*) FILTER (WHERE u < sev) AS n_flagged, count(*) FILTER (WHERE u < sev AND class = 'sound') AS n_degraded, count(*) FILTER (WHERE class <> 'sound' OR u < sev) AS n_defects,
 {', '.join(f"CAST(count(*) FILTER (WHERE class='sound' AND u >= sev AND size_grade='{g}') AS DOUBLE) AS s_{g}" for g in ('A', 'B', 'C', 'UNDERSIZED', 'UNKNOWN'))},
 {', '.join(f"count(*) FILTER (WHERE class='sound' AND u < sev AND v*tot >= {' + '.join(['0'] + ['d_' + x for x in _DEF[:i]])} AND v*tot < {' + '.join('d_' + x for x in _DEF[:i + 1])}) AS to_{c}" for i, c in enumerate(_DEF))}
FROM (SELECT o.*, CAST('0x' || substr(md5(concat_ws('|', 'what-if', o.lot_id, o.id)), 1, 8) AS BIGINT)/4294967296 AS u, CAST('0x' || substr(md5(concat_ws('|', 'what-if', o.lot_id, o.id)), 9, 8) AS BIGINT)/4294967296 AS v, m.* EXCLUDE (lot_id)
 FROM {{o_obs}} o JOIN (SELECT lot_id, {', '.join(f"count(*) FILTER (WHERE class='{c}') AS d_{c}" for c in _DEF)}, count(*) FILTER (WHERE class <> 'sound') AS tot FROM {{o_obs}} GROUP BY lot_id) m ON m.lot_id = o.lot_id), (SELECT unnest({_SEV}::DOUBLE[]) AS sev) GROUP BY lot_id, sev""")
_SIMCOLS = ["n", "n_flagged", "n_degraded", "n_defects", "s_A", "s_B", "s_C", *[f"to_{c}" for c in _DEF]]


def _sim(t):
    return W.what_if_bulbs(K.classified(t("observations")), _SEV)


def _looks(t):
    return t("observations").groupBy("lot_id").agg(F.count_distinct("look_index").alias("n_looks"))


@query("X01_what_if_bulbs", f"SELECT s.lot_id, severity, {', '.join('s.' + c for c in _SIMCOLS)}, {S6('100*s_A/s.n')} AS saleable_pct, {S6(_wp('s_A/p.n_looks', 's.n/p.n_looks', 'lo'))} AS saleable_lo, {S6(_wp('s_A/p.n_looks', 's.n/p.n_looks', 'hi'))} AS saleable_hi FROM {{o_sim}} s JOIN {{o_pool}} p ON p.lot_id = s.lot_id")
def _(t):
    s = W.saleable(_sim(t), _looks(t))
    return s.select("lot_id", "severity", *_SIMCOLS, r6("saleable_pct").alias("saleable_pct"), r6("saleable_lo").alias("saleable_lo"), r6("saleable_hi").alias("saleable_hi"))


shared("o_simagg", f"""SELECT lot_id, severity, n, k AS n_degraded, n - n_sound + k AS n_defects, {', '.join(f"g_{g}*((n_sound-k)/n) AS s_{g}" for g in ('A', 'B', 'C', 'UNDERSIZED', 'UNKNOWN'))}
 FROM (SELECT *, CAST(floor(severity*n_sound) AS BIGINT) AS k FROM {{o_pool}}, (SELECT unnest({_SEV}::DOUBLE[]) AS severity))""")


@query("X02_what_if_aggregate", f"SELECT lot_id, severity, n, n_degraded, n_defects, {S6('s_A')} AS s_a, {S6('s_B')} AS s_b FROM {{o_simagg}}")
def _(t):
    s = W.what_if_aggregate(K.pool_looks(K.classified(t("observations"))), _SEV)
    return s.select("lot_id", "severity", "n", "n_degraded", "n_defects", r6("s_A").alias("s_a"), r6("s_B").alias("s_b"))


def _pay_sql(src: str) -> str:
    price = "(s_A*2400 + s_B*1800 + s_C*1200 + s_UNDERSIZED*800 + s_UNKNOWN*1000)/(s_A+s_B+s_C+s_UNDERSIZED+s_UNKNOWN)"
    base = f"SELECT *, {price} AS price, {price}*(n-n_defects)/n AS vi, 100.0*s_A/n AS sp, 100.0*n_defects/n AS dp FROM {src}"
    return f"""SELECT x.lot_id, x.severity, {S4('x.price')} AS price, {S4('x.vi')} AS value_index, {S4('x.sp-b.sp')} AS saleable_points, {S4('x.dp-b.dp')} AS defect_points, {S4('x.price-b.price')} AS payout_change, {S4('100*(x.price-b.price)/b.price')} AS payout_pct,
 {S4('x.vi-b.vi')} AS value_change, {S4('100*(x.vi-b.vi)/b.vi')} AS value_pct FROM ({base}) x JOIN ({base}) b ON b.lot_id = x.lot_id AND b.severity = 0"""


def _pay(sim, t):
    p = W.payout(W.saleable(sim, _looks(t)))
    return p.select("lot_id", "severity", *[r4(c).alias(c) for c in ("price", "value_index", "saleable_points", "defect_points", "payout_change", "payout_pct", "value_change", "value_pct")])


@query("X03_payout_delta", _pay_sql("{o_sim}"))
def _(t):
    return _pay(_sim(t), t)


@query("X03_payout_delta_aggregate", _pay_sql("{o_simagg}"))
def _(t):
    return _pay(W.what_if_aggregate(K.pool_looks(K.classified(t("observations"))), _SEV), t)
