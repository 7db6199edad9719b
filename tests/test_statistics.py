"""Textbook constants and brute-force comparisons."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lotlens.functions.ordered import linear_percentiles, nearest_rank, previous, row_index, running_sums
from lotlens.operators import agreement as A
from lotlens.operators import calibrate as C
from lotlens.operators import classify as Y
from lotlens.operators import dataset as D
from lotlens.operators import disputes as S
from lotlens.operators import joins as J

# The published 10 x 5 table with kappa 0.210.
FLEISS = [(0, 0, 0, 0, 14), (0, 2, 6, 4, 2), (0, 0, 3, 5, 6), (0, 3, 9, 2, 0), (2, 2, 8, 1, 1), (7, 7, 0, 0, 0), (3, 2, 6, 3, 0), (2, 5, 3, 2, 2), (6, 5, 2, 1, 0), (0, 2, 2, 3, 7)]


def test_fleiss(spark):
    rows = [(i, str(j)) for i, row in enumerate(FLEISS) for j, c in enumerate(row) for _ in range(c)]
    assert A.fleiss_kappa(spark.createDataFrame(rows, "item int, grade string")).first().kappa == pytest.approx(0.210, abs=0.001)


def test_cohen(spark):
    rows = [("Y", "Y")] * 20 + [("Y", "N")] * 5 + [("N", "Y")] * 10 + [("N", "N")] * 15
    r = A.cohen_kappa(spark.createDataFrame(rows, "a string, b string")).first()
    assert (r.agreement, r.kappa) == (pytest.approx(0.7), pytest.approx(0.4))
    assert A.cohen_kappa(spark.createDataFrame([("Y", "Y")] * 3, "a string, b string")).first().kappa == 1.0


def test_bland_altman_and_icc(spark):
    r = A.bland_altman(spark.createDataFrame([(float(m), 10.0) for m in (11, 12, 13, 14)], "m double, r double"), "m", "r").first()
    assert r.bias == 2.5 and r.mae == 2.5 and r.loa_hi > 2.5
    tight = [("a", 1.0), ("a", 1.01), ("a", 0.99), ("b", 5.0), ("b", 5.01), ("b", 4.99), ("c", 9.0), ("c", 9.01), ("c", 8.99)]
    loose = [("a", 1.0), ("a", 5.0), ("a", 9.0), ("b", 1.0), ("b", 5.0), ("b", 9.0), ("c", 1.0), ("c", 5.0), ("c", 9.0)]
    icc = lambda rows: A.icc1(spark.createDataFrame(rows, "grp string, v double")).first().icc
    assert icc(tight) > 0.99 and icc(loose) < 0.1


def test_majority_tie(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "A"), (2, "B")], "item int, grade string")
    assert {r.item: r.majority for r in A.majority(df).collect()} == {1: "?", 2: "A"}


def test_weight_fit_recovers_power_law(spark):
    rows = [(float(d), 0.0005 * d**2.9) for d in range(30, 80, 5)]
    m = A.fit_weight_model(spark.createDataFrame(rows, "d double, g double"), "d", "g").first()
    assert m.b == pytest.approx(2.9) and m.a == pytest.approx(0.0005) and m.residual_sd == pytest.approx(0, abs=1e-6)


def test_order_helpers_match_python(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 2), i, rng.randint(0, 30), rng.randint(1, 5)) for i in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "k int, t long, x int, v int").repartition(7)
    got = {r.t: (r.s, r.n, r.p) for r in previous(row_index(running_sums(df, "t", {"s": "v"}, ["k"]), "t", ["k"], "n"), "t", {"p": "x"}, ["k"]).collect()}
    for k in range(3):
        total, before = 0, None
        for n, (_, t, x, v) in enumerate(sorted(r for r in rows if r[0] == k), start=1):
            total += v
            assert got[t] == (total, n, before)
            before = x
    xs = sorted(r[2] for r in rows)
    q = nearest_rank(df, "x", {"a": 0.5, "b": 0.95, "c": 1.0}).first()
    assert (q.a, q.b, q.c) == (xs[200], xs[380], xs[-1])
    import numpy as np
    assert linear_percentiles(df, "x", {"p": 0.37}).first().p == pytest.approx(np.percentile(xs, 37))


def test_auc_against_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 10) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "label int, score double")
    assert Y.auc(df).first().auc == pytest.approx(want)
    best, at = -9, None
    for t in sorted({s for _, s in rows}):
        j = sum(s >= t for s in pos) / len(pos) + sum(s < t for s in neg) / len(neg) - 1
        if j > best + 1e-12:
            best, at = j, t
    assert Y.youden_threshold(df, None).first().threshold == at


def test_calibration(spark):
    rows = [(0.9, 1)] * 60 + [(0.9, 0)] * 40 + [(0.5, 1)] * 5 + [(0.5, 0)] * 5
    df = spark.createDataFrame(rows, "conf double, correct int")
    e = C.calibration_error(C.reliability_bins(df)).first()
    assert e.ece == pytest.approx(100 / 110 * 0.3) and e.mce == pytest.approx(0.3)
    fit = C.fit_temperature(df).first()
    assert fit.temperature > 2 and fit.bce_after < fit.bce_before and fit.improved
    assert C.fit_temperature(spark.createDataFrame([(0.5, 1), (0.5, 0)], "conf double, correct int")).first().temperature == 1.0
    assert C.recommend_threshold(df, 0.95, 30).first().threshold is None
    assert C.recommend_threshold(df, 0.6, 30).first().threshold == 0.9


def test_two_proportion(spark):
    r = spark.createDataFrame([(80, 100, 50, 100), (0, 0, 1, 2), (3, 3, 4, 4)], "ka int, na int, kb int, nb int").select(S.two_proportion_z("ka", "na", "kb", "nb").alias("z")).withColumn("p", S.two_sided_p("z")).collect()
    assert r[0].z == pytest.approx(4.4475, abs=1e-3) and r[0].p < 1e-4
    assert (r[1].z, r[1].p) == (0.0, 1.0) and r[2].z == 0.0
    assert S.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(12)]
    hs = {b for b in base}
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << bit
            hs.add(x)
    rows = [(f"{h:016x}",) for h in hs] * 2
    want = {(f"{a:016x}", f"{b:016x}") for a, b in itertools.combinations(sorted(hs), 2) if bin(a ^ b).count("1") <= 5}
    df = spark.createDataFrame(rows, "hash string")
    for groups in (None, 8, 9, 10, 12):
        got = [(r.a, r.b) for r in D.near_duplicates(df, groups=groups).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_near_duplicates_under_one_prefix(spark):
    """Hashes that share their first three bytes meet on other bits."""
    rng = random.Random(12)
    hs = [0xABCDEF << 40 | rng.getrandbits(40) for _ in range(20_000)]
    hs += [hs[0] ^ 0b111, hs[1] ^ (1 << 39)]
    df = spark.createDataFrame([(f"{h:016x}",) for h in hs], "hash string")
    got = {(r.a, r.b) for r in D.near_duplicates(df).collect()}
    for a, b in ((hs[0], hs[-2]), (hs[1], hs[-1])):
        assert (f"{min(a, b):016x}", f"{max(a, b):016x}") in got


def test_greedy_match_equals_sequential(spark):
    rng = random.Random(2)
    gts, preds = [], []
    for img in range(6):
        for g in range(8):
            x, y = rng.random() * 0.4, rng.random() * 0.4
            gts.append((img, f"g{img}-{g}", rng.randint(0, 1), x, y, x + 0.3, y + 0.3))
        for p in range(10):
            g = gts[-1 - rng.randrange(8)]
            dx, dy = rng.random() * 0.1, rng.random() * 0.1
            preds.append((img, f"p{img}-{p}", rng.randint(0, 1), g[3] + dx, g[4] + dy, g[5] + dx, g[6] + dy, rng.random()))

    def iou(a, b):
        w, h = max(0, min(a[5], b[5]) - max(a[3], b[3])), max(0, min(a[6], b[6]) - max(a[4], b[4]))
        area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
        return w * h / (area(a) + area(b) - w * h)
    want, used = {}, set()
    for p in sorted(preds, key=lambda r: -r[7]):
        free = [g for g in gts if g[0] == p[0] and g[2] == p[2] and g[1] not in used]
        best = max(free, key=lambda g: iou(p, g), default=None)
        if best and iou(p, best) >= 0.5:
            used.add(best[1])
            want[p[1]] = best[1]
    pd_ = spark.createDataFrame(preds, "image_id int, pred_id string, cls int, x0 double, y0 double, x1 double, y1 double, conf double")
    gt = spark.createDataFrame(gts, "image_id int, gt_id string, cls int, x0 double, y0 double, x1 double, y1 double")
    got = {r.pred_id: r.gt_id for r in J.greedy_match(pd_, gt).where(F.col("correct") == 1).collect()}
    assert got == want and len(want) > 10


def test_sack_draws_are_distinct_and_seeded(spark):
    df = spark.createDataFrame([(1, "4821", "1177", 40), (2, "4821", "1178", 3)], "lot_id long, farmer_code string, officer_code string, sacks int").withColumn("purchase_date", F.lit("2026-09-24").cast("date"))
    a = D.draw_sacks(df, 7).collect()
    assert len({(r.lot_id, r.sack) for r in a}) == len(a) == 10 and all(1 <= r.sack <= 40 for r in a)
    assert a == D.draw_sacks(df, 7).collect()


def test_near_duplicate_keys_are_not_broadcast(spark):
    df = spark.createDataFrame([(f"{h:016x}",) for h in range(8)], "hash string")
    pairs = D.near_duplicates(df)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 28
