"""Estimation, intervals, sequential tests."""

import numpy as np
import pandas as pd
import pytest

from lotlens.functions import beta
from lotlens.functions.beta import beta_cdf, beta_quantile
from lotlens.functions.numeric import half_up, wilson
from lotlens.operators import lots as L
from lotlens.operators.sequences import sequential_sprt
from lotlens.sources import packs as P
from pyspark.sql import functions as F

TRAY = "lot_id long, pack_id string, tray int, n long, w long, c_a long, c_u long, c_r long, c_f long, w_a long, w_u long, w_r long, w_f long, n_looks long"


def trays(spark, rows, lot=1, pack="in-psf-2026-pre-a"):
    """rows: (bad, n) per tray; bad items are REJECT, the rest Grade A."""
    return spark.createDataFrame([(lot, pack, i + 1, n, n * 10, n - b, 0, b, 0, (n - b) * 10, 0, b * 10, 0, 1) for i, (b, n) in enumerate(rows)], TRAY)


def test_beta_known_values():
    assert beta_cdf(np.array(0.5), np.array(2.0), np.array(2.0)) == pytest.approx(0.5)
    assert beta_cdf(np.array(0.3), np.array(1.0), np.array(1.0)) == pytest.approx(0.3)
    assert beta_cdf(np.array(0.25), np.array(0.5), np.array(0.5)) == pytest.approx(1 / 3)
    assert beta_quantile(np.array(0.975), np.array(5.5), np.array(15.5)) == pytest.approx(0.46, abs=0.02)
    q = beta_quantile(np.array([0.025, 0.5, 0.975]), np.array(3.0), np.array(7.0))
    assert np.allclose(beta_cdf(q, np.array(3.0), np.array(7.0)), [0.025, 0.5, 0.975])


def test_half_up_rounds_towards_plus_infinity(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (-0.4,)], "x double").select(half_up("x").alias("y")).collect()
    assert [r.y for r in got] == [-2, 3, 0]


def test_wilson_edges(spark):
    lo, hi = wilson("k", "n")
    r = [tuple(x) for x in spark.createDataFrame([(0, 0), (0, 35), (35, 35), (10, 40)], "k int, n int").select(lo, hi).collect()]
    assert r[0] == (0.0, 1.0) and r[1][0] == 0.0 and 0.05 < r[1][1] < 0.11 and r[2][1] == 1.0
    assert r[3][0] < 0.25 < r[3][1]


def test_sprt_decisions(spark):
    pack = [P.pack_by_id("in-psf-2026-pre-a")]
    for rows, want in (([(0, 40), (1, 40)], "ACCEPT_LOT"), ([(20, 40), (18, 40)], "REJECT_LOT"), ([(7, 40)], "SAMPLE_MORE")):
        r = L.sprt(L.lot_totals(trays(spark, rows), pack).withColumn("deff_a", F.lit(1.0)), pack).first()
        assert r.sprt_decision == want
        assert (r.trays_more > 0) == (want == "SAMPLE_MORE")


def test_shares_sum_and_intervals_bracket(spark):
    pack = [P.pack_by_id("in-psf-2026-pre-a")]
    t = trays(spark, [(3, 40), (8, 45), (5, 38), (1, 41)])
    shares = L.lot_shares(t, pack)
    got = {(r.basis, r.bucket): r for r in L.lot_intervals(shares, L.cluster_bootstrap(t, pack, 500)).collect()}
    for basis in ("count", "weight"):
        assert sum(got[(basis, b)].est for b in P.BUCKETS) == pytest.approx(100, abs=0.02)
    r = got[("count", "REJECT")]
    assert r.method == "cluster-bootstrap" and r.ci_lo <= r.est <= r.ci_hi
    assert 0 < r.ci_lo and r.ci_hi < 25


def test_row_and_joined_bootstrap_agree(spark):
    pack = [P.pack_by_id("in-psf-2026-pre-a")]
    t = trays(spark, [(i % 7, 40 + i) for i in range(12)])
    key = lambda r: (r.basis, r.bucket)
    a = sorted(L.cluster_bootstrap(t, pack, 100).collect(), key=key)
    b = sorted(L.cluster_bootstrap(t, pack, 100, row_trays=5).collect(), key=key)
    assert [v for r in a for v in (r.lo, r.hi)] == pytest.approx([v for r in b for v in (r.lo, r.hi)])


def test_counts_of_draws_are_multinomial():
    m, size, b = 23, 4, 4000
    counts = np.concatenate([L.tray_draws("seed", b, m, k, size) for k in range(6)], axis=1)
    assert counts.shape == (b, m) and (counts.sum(1) == m).all() and (counts >= 0).all()
    total = counts.sum(0)
    assert ((total - b) ** 2 / b).sum() < 48.3  # chi-square, 22 degrees of freedom, 0.1 %
    assert counts.var(0) == pytest.approx(np.full(m, 1 - 1 / m), abs=0.12)
    pairs = np.cov(counts.T)[~np.eye(m, dtype=bool)]
    assert abs(pairs.mean() + 1 / m) < 0.005 and np.abs(pairs + 1 / m).max() < 0.1
    blocks = np.stack([L.block_draws("seed", b, m, k, size) for k in range(6)], axis=1)
    assert (blocks.sum(1) == m).all() and blocks.mean(0) == pytest.approx([4, 4, 4, 4, 4, 3], abs=0.15)
    assert (L.tray_draws("seed", 100, m, 2, size) == counts[:100, 8:12]).all() or L.block_draws("seed", 100, m, 2, size).tolist() == blocks[:100, 2].tolist()


def test_counted_bootstrap_agrees_with_the_joined_one(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_TRAYS", 16)
    pack = [P.pack_by_id("in-psf-2026-pre-a")]
    t = trays(spark, [(i % 7, 40 + i % 5) for i in range(90)])
    key = lambda r: (r.basis, r.bucket)
    a = sorted(L.cluster_bootstrap(t, pack, 800).collect(), key=key)
    b = sorted(L.cluster_bootstrap(t, pack, 800, counted_trays=64).collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and a != b
    assert [v for r in a for v in (r.lo, r.hi)] == pytest.approx([v for r in b for v in (r.lo, r.hi)], abs=0.01)


def test_wilson_under_three_trays_and_deff(spark):
    pack = [P.pack_by_id("in-psf-2026-pre-a")]
    t = trays(spark, [(4, 40), (12, 40)])
    s = L.lot_shares(t, pack)
    r = {(x.basis, x.bucket): x for x in L.lot_intervals(s, L.cluster_bootstrap(t, pack, 50)).collect()}[("count", "REJECT")]
    # two clusters of 40 with 4 and 12 of 16/80: (2/1)*((4-8)^2+(12-8)^2)/80^2 over 0.2*0.8/80
    assert r.deff == pytest.approx(5.0) and r.method == "wilson-deff" and r.ci_lo < 20 < r.ci_hi


def test_jeffreys_edges(spark):
    pack = [P.pack_by_id("in-psf-2026-pre-a")]
    r = {(x.basis, x.bucket): x for x in L.with_jeffreys(L.lot_shares(trays(spark, [(0, 40), (0, 40)]), pack)).collect()}
    assert r[("count", "REJECT")].bayes_lo == 0.0 and r[("count", "GRADE_A")].bayes_hi == 100.0
    assert 1.0 < r[("count", "REJECT")].bayes_hi < 5.0


def test_sequential_decision_stops(spark):
    pack = P.pack_by_id("in-psf-2026-pre-a")
    rows = [(1, i, b, 40) for i, b in enumerate([7, 7, 20, 0, 0])] + [(2, 1, 7, 40)]
    got = {r.lot_id: r for r in sequential_sprt(spark.createDataFrame(rows, "lot_id long, tray int, bad long, n long"), pack).collect()}
    assert got[1].decision == "REJECT_LOT" and got[1].decided_at == 3
    assert got[2].decision == "SAMPLE_MORE" and got[2].decided_at == 1


def test_joined_bootstrap_makes_no_row_per_draw(spark, monkeypatch):
    monkeypatch.setattr(L, "ROUND_DRAWS", 100)  # several rounds of replicates
    pack = [P.pack_by_id("in-psf-2026-pre-a")]
    t = trays(spark, [(i % 7, 40 + i) for i in range(12)])
    key = lambda r: (r.basis, r.bucket)
    a = sorted(L.cluster_bootstrap(t, pack, 101).collect(), key=key)
    joined = L.cluster_bootstrap(t, pack, 101, row_trays=5)
    b = sorted(joined.collect(), key=key)
    assert [v for r in a for v in (r.lo, r.hi)] == pytest.approx([v for r in b for v in (r.lo, r.hi)])
    assert "explode(" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert (L.draws("seed", 5, 9, 3) == L.draws("seed", 8, 9)[3:]).all()


def test_lots_are_resampled_many_at_a_time(spark):
    """Parts that end within a lot give what a group per lot gives, and no lot is a call of its own."""
    rng, reps = np.random.default_rng(7), {"a": 300, "b": 200}
    rows = [(lot, pack, f"seed {lot}", *map(float, rng.integers(0, 9, len(L._BOOT)))) for lot in range(9) for pack in reps for _ in range(3 + lot % 3)]
    df = pd.DataFrame(rows, columns=["lot_id", "pack_id", "_seed", *L._BOOT])
    run, key = L._resampled(reps, 0.9), ["lot_id", "pack_id", "basis", "bucket"]
    got = pd.concat(run(iter([df.iloc[i:i + 7] for i in range(0, len(df), 7)])))
    assert not list(run(iter([df.iloc[:0]]))) and len(got) == 9 * 2 * len(L.SELECTORS)
    for (lot, pack), own in df.groupby(["lot_id", "pack_id"]):
        sums = dict(zip(L._BOOT, own[L._BOOT].to_numpy()[L.draws(f"seed {lot}", reps[pack], len(own))].sum(1).T, strict=True))
        lo, hi = L.quantile_positions(reps[pack], 0.9)
        for basis, bucket, x, n in L.SELECTORS:
            share = np.sort(np.divide(sums[x], sums[n], out=np.zeros(reps[pack]), where=sums[n] > 0))
            r = got.set_index(key).loc[(lot, pack, basis, bucket)]
            assert (r.lo, r.hi) == (share[lo], share[hi])
    found = L.cluster_bootstrap(trays(spark, [(1, 9), (2, 9), (3, 9)]), [P.pack_by_id("in-psf-2026-pre-a")], 50)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 2  # those of lots of many trays


def test_beta_series_of_few_successes_is_short(monkeypatch):
    """With k = 0 of a lot of items the series of the other tail is taken, some ten terms instead of thousands."""
    terms = []
    series = beta._series
    monkeypatch.setattr(beta, "_series", lambda p, q, z: terms.append(beta._terms(p, q, z).max()) or series(p, q, z))
    x = beta_cdf(np.array([0.00418, 1 - 0.00418]), np.array([0.5, 600.5]), np.array([600.5, 0.5]))
    assert max(terms) < 500 and x.sum() == pytest.approx(1, abs=1e-13) and x[0] == pytest.approx(0.975, abs=0.001)
    a, b = np.array([0.5, 600.5, 30.0]), np.array([600.5, 0.5, 50.0])
    assert np.allclose(beta_cdf(beta_quantile(np.array([0.975, 0.025, 0.975]), a, b), a, b), [0.975, 0.025, 0.975], atol=1e-12)


def test_headline_and_shares_read_the_intervals_once(spark):
    t = trays(spark, [(1, 9), (2, 9), (3, 9)])
    pack = [P.pack_by_id("in-psf-2026-pre-a")]
    i = L.lot_intervals(L.lot_shares(t, pack), L.cluster_bootstrap(t, pack, 50))
    wide = L.headline(i, L.lot_decision(L.sprt(L.lot_totals(t, pack), pack), pack), F.count("*").alias("shares"))
    r = wide.first()
    assert r.shares == len(L.SELECTORS) and r.grade_a == i.where("basis = 'weight' AND bucket = 'GRADE_A'").first().est
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
