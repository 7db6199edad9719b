import math

import duckdb
import numpy as np
import pytest

from lotlens.llm import catalog, hardneg

SCHEMA = "vec_id long, label int, embedding array<double>, rank int, positives string"


def clip(v):
    return max(-2**63, min(2**63 - 1, v))


def brute(rows, anchors, positives=5, negatives=3):
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v and all(map(math.isfinite, v)):
            good[i] = min(good.get(i, (label, v)), (label, v))
    whole = {i: (label, [int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x) for x in v]) for i, (label, v) in good.items()}
    out = set()
    for a in anchors & set(whole):
        label, v = whole[a]
        score = {i: clip(sum(x * y for x, y in zip(v, w))) for i, (_, w) in whole.items() if i != a and len(w) == len(v)}
        near = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in near if whole[i][0] == label][:positives]:
            fits = [i for i in near if whole[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out |= {(a, p, rank, n, score[p], score[n]) for rank, n in enumerate(fits, 1)}
    return out


def test_packed_products_are_exact_at_every_width():
    rng = np.random.default_rng(3)
    for low, high, d in [(-256, 256, 64), (0, 2, 3), (-5, 5, 1), (10**6, 10**6 + 3, 8), (-2**20, 2**20, 20), (-2**31, 2**31, 5), (-2**60, 2**60, 4)]:
        a, r = rng.integers(low, high, (7, d)), rng.integers(low, high, (300, d))
        want = a.astype(object) @ r.astype(object).T
        got = hardneg.scores(a, r)
        assert [int(x) for x in got.ravel()] == [clip(int(x)) for x in want.ravel()], (low, high)
    assert hardneg.scores(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def test_best_breaks_ties_by_place():
    score = np.array([[5, 7, 7, 1, 7, 9], [0, 0, 0, 0, 0, 0]])
    allowed = np.array([[True, True, True, True, True, False], [False, False, True, True, False, False]])
    for s in (score, score * 2**58):
        assert [x.tolist() for x in hardneg.best(s, allowed, 3)] == [[1, 2, 4], [2, 3]]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, size in (("ROWS", 9), ("ANCHORS", 4), ("STRIP", 3)):
            monkeypatch.setattr(hardneg, name, size)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 0, rng.normal(size=6).round(1).tolist()) for i in range(160)]
    rows += [(200 + i, 1, [0.5, 0.5, 0.0, 0.0, 0.25, 1.0]) for i in range(40)] + rows[:5]  # a common vector, repeated rows
    rows += [(300, 1, None), (301, None, [1.0] * 6), (302, 1, [None] + [1.0] * 5), (303, 1, [float("inf")] + [1.0] * 5), (None, 1, [1.0] * 6), (304, 1, [float("nan")] * 6)]
    rows += [(400, 1, [1.0, 2.0]), (401, 1, [2.0, 1.0]), (402, 2, [1.5, 1.0]), (410, 1, []), (411, 1, []), (412, 2, [])]
    rows += [(500, 1, [1e300, 1.0, 2.0]), (510, 1, [1e300, 1.0, 2.0]), (520, 2, [6e299, 1.0, 2.0]), (530, 1, [3e4, 1.0, 2.0]), (140, 2, [9.0] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = [tuple(r) for r in hardneg.mine(df, df.where("vec_id % 10 = 0 or vec_id > 299")).collect()]
    want = brute(rows, {r[0] for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] > 299)})
    assert len(got) == len(set(got)) and set(got) == want
    assert hardneg.mine(df.limit(0), df.limit(0)).count() == 0


def test_the_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = db.execute(catalog.OP13_SQL).fetchall()
    got = catalog.op13_hard_negatives(spark, folder)
    assert got.columns == [c[0] for c in db.description]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
