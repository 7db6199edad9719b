import math

import numpy as np
import pytest

from lotlens.llm import neighbours


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, v in good:
        if q in queries:
            near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in good if i != q and len(x) == len(v))
            out[q] = near[:k]
    return out


def test_rotation_keeps_lengths_and_probes_start_at_the_own_bucket():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(50, 48))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for seed in range(3):
        assert np.linalg.norm(neighbours.rotated(unit, seed), axis=1) == pytest.approx(np.ones(50))
    dense = np.array([[1 - 2 * (bin(i & j).count("1") % 2) for j in range(8)] for i in range(8)]) / np.sqrt(8)
    assert neighbours.hadamard(np.eye(8)) == pytest.approx(dense)
    for hashes in (1, 2):
        own = neighbours.probes(unit, 1, hashes, 1)[:, 0]
        assert all(o in p for o, p in zip(own, neighbours.probes(unit, 1, hashes, 5)))


@pytest.mark.parametrize("small", [False, True])
def test_exact_when_all_buckets_are_probed(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(neighbours, "ROWS", 7)
        monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)] + [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]
    rows += [(300, None), (301, [0.0] * 6), (302, [float("nan")] + [1.0] * 5), (303, [None] + [1.0] * 5), (None, [1.0] * 6), (304, []), (305, [1.0, 2.0]), (306, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 10 = 0 or vec_id > 299"), k=5, tables=2, count=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id, r.rank))
    want = brute(rows, {i for i, _ in rows if i is not None and (i % 10 == 0 or i > 299)}, 5)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [i for _, i, _ in got[q]] == [i for _, i in near] and [s for s, _, _ in got[q]] == pytest.approx([s for s, _ in near])
        assert [r for _, _, r in got[q]] == list(range(1, len(near) + 1))
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_with_the_query_parameters(spark):
    from lotlens.llm import catalog
    rows = [(r.vec_id, r.embedding) for r in catalog.table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    got = {(r.query_id, r.vec_id) for r in catalog.op10_cross_polytope(spark, "/root/testdata/sf0.1").collect()}
    assert sum((q, i) in got for q, near in want.items() for _, i in near) / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("size", [1, 4, 12, 25])
def test_small_tables_give_all_candidates_with_the_query_parameters(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(size)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [i for _, i in near] for q, near in brute(rows, {i for i, _ in rows}, 10).items() if near}
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items()}
    if size <= 11:
        assert got == want
