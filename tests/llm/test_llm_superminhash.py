import random
from collections import Counter

import numpy as np
import pytest
from test_llm_jaccard import brute, cases

from lotlens.llm import superminhash


def direct(elements):
    """SuperMinHash element by element, each with its own permutation."""
    least = [2**64 - 1] * superminhash.PLACES
    for e in elements:
        order = list(range(superminhash.PLACES))
        for j in range(superminhash.PLACES):
            rank, swap = superminhash._draw(np.array([e], np.uint64), j)
            order[j], order[int(swap[0])] = order[int(swap[0])], order[j]
            least[order[j]] = min(least[order[j]], (j << 56) | int(rank[0]))
    return least


def test_signatures_equal_the_definition():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 6, 40, 300)]
    for s, found in zip(sets, superminhash.signatures(sets), strict=True):
        assert [int(x) for x in found] == direct(s)
    assert superminhash.signatures([]).shape == (0, superminhash.PLACES)


def test_estimates_are_unbiased_and_vary_less_than_independent_hashes():
    rng = np.random.default_rng(2)
    found = []
    for _ in range(400):
        x = rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = superminhash.signatures([np.unique(x[:30]), np.unique(x[10:])])
        found.append((a == b).mean())
    assert np.mean(found) == pytest.approx(0.5, abs=0.01)
    assert np.var(found) < 0.7 * 0.25 / superminhash.PLACES  # small sets gain most


def test_bands_of_near_sets_meet():
    rng = np.random.default_rng(3)
    for n in (6, 20, 200):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        near = superminhash.signatures([a, a[:-max(1, round(0.15 * n) - 1)]])
        one, two = superminhash.band_keys(near)
        assert (one == two).any() and (near[0] == near[1]).sum() >= superminhash.least_alike(85)


def large_case():
    """A hub whose copies link through each other only, and a leader that links with none of its bucket."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(300)]
    texts = []
    for k in range(60):
        copy = list(base)
        for j in range(k % 9):
            copy[(37 * k + 61 * j) % 300] = word()
        texts.append(" ".join(copy))
    return [(1000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize(("width", "percent"), [(5, 85), (4, 80)])
def test_equals_all_pairs(spark, monkeypatch, small, width, percent):
    if small:
        for name, size in (("BLOCK", 3), ("BLOCK_SHINGLES", 900), ("SMALL", 20)):
            monkeypatch.setattr(superminhash, name, size)
    rows = cases() + large_case()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, row string")
    got = [tuple(r) for r in superminhash.groups(docs, width, percent).collect()]
    want = Counter()
    for (doc, n, component, _), count in brute(rows, width, percent).items():
        want[doc, n, component, doc == component] += count
    assert Counter(got) == want


def test_empty_and_extreme_inputs(spark):
    docs = spark.createDataFrame([(None, None), (None, ""), (5, "a b c d e f"), (None, "a b c d e f"), (4, " ".join(f"w{i % 70000}" for i in range(150_000)))], "doc_id long, text string")
    got = sorted(map(tuple, superminhash.groups(docs).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (None, 0, None, True), (5, 2, 5, True), (None, 2, 5, False), (4, 70000, 4, True)], key=str)
    assert superminhash.groups(docs.limit(0)).count() == 0
