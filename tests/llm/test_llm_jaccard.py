import random
import re
from collections import Counter

import numpy as np
import pytest

from lotlens.llm import jaccard


def brute(rows, width, percent):
    """All pairs, and components by search; rows of (doc_id, text)."""
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    sets = [grams(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in enumerate(sets)]
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[doc, len(sets[i]), min(ids) if ids else None, len(near[i])] += 1
    return out


def cases(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 9, 60, 200]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(shared + " " + " ".join(base[:20]))
        texts.append(" ".join(base).upper() + "\n")
    chain = [word() for _ in range(120)]
    for k in range(12):
        texts.append(" ".join(chain[4 * k:4 * k + 70]))
    texts += [None, "", "  \t", "one", "ONE", "a b c", "a b c", "a\x1cb c", "x " * 4000]
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[20])]


@pytest.mark.parametrize("weight", [jaccard.BLOCK_GRAMS, 900])
@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_equals_all_pairs(spark, monkeypatch, weight, width, percent):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", weight)
    monkeypatch.setattr(jaccard, "SMALL", 20)
    rows = cases()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    got = jaccard.join(docs, width, percent).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, width, percent)
    if weight == 900 and width == 4:
        assert jaccard.join(docs.limit(0)).count() == 0


def test_overlaps_in_strips():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200))).astype(np.uint64) for _ in range(40)]
    got = jaccard.overlaps(sets[:15], sets[10:], strip=32)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:15]]).all()


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 101)]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 100}
