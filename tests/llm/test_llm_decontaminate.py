import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lotlens.llm import decontaminate as D
from lotlens.llm.common import flat_text


def plain(t):
    return re.sub(r"[\W_]+", " ", (t or "").lower()).strip()


def edits(pattern, text):
    """Fewest edits between the pattern and any part of the text, by the full table."""
    letters, across = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, p in enumerate(pattern, 1):
        new = np.append(i, np.minimum(row[:-1] + (letters != ord(p)), row[1:] + 1))
        row = np.minimum.accumulate(new - across) + across
    return row.min()


def brute(text, items, window, stride, share, least):
    out = Counter()
    for item, t in items:
        t = plain(t)
        if len(t) < D.Q:
            continue
        spans = [(0, len(t))] if len(t) <= window else [(s, window) for s in {*range(0, len(t) - window, stride), len(t) - window}]
        budget = lambda m: min(int(share * m), (m - D.Q) // D.Q) if len(t) >= least else 0  # noqa: B023, E731
        found = [e for s, m in spans for e in [edits(t[s:s + m], plain(text))] if e <= budget(m)]
        if found:
            out[item, min(found)] += 1
    return out


def cases():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([9, 12, 30, 45, 60, 3])]
    items += [(20 + i, "common opening words of every question here: " + " ".join(word() for _ in range(12))) for i in range(70)]
    texts = [None, "", "...", " ".join(word() for _ in range(150))]
    texts += ["a seven77 and a Short one. " + texts[3], "so without, a NAME it was lost lost " + "lost " * 40 + "tiny-word here"]
    for _ in range(14):
        _, t = rng.choice(items)
        chars = list(t)
        for _ in range(rng.choice([0, 0, 2, 6, 9, 12, 20])):
            p = rng.randrange(len(chars))
            chars[p] = rng.choice(["", "x", chars[p] + "q"])
        a = rng.choice([0, 0, 20])
        texts.append(" ".join(word() for _ in range(rng.randint(0, 20))) + " " + "".join(chars)[a:].upper() + "!! " + " ".join(word() for _ in range(5)))
    return items, texts


@pytest.mark.parametrize("block_bytes", [1 << 23, 2000])
def test_equals_brute_force(spark, block_bytes):
    items, texts = cases()
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items += [(None, "lost " * 30), (None, "without a name"), (90, "tiny word here"), (91, "Short-one!"), (92, "seven77"), (97, "")]
    bench = spark.createDataFrame([*items, (99, items[0][1]), (None, items[1][1]), (98, None)], "item_id long, text string")
    got = D.contamination(docs, bench, "found", window=60, stride=12, share=0.1, least=30, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    hits = 0
    for r in got:
        want = brute(r.text, items, 60, 12, 0.1, 30)
        assert Counter((x.item_id, x.edits) for x in r.found) == want
        hits += bool(want)
    assert 4 < hits < len(rows)


def test_empty_tables(spark):
    items, texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination(docs.limit(0), bench, "found").count() == 0
    assert all(r.found == [] for r in D.contamination(docs, bench.limit(0), "found").collect())


def test_every_verbatim_excerpt_of_a_window_is_found():
    rng = random.Random(12)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(70))
    index = D.Index.of([1], [item], 100, 20, 0.1, 40)
    normal = plain(item)
    for length in (100, 101, 110, 119, 128):
        for at in range(0, len(normal) - length):
            text = "zz yy " + normal[at:at + length] + " xx ww"
            codes, rows = D.normal(*flat_text(pa.array([text])))
            assert index.find(codes, rows), (length, at)
