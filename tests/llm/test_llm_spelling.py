import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lotlens.llm import catalog, spelling
from lotlens.llm.common import code_points, flat_text

SCHEMA = "doc_id long, text string, word string, n string, key string"


def words_of(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    words = words_of(docs)
    found = {w: [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and near(w, v)] for w in words}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(found[w]), words[form[w]] if form[w] else None))
    return out


def invented(rng, n, length):
    return ["".join(rng.choice(list("abé"), int(k))) for k in rng.integers(4, length, n)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, size in (("GROUP", 5), ("PAIRS", 7), ("STEP", 40), ("LONG", 6)):
            monkeypatch.setattr(spelling, name, size)
    rng = np.random.default_rng(5)
    base = invented(rng, 250, 8)
    share = 1 / np.arange(1, 251)
    docs = [(i, " ".join(rng.choice(base, 120, p=share / share.sum()))) for i in range(60)]
    docs += [(None, "Straße straße STRASSE Élan élan Élan élan"), (None, None), (61, ""), (62, "12 34 --"), (63, "école écoles école écoles école écoles " * 3)]
    docs += [(64, "word×word÷word " * 4), (65, "日本語 のtextiles textileś textilés textiles " * 3), (66, "a" * 3000 + " " + "a" * 2999 + " ")] + docs[:9]
    docs += [(70 + i, "a" * 3000 + " " + "a" * 2999 + "b") for i in range(4)]
    df = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], SCHEMA)
    got = [tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute(docs)
    assert len(got) == len(want) and set(got) == want
    assert max(r[4] for r in got) > 3 and any(r[2] not in (r[0], r[1]) for r in got)
    assert spelling.variants(df.limit(0)).count() == 0


def test_checksums_of_runs_go_on_from_the_prefix():
    words = [b"a", b"straw", "éclair".encode(), b"x" * 200, b"yy"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    prefix = np.array([zlib.crc32(b"%d:" % i) for i in range(5)], np.uint32)
    got = spelling.run_checksums(data, ends - [len(w) for w in words], ends, prefix)
    assert got.tolist() == [zlib.crc32(b"%d:%s" % (i, w)) for i, w in enumerate(words)]


def test_every_edit_shares_a_signature_and_is_verified():
    rng = np.random.default_rng(6)
    for word in invented(rng, 300, 14):
        at = int(rng.integers(0, len(word)))
        for other in (word[:at] + word[at + 1:], word[:at] + "z" + word[at:], word[:at] + "q" + word[at + 1:], word[::-1]):
            points, starts = code_points(*flat_text(pa.array(sorted([word, other], key=len))))
            keys = [{(int(k[0]), min(s, 1)) for k, s in spelling.signatures(points[starts[i]:starts[i + 1]][None, :])} for i in (0, 1)]
            if other != word and near(word, other):
                assert keys[0] & keys[1], (word, other)
            if abs(len(other) - len(word)) <= 1:
                assert spelling.one_edit(points, starts, np.array([0]), np.array([1]))[0] == (other != word and near(word, other))


def test_the_query_counts_whole_texts(spark):
    docs = [(r.doc_id, r.text) for r in catalog.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = {r.word: r.n for r in catalog.op12_spelling_variants(spark, "/root/testdata/sf0.001").collect()}
    assert got == words_of(docs)
