import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lotlens.llm import lattice

SCORES = {b" ": -3.0, b" a": -2.0, b"a": -3.0, b"b": -2.5, b"ab": -1.5, b" ab": -2.2, b"ba": -4.0, b"bab": -5.0, "é".encode(): -4.0}


def brute(word, logs, longest):
    """Sum over all segmentations, by plain recursion."""
    if not word:
        return 1.0
    return sum(math.exp(logs[word[:k]]) * brute(word[k:], logs, longest) for k in range(1, min(longest, len(word)) + 1) if word[:k] in logs)


def test_forward_equals_all_segmentations():
    pieces = lattice.Pieces.of(SCORES, -1.0)
    least = min(SCORES.values())
    logs = {bytes([b]): least for b in range(256)} | SCORES
    words = [b"a", b"ab", b"abab", b"babba", "éa".encode(), b"zz", b"aabbabab", b""]
    got = lattice.log_scores(pieces, words)
    for w, x in zip(words, got):
        assert x == pytest.approx(math.log(brute(b" " + w, logs, pieces.longest)) if w else -1.0)
    assert np.isfinite(lattice.log_scores(pieces, [b"ab" * 20_000])).all()


def test_expected_uses_by_difference():
    """Uses are the derivative of the log marginal by the piece's log probability."""
    pieces = lattice.Pieces.of(SCORES, -1.0)
    words, weights = [b"abab", b"baba"], np.array([2.0, 1.0])
    uses = lattice.expected(pieces, words, weights)
    for place in range(len(pieces.logs)):
        if uses[place] > 0:
            moved = lattice.Pieces(pieces.table, pieces.logs.copy(), -1.0, pieces.longest)
            moved.logs[place] += 1e-6
            slope = ((lattice.log_scores(moved, words) - lattice.log_scores(pieces, words)) * weights).sum() / 1e-6
            assert uses[place] == pytest.approx(slope, rel=1e-3)


@pytest.mark.parametrize("share", [lattice.SHARE, 0.05])
def test_rows_and_base(spark, share, monkeypatch):
    monkeypatch.setattr(lattice, "SHARE", share)
    texts = [None, "", "A ab  abab\tÉ", "ab ab new\x1cword", "x" * 3000 + " ab", "A ab  abab\tÉ"]
    rows = [(i % 40 if i else None, texts[i % 6], i % 7 == 2, "extra") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, score string")
    got = lattice.score(docs, SCORES).collect()
    assert len(got) == len(rows)
    count = Counter(w for _, t, h, _ in rows if not h for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, t, h, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]
        want[d, h, len(words), sum(count[w] > 0 for w in words), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lattice.score(docs.limit(0), SCORES).count() == 0


def test_probabilities_of_short_words_sum_below_one(spark):
    docs = spark.createDataFrame([(i, "ab ba abab b a", False) for i in range(30)], "doc_id long, text string, held_out boolean")
    probe = [(100 + i, w, True) for i, w in enumerate(["ab", "ba", "abab", "b", "a", "bb", "aa", "bab"])]
    got = lattice.score(docs.union(spark.createDataFrame(probe, docs.schema)), SCORES).where("held_out").collect()
    end = lattice.score(docs.union(spark.createDataFrame([(1, "", True)], docs.schema)), SCORES).where("held_out").first().score
    assert 0.5 < sum(10 ** (r.score - end) for r in got) <= 1
    assert zlib.crc32(b"1") >= 0


def test_matches_extend_the_hashes_of_shorter_pieces(monkeypatch):
    """Every piece that begins anywhere is found, and no byte is hashed again for each length."""
    pieces = lattice.Pieces.of(SCORES, -1.0)
    names = [*({bytes([b]): 0 for b in range(256)} | SCORES)]
    places = {names[i]: at for at, i in enumerate(lattice.SortedHashes(lattice.piece_hashes(*lattice.bytes_of(names)).view(np.int64)).order)}
    words = [b" ababba", b" bab\xc3\xa9a", b" zz\xffaba"]
    monkeypatch.setattr(lattice, "piece_hashes", None)
    found = pieces.matches(np.frombuffer(b"".join(words), np.uint8).reshape(3, 7))
    assert len(found) == pieces.longest
    for length, at in enumerate(found, 1):
        assert at.tolist() == [[places.get(w[i:i + length], -1) for i in range(7 - length + 1)] for w in words]


def test_word_counts_and_rows_of_mixed_batches():
    batch = pa.RecordBatch.from_pydict({"text": ["a b a", None, "b é", "c"], "teaches": [True, True, False, False]})
    got = Counter()
    for out in lattice._word_counts(iter([batch, batch])):
        for r in out.to_pylist():
            got[r["word"], "c"] += r["c"]
            got[r["word"], "used"] += r["used"]
    assert +got == Counter({("a", "c"): 4, ("a", "used"): 4, ("b", "c"): 2, ("b", "used"): 4, ("é", "used"): 2, ("c", "used"): 2, ("", "c"): 4, ("", "used"): 8})
    rows = lattice._rows([(1, 7, True, 3, 1, -1.0, -2.0), (2, None, False, 1, 1, 0.0, 0.0), (3, 9, False, 2, 0, 0.0, 0.0)], [b"x", b"y", "é".encode()], [2, 1, 5], [2, 0, 1])
    assert [(r["row"], r["doc_id"], r["word"], r["k"], r["n_tokens"]) for r in rows.to_pylist()] == [
        (1, 7, None, None, 3), (2, None, None, None, 1), (3, 9, None, None, 2), (1, None, "x", 2, None), (1, None, "y", 1, None), (3, None, "é", 5, None)]
