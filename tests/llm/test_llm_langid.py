import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotlens.llm import common, langid, toxicity

EN = ["the cat sat on the mat", "a dog and the other dog ran", "this is the house that they built", "The end of the road"] * 3
DE = ["der hund und die katze schlafen", "das ist ein schönes haus", "wir gehen über die straße", "Ende der Straße"] * 3


def tokens(text):
    out, gap = [], True
    for c in text.lower():
        if c.isalpha():
            out.append(c)
            gap = False
        elif out or not gap:
            if not gap:
                out.append(" ")
            gap = True
    return out


def brute(train, text, order=langid.ORDER, alphabet=None):
    """Textbook interpolated Kneser-Ney over letters, straight from the definition."""
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        s = [" "] * (order - 1) + tokens(t)
        counts[order].update(tuple(s[i - order + 1:i + 1]) for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    levels = []
    for k in range(1, order + 1):
        n1, n2 = sum(v == 1 for v in counts[k].values()), sum(v == 2 for v in counts[k].values())
        total, kinds = Counter(), Counter()
        for g, v in counts[k].items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        levels.append((counts[k], total, kinds, min(.95, max(.05, n1 / max(1, n1 + 2 * n2)))))

    def p(g):
        if not g:
            return 1 / alphabet
        c, total, kinds, d = levels[len(g) - 1]
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        return max(c[g] - d, 0) / total[h] + d * kinds[h] / total[h] * p(g[1:])
    s = [" "] * (order - 1) + tokens(text)
    return -sum(math.log2(p(tuple(s[i - order + 1:i + 1]))) for i in range(order - 1, len(s))) / max(1, len(s) - order + 1)


def fitted():
    counted = {}
    for lang, texts in (("de", DE), ("en", EN)):
        packed, _ = langid.grams(*common.flat_text(pa.array(texts)))
        counted[lang] = np.unique(packed, return_counts=True)
    return langid.fit(["de", "en"], counted)


def test_entropies_equal_the_definition():
    model = fitted()
    alphabet = len({c for t in EN + DE for c in tokens(t)}) + 1
    texts = ["the hund sat", "über den zebra-markt, 99 mal!", "x", "qqq", "das  ist", ""]
    bits, n = model.entropies(*common.flat_text(pa.array(texts)))
    for t, row, length in zip(texts, bits, n):
        assert length == len(tokens(t))
        if length:
            assert row == pytest.approx([brute(DE, t, alphabet=alphabet), brute(EN, t, alphabet=alphabet)], abs=1e-4)


def test_sorted_hashes():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**60, 5000))
    table = langid.SortedHashes(keys)
    place = table.find(keys)
    assert (keys[table.order][place] == keys).all() and (table.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()


def test_edge_rows(spark):
    rows = [(1, EN[0], "en"), (2, DE[0], "de"), (3, None, "en"), (4, "", None), (5, "12 !? 34", "de"), (6, "the house " * 5000, None), (1, EN[0], "en"),
            (None, DE[1], "de"), (8, "xqzw jkvq wzzx qqkj vvxw", None)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang_pred string")
    model = langid.train(docs, lang="lang_pred")
    got = docs.select("doc_id", langid.identify(docs, model).alias("s")).select("doc_id", "s.*").collect()
    assert len(got) == 27
    found = defaultdict(set)
    for r in got:
        found[r.doc_id].add((r.lang_pred, r.rejected))
        assert 0 <= r.score <= 1
    assert found[1] == {("en", False)} and found[2] == {("de", False)} and found[6] == {("en", False)} and found[None] == {("de", False)}
    assert found[3] == found[4] == found[5] == {("und", True)}
    none = langid.train(docs.limit(0), lang="lang_pred")
    assert {r.s.lang_pred for r in docs.select(langid.identify(docs, none).alias("s")).collect()} == {"und"}
    assert docs.where(F.lit(False)).select(langid.identify(docs, model)).count() == 0


@pytest.mark.parametrize("sample_bytes", [4_000_000, 20_000])
def test_gibberish_is_rejected_at_any_size(spark, sample_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = ["xqzw jkvq wzzx qqkj vvxw " * 8, "bcdfg hjklm npqrs tvwxz zxcvb nmlkj " * 4, "щгшзх ждлорпавыф ячсмитьбю " * 5]
    model = langid.train(docs.where("doc_id % 5 > 0"), sample_bytes=sample_bytes, check_bytes=sample_bytes // 4)
    assert len(model.langs) == 4 and np.isfinite(model.limit).all()
    found = spark.createDataFrame([(t,) for t in odd], "text string")
    assert all(r.s.rejected for r in found.select(langid.identify(found, model).alias("s")).collect())
    own = docs.where("doc_id % 5 = 0")
    assert not any(r.s.rejected for r in own.select(langid.identify(own, model).alias("s")).collect())


def test_a_language_of_a_few_texts_rejects_gibberish_and_counts_all_of_them(spark):
    texts = EN[:4]
    docs = spark.createDataFrame([(t, "en") for t in texts] + [("zażółć gęślą jaźń", "pl")], "text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["en", "pl"] and np.isfinite(model.limit).all()
    whole = langid.fit(["en", "pl"], {k: np.unique(langid.grams(*common.flat_text(pa.array(t)))[0], return_counts=True) for k, t in (("en", texts), ("pl", ["zażółć gęślą jaźń"]))})
    flat = common.flat_text(pa.array([EN[0], "zażółć gęślą jaźń", "xqzw jkvq"]))
    assert model.entropies(*flat)[0] == pytest.approx(whole.entropies(*flat)[0])
    blank = spark.createDataFrame([("12 !?", "en")], "text string, lang string")
    assert langid.train(blank).langs == []


def test_repeated_texts_count_once(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").distinct()
    often = own.union(own.where("lang = 'en'").orderBy("text").limit(3).crossJoin(spark.range(100)).select("text", "lang"))
    few, many = (langid.train(x, sample_bytes=40_000, check_bytes=10_000) for x in (own, often))
    flat = common.flat_text(pa.array([r.text for r in own.limit(40).collect()]))
    assert few.langs == many.langs and many.limit == pytest.approx(few.limit)
    assert many.entropies(*flat)[0] == pytest.approx(few.entropies(*flat)[0])


def test_training_holds_little_on_the_driver(spark, monkeypatch):
    """The driver gets no row per n-gram or feature, and the fit holds about one table of the highest order."""
    docs = spark.createDataFrame([(i, t, lang) for lang, texts in (("en", EN), ("de", DE)) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    sent = []
    kind, collect = type(docs), type(docs).collect
    monkeypatch.setattr(kind, "toPandas", None)
    monkeypatch.setattr(kind, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    langid.train(docs)
    toxicity.train(docs, spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, grade int"))
    assert max(map(len, sent)) <= 40  # blocks of n-grams of 4 shuffle partitions, or features
    rng = np.random.default_rng(0)
    counted = {lang: (grams, rng.integers(1, 9, len(grams))) for lang in "abcdefgh" for grams in [np.unique(rng.integers(0, 1 << 60, 50_000))]}
    tracemalloc.start()
    try:
        model = langid.fit(sorted(counted), counted)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    table = sum(v.nbytes for v in model.values)
    assert peak < 5.8 * table
