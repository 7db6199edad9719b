import base64
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lotlens.llm.common import shared_folder

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_stages_keep_what_they_should(spark):
    rng = random.Random(9)
    syllables = {"en": ["the", "ing", "ou", "th", "er", "st", "an"], "de": ["sch", "ung", "ei", "ich", "zu", "der", "ä"]}

    def prose(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    docs, labels, bench = [], [], [(i, prose("en", 45)) for i in range(6)]
    for i in range(400):
        lang = "en" if i % 3 else "de"
        toxic = i % 4 == 1
        docs.append((i, prose(lang, rng.randint(60, 120)) + (" scoundrel rascal" * 3 if toxic else ""), lang))
        labels.append((i, 1, int(toxic)))
    clean = {i for i in range(400) if i % 4 != 1}
    text = {d: t for d, t, _ in docs}
    docs += [(500, text[2], "en"), (501, text[4] + " tail", "en"), (502, "12345 ---", "en"), (503, None, None), (504, "", "de"),
             (505, prose("en", 40) + " " + bench[2][1].upper() + " " + prose("en", 30), "en"), (506, text[6] + " rascal scoundrel scoundrel rascal rascal", "en"), (2, text[2], "en"), (508, prose("de", 90), None)]
    folder = shared_folder(spark)
    spark.createDataFrame([(d, t, lang, "src", len(t or "")) for d, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in got]
    assert sorted(ids) == sorted(clean | {508})
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text[508] = docs[-1][1]
    assert all(r.n_tokens == len(peer.encode_ordinary(text[r.doc_id])) for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"_found": F.lit("own"), "_ROW": F.col("doc_id") + 1})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.where("_found <> 'own' or _ROW <> doc_id + 1").count() == 0
        assert out.schema.names == docs.schema.names and stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_groups_are_of_rows_not_of_ids(spark):
    rng = random.Random(5)

    def prose():
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, c), (3, a + " end"), (None, b), (None, d), (None, d), (None, d + " more"), (None, e), (4, e), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    own = [r for r in got if r[0] is None]
    assert len(own) == 1 and own[0][1] in (d, d + " more")
    assert sorted((r for r in got if r[0] is not None), key=str) == sorted([(1, a), (1, b), (3, c), (4, e), (5, None)], key=str)
