import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotlens.llm import bpe, common

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = bpe.byte_pairs(PATH)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PEER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = "abst'' \n\t  reLLvm'dé9٣!-漢字\x1c😀 "


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET) | st.text(), max_size=6))
def test_equals_the_peer_and_round_trips(texts):
    data, starts = common.flat_text(pa.array(texts, pa.string()))
    ids, rows = MODEL.encode(data, starts)
    assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])] == [PEER.encode_ordinary(t) for t in texts]
    decoded, at = MODEL.decode(ids, rows)
    assert decoded == "".join(texts).encode() and (at == starts).all()


def test_perfect_hash_is_minimal():
    hashes = common.mix(np.arange(5000))
    assert sorted(bpe.PerfectHash(hashes).slots(hashes)) == list(range(5000))
    assert bpe.PerfectHash(hashes[:1]).slots(hashes[:1]).tolist() == [0]


def test_query_columns(spark):
    texts = [None, "", "hello hello, world's end", "x" * 50_000, " " * 9, "hello hello, world's end"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = docs.select("doc_id", bpe.coded(F.col("text"), PATH).alias("c"), bpe.encode_ids(F.col("text"), PATH).alias("ids")).collect()
    for r in rows:
        want = PEER.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.c.n_tokens == len(want)
        assert r.c.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.c.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = docs.select("text", bpe.decode_ids(bpe.encode_ids(F.col("text"), PATH), PATH).alias("b")).collect()
    assert all(bytes(r.b) == (r.text or "").encode() for r in back)
    assert docs.limit(0).select(bpe.coded(F.col("text"), PATH)).count() == 0
