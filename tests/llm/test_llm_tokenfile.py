import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotlens.llm import tokenfile
from lotlens.llm.common import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def peer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_whole_texts():
    rng = random.Random(3)
    alphabet = list("abst'' \n\t  reLLvm'dé9٣!-漢字\x1c😀 ")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "<|endoftext|> a", "x" * 3000, " " * 500 + "a"]
    from lotlens.llm.common import flat_text
    import pyarrow as pa
    ids, rows = tokenfile.Encoder(PATH).coder.ids(*flat_text(pa.array(texts)))
    for i, e in enumerate(peer().encode_batch(texts, add_special_tokens=False)):
        assert ids[rows[i]:rows[i + 1]].tolist() == e.ids


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_IDS", 50)
    texts = [None, "", "hello world", "word " * 300, "a b c", "a b c"] + [f"text number {i} of many" for i in range(200)]
    rows = [(i * 7 % 50 if i % 31 else None, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = shared_folder(spark)
    files = tokenfile.write(docs, folder, PATH)
    got = tokenfile.read(tokenfile.index(files)).orderBy("start").collect()
    assert len(got) == len(rows)
    encode = peer().encode
    want = sorted(((d is not None, d or 0, tuple([*encode(t or "", add_special_tokens=False).ids, 0])) for d, t, _ in rows), key=lambda x: x[:2])
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [x[:2] for x in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4"))) for r in got) == sorted(want)
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    some = tokenfile.read(tokenfile.index(files).where("doc_id = 21")).select("start", F.crc32("ids").alias("c")).collect()
    assert {(r.start, r.c) for r in some} == {(r.start, zlib.crc32(r.ids)) for r in got if r.doc_id == 21} and some
    empty = shared_folder(spark)
    assert tokenfile.read(tokenfile.index(tokenfile.write(docs.limit(0), empty, PATH))).count() == 0


def test_seek_table_and_checksum(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_IDS", 8)
    from pyarrow import fs
    local = fs.LocalFileSystem()
    docs = [(i, np.arange(i * 3, dtype=np.uint32)) for i in range(9)]
    with local.open_output_stream(str(tmp_path / "f")) as out:
        writer = tokenfile.Writer(out)
        for d, ids in docs:
            writer.add(d, ids)
        writer.close()
    raw = (tmp_path / "f").read_bytes()
    count, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == tokenfile.SEEK_FOOTER and flags == 0x80
    table = [struct.unpack("<III", raw[-9 - 12 * (count - k):][:12]) for k in range(count)]
    at = 0
    for packed, size, check in table:
        content = zstandard.ZstdDecompressor().decompress(raw[at:at + packed])
        assert len(content) == size and xxhash.xxh64_intdigest(content) & 0xFFFFFFFF == check
        at += packed
    reader = tokenfile.Reader(local.open_input_file(str(tmp_path / "f")))
    place = 0
    for _, ids in docs:
        assert (reader.ids(place, len(ids)) == ids).all()
        place += len(ids)
    bad = bytearray(raw)
    bad[-9 - 12 * count + 8] ^= 1
    (tmp_path / "g").write_bytes(bytes(bad))
    with pytest.raises(ValueError):
        tokenfile.Reader(local.open_input_file(str(tmp_path / "g"))).ids(0, 5)
