"""Token ids of documents in files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames of little-endian unsigned 32-bit ids, then a skippable frame with the directory
(doc_id and number of ids of each document), then the public seekable format's table: per frame its compressed and
decompressed size and the low 32 bits of the content's XXH64. Frames end where documents end, but for documents longer
than a frame. A reader decompresses the frames of the documents it wants and no others.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm.common import blocks, flat_text
from lotlens.llm.pretokens import Coder

#: Fixed values of the seekable format and of this file's directory frame.
SEEK_FRAME, SEEK_FOOTER, DIRECTORY_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
FRAME_IDS = 1 << 18
#: Text encoded at once; the more, the fewer lookups of repeated pre-tokens.
STEP = 1 << 20
NO_ID = -(1 << 63)


class Encoder:
    """The tokenizers library over many texts: every distinct pre-token goes through it once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for word, i in vocabulary.items():
            self.size[i] = len(word)  # a byte-level vocabulary spells each byte as one character
        self.coder = Coder(self._new)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token. Line ends keep those that hold more than white space apart in one text."""
        out: list[bytes] = [None] * len(pieces)
        solid = [i for i, p in enumerate(pieces) if (q := p.strip()) and (32 < q[0] < 128 or q.decode().strip())]
        ids = self._ids(b"\n".join([pieces[i] for i in solid]).decode()) if solid else np.zeros(0, np.uint32)
        ends = np.cumsum(self.size[ids])
        want = np.cumsum(np.fromiter((len(pieces[i]) + 1 for i in solid), np.int64, len(solid)))
        last = np.searchsorted(ends, want - 1)
        apart = (last < len(ends)) & (ends[np.minimum(last, len(ends) - 1)] == want - 1) if len(ends) else np.zeros(len(solid), bool)
        whole = apart & np.concatenate([[True], apart[:-1]]) if len(solid) else apart
        begin = np.concatenate([[0], last[:-1] + 2]) if len(solid) else last
        raw = ids.tobytes()
        for i, good, x, y in zip(solid, whole.tolist(), (4 * begin).tolist(), (4 * last + 4).tolist(), strict=True):
            if good:
                out[i] = raw[x:y]
        for i, p in enumerate(pieces):
            if out[i] is None:
                out[i] = self._ids(p.decode()).tobytes()
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Writer:
    """One file: add() documents in order, then close()."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.docs, self.counts, self.waiting, self.size = [], [], [], [], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        if self.size and self.size + len(ids) > FRAME_IDS:
            self._flush()
        for i in range(0, len(ids), FRAME_IDS):
            part = ids[i:i + FRAME_IDS]
            self.waiting.append(part)
            self.size += len(part)
            if self.size >= FRAME_IDS:
                self._flush()

    def _flush(self) -> None:
        content = np.concatenate(self.waiting).astype("<u4").tobytes()
        packed = self.packer.compress(content)
        self.stream.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        directory = zstandard.ZstdCompressor().compress(np.array([self.docs, self.counts], "<i8").tobytes())
        self.stream.write(struct.pack("<II", DIRECTORY_FRAME, len(directory)) + directory)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOTER)
        self.stream.write(struct.pack("<II", SEEK_FRAME, len(table) + len(footer)) + table + footer)


class Reader:
    """One file: its directory, and ids from a position on, through the frames that hold them."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_FOOTER:
            raise ValueError("no seek table at the end of the file")
        file.seek(size - 9 - 12 * count)
        self.frames = np.frombuffer(file.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 1] // 4)])
        self.directory_at, self.directory_size = int(self.at[-1]), size - 17 - 12 * count - int(self.at[-1])
        self.held, self.content = -1, None

    def directory(self) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(self.directory_at + 8)
        docs, counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(self.directory_size - 8)), "<i8").reshape(2, -1)
        return docs, counts

    def _frame(self, k: int) -> np.ndarray:
        if k != self.held:
            self.file.seek(int(self.at[k]))
            content = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.frames[k, 0])))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} fails its checksum")
            self.held, self.content = k, np.frombuffer(content, "<u4")
        return self.content

    def ids(self, start: int, count: int) -> np.ndarray:
        parts, k = [], int(np.searchsorted(self.first, start, "right")) - 1
        while count:
            part = self._frame(k)[start - self.first[k]:][:count]
            parts.append(part)
            start, count, k = start + len(part), count - len(part), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _write(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer, written = TaskContext.get().partitionId(), None, 0
        place, root = fs.FileSystem.from_uri(folder)
        name = f"part-{number:06d}.ids"
        draft = f"{root}/.{name}-{uuid.uuid4().hex}"
        for batch in batches:
            data, starts = flat_text(batch.column("text"))
            docs = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for a, b in blocks(starts, STEP):
                if writer is None:
                    place.create_dir(root)
                    writer = Writer(place.open_output_stream(draft))
                ids, rows = encoder(path).coder.ids(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                for doc, i, j in zip(docs[a:b], rows[:-1], rows[1:], strict=True):
                    writer.add(int(doc), np.append(ids[i:j], np.uint32(end)))
                    written += int(j - i) + 1
        if writer is not None:
            writer.close()
            writer.stream.close()
            place.move(draft, f"{root}/{name}")  # a repeated task replaces the file by an equal one
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([written], pa.int64())], names=["number", "file", "n_ids"])
    return run


def write(docs: DataFrame, folder: str, path: str, end: int = 0) -> DataFrame:
    """Encodes docs (doc_id, text) in ascending doc_id order into files in `folder` and returns their manifest.

    Each document's ids are followed by `end`; null text counts as empty. A null doc_id comes first; rows of one doc_id
    are ordered by text, and repeated rows are kept. The files are named in order; `folder` is one that all executors
    share. The manifest, `folder`/manifest, has each file's number, place and ids, and `base`, the ids of all before it.
    """
    spark = docs.sparkSession
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"))
    ordered.mapInArrow(_write(folder, path, end), "number long, file string, n_ids long").write.parquet(f"{folder}/files")
    base, rows = 0, []
    for r in spark.read.parquet(f"{folder}/files").orderBy("number").collect():  # a row per file
        rows.append((r.number, r.file, r.n_ids, base))
        base += r.n_ids
    spark.createDataFrame(rows, "number long, file string, n_ids long, base long").coalesce(1).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("number long, file string, n_ids long, base long").parquet(f"{folder}/manifest")


def _opened(uri: str) -> Reader:
    place, path = fs.FileSystem.from_uri(uri)
    return Reader(place.open_input_file(path))


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            docs, counts = _opened(file).directory()
            place = np.cumsum(counts) - counts
            for i in range(0, len(docs), 10_000):
                d, c, p = (x[i:i + 10_000] for x in (docs, counts, place))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(d)), pa.array(d, mask=d == NO_ID), pa.array(p), pa.array(p + base), pa.array(c)],
                                                 names=["file", "doc_id", "place", "start", "n_tokens"])


def index(files: DataFrame) -> DataFrame:
    """A row per document of a manifest's files: file, doc_id, place (in the file), start (in all files), n_tokens."""
    spread = files.select("file", "base").repartition(F.col("file"))
    return spread.mapInArrow(_directories, "file string, doc_id long, place long, start long, n_tokens long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, reader = None, None
    for batch in batches:
        rows, size, first = [], 0, 0
        for i, (file, place, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "place", "n_tokens")), strict=True)):
            if file != name:
                name, reader = file, _opened(file)
            rows.append(reader.ids(place, count).tobytes())
            size += len(rows[-1])
            if size > 1 << 23 or i + 1 == len(batch):
                part = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(rows, pa.binary())],
                                                 names=["doc_id", "start", "n_tokens", "ids"])
                rows, size, first = [], 0, i + 1


def read(wanted: DataFrame) -> DataFrame:
    """Rows of index(), any selection of them, as (doc_id, start, n_tokens, ids: little-endian unsigned 32-bit)."""
    ordered = wanted.select("file", "doc_id", "place", "start", "n_tokens").repartitionByRange("file", "place").sortWithinPartitions("file", "place")
    return ordered.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
