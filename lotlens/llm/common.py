"""Shared folder, written intermediate tables, and Arrow text as flat NumPy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a task works on; arrays of about a hundred times this size come and go.
BLOCK_BYTES = 1 << 19
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the one that spark.checkpoint.dir names; a local session without one gets a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='lotlens-')}"
    return f"{root.rstrip('/')}/lotlens-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", **options: str | int) -> DataFrame:
    """df as a Parquet table in the shared folder: later readers don't repeat its work and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str | Column, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the key as text leaves that remainder; a null key does not."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def flat_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and where each begins (one more entry than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    starts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8)[starts[0]:starts[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, starts - starts[0]


def blocks(starts: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most so many bytes each; a longer row is a range of its own."""
    at, n = 0, len(starts) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def code_points(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row starts as code points and row starts."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, starts
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[starts]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of all pieces, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_SALT = np.random.default_rng(20240521).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)
_LENGTH = np.uint64(0xA24BAED4963EE407)


def _powers(n: int) -> np.ndarray:
    """Of MULTIPLIER, modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        last = _POWERS[-1] * MULTIPLIER
        _POWERS = np.concatenate([_POWERS, _POWERS * last])
    return _POWERS


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece of the bytes: a polynomial of salted bytes from the piece's end, mixed with its length."""
    with np.errstate(over="ignore"):
        lengths = (ends - starts).astype(np.int64)
        if not len(lengths):
            return np.zeros(0, np.uint64)
        at = ragged(starts.astype(np.int64), lengths) if lengths.sum() != len(data) else None
        symbols = _SALT[data if at is None else data[at]]
        first = np.cumsum(lengths) - lengths
        exponent = np.arange(len(symbols)) - np.repeat(first, lengths)
        symbols = symbols * _powers(int(lengths.max()) + 1)[exponent]
        total = np.zeros(len(lengths), np.uint64)
        some = lengths > 0
        if some.any():
            total[some] = np.add.reduceat(symbols, first[some])
        return mix(total + lengths.astype(np.uint64) * _LENGTH)


def symbols_of(data: np.ndarray) -> np.ndarray:
    """The salted bytes that piece_hashes sums."""
    return _SALT[data]


def longer_hashes(shorter: np.ndarray, symbols: np.ndarray, length: int) -> np.ndarray:
    """Unfinished hashes of pieces of that length from those one byte shorter (0 for length 1) and their last symbols."""
    with np.errstate(over="ignore"):
        return shorter + symbols * _powers(length)[length - 1]


def finished_hashes(total: np.ndarray, length: int) -> np.ndarray:
    """piece_hashes of pieces of that length."""
    with np.errstate(over="ignore"):
        return mix(total + np.uint64(length) * _LENGTH)


def bytes_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(pieces), np.uint8), ends - lengths, ends
