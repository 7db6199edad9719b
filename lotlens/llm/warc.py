"""Web archives: an index first, then byte ranges.

Writing gives one index row per record (file, offset, length, URL, digest); reading takes any selection of index rows,
sorts them by place, joins neighbouring ranges into one read each and takes the records apart by the index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes between two wanted records that one read skips rather than seeks over, and most bytes of one read.
GAP, MOST = 1 << 16, 1 << 23
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def marked(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, digest (SHA-256, hex), record_type and refers_to.

    Of equal payloads of at least LEAST_REVISIT bytes the smallest page_id is the response and all others revisit it;
    repeated rows of that page_id are responses. A null page_id is never the response of others: alone it is a response
    itself, beside a page with an id it revisits that. Null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    shared = (rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1 and first is not null").select("digest", "first"))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", "payload_bytes", "digest", F.when(other, "revisit").otherwise("response").alias("record_type"),
                                                      F.when(other, F.col("first")).alias("refers_to"))


def record(row: dict) -> bytes:
    """One record as a gzip member of its own: WARC head, HTTP head, and for a response the payload."""
    payload = row["html"].encode() if row["record_type"] == "response" else b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + payload
    name = uuid.UUID(hashlib.md5(f"{row['page_id']} {row['url']} {row['digest']}".encode()).hexdigest())
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", row["url"].replace("\r", " ").replace("\n", " ")), ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
            ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", row["payload_bytes"]), ("Content-Length", len(block))]
    if row["page_id"] is not None:
        head.append(("X-Page-ID", row["page_id"]))
    if row["refers_to"] is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", row["refers_to"])]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Head fields and payload of one gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, stream, offset = f"{root}/.{name}-{uuid.uuid4().hex}", None, 0
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if stream is None:
                    place.create_dir(root)
                    stream = place.open_output_stream(draft)
                member = record(row)
                stream.write(member)
                rows.append({"file": f"{folder}/{name}", "offset": offset, "length": len(member)} | {c: row[c] for c in ("page_id", "url", "digest", "record_type")})
                offset += len(member)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
        if stream is not None:
            stream.close()
            place.move(draft, f"{root}/{name}")  # a repeated task replaces the file by an equal one
    return run


SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.split() for x in INDEX.split(", "))])


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of pages into archives in `folder`, shared by all executors; returns the written index.

    Rows stay where the search for equal payloads has dealt them, so payloads move once; inside an archive they are in
    order of page_id, url and digest, so that a repeated task writes the same file.
    """
    ordered = marked(pages).sortWithinPartitions("page_id", "url", "digest")
    ordered.mapInArrow(_write(folder), INDEX).write.parquet(f"{folder}/index")
    return index(pages.sparkSession, folder)


def index(spark, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Sorted (file, offset, length) cut where a new read begins: another file, a wide gap, or enough bytes."""
    first = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[first][0] or rows[i][1] - (rows[i - 1][1] + rows[i - 1][2]) > GAP or rows[i][1] + rows[i][2] - rows[first][1] > MOST:
            yield first, i
            first = i


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RECORD_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, stream = None, None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        for a, b in ranges(rows):
            if rows[a][0] != name:
                name = rows[a][0]
                place, path = fs.FileSystem.from_uri(name)
                stream = place.open_input_file(path)
            start = rows[a][1]
            stream.seek(start)
            raw = stream.read(rows[b - 1][1] + rows[b - 1][2] - start)
            found = []
            for _, offset, length in rows[a:b]:
                fields, payload = parsed(raw[offset - start:offset - start + length])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                response = fields["WARC-Type"] == "response"
                if response and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{name} at {offset}: the payload has another digest")
                found.append({"page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]),
                              "payload_digest": digest, "record_type": fields["WARC-Type"],
                              "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None, "payload": payload if response else None})
            yield pa.RecordBatch.from_pylist(found, schema=RECORD_SCHEMA)


def read(wanted: DataFrame) -> DataFrame:
    """The records of any selection of index rows; a revisit's payload is null and stands at the page it refers to."""
    ordered = wanted.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read, RECORD)
