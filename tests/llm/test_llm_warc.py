import gzip
import hashlib
from collections import Counter, defaultdict

from lotlens.llm import warc
from lotlens.llm.common import shared_folder


def cases():
    long, other = "<p>é" + "a" * 120, "b" * 100
    return [(1, "http://a/1", long), (2, "http://a/2", long), (0, "http://a/0\r\nX: y", other), (5, None, other), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""),
            (8, "u", "x" * 99), (9, "u", "x" * 99), (None, "n", long), (None, "n", "n" * 200), (1, "http://a/1", long), (11, "big", "y" * 300_000)]


def brute(rows):
    first = defaultdict(list)
    for p, _, h in rows:
        if p is not None:
            first[h or ""].append(p)
    out = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        to = min(first[h or ""], default=None) if len(raw) >= 100 else None
        revisit = to is not None and to != p
        out[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    return out


def test_round_trip_and_selection(spark):
    rows = cases()
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    folder = shared_folder(spark)
    index = warc.write(pages, folder)
    got = warc.read(index).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)
    html = {p: h or "" for p, _, h in rows}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    one = warc.read(index.where("page_id = 3 or url = 'big'")).collect()
    assert sorted(r.page_id for r in one) == [3, 11]
    for r in index.collect():
        raw = open(r.file.removeprefix("file://"), "rb").read()[r.offset:r.offset + r.length]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n") and warc.parsed(raw)[0]["WARC-Payload-Digest"] == f"sha256:{r.digest}"
    assert warc.read(warc.write(pages.limit(0), shared_folder(spark))).count() == 0


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP + 1, 5), ("b", 0, warc.MOST), ("b", warc.MOST, 3), ("b", warc.MOST + 3, 3)]
    assert list(warc.ranges(rows)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(warc.ranges([])) == []
