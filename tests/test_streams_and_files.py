"""Streaming forms against batch forms; readers and writers; sweeps."""

import json

import pytest
from pyspark.errors.exceptions.base import StreamingQueryException
from pyspark.sql import functions as F

from lotlens import schema
from lotlens.operators import sequences as Q
from lotlens.operators import text as X
from lotlens.operators import whatif as W
from lotlens.sources import files as S
from lotlens.sources import packs as P
from lotlens.sources.commits import commit, committed
from lotlens.streaming import streams as M


def as_stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def batches(spark, parts, path):
    """A stream with a micro-batch for each DataFrame of ``parts``."""
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def at_seconds(spark, rows, names):
    """Rows with their time in seconds as the column ts; names ends with 's long'."""
    return spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds(F.col("s") + 100_000)).drop("s")  # the first watermark is the epoch


def test_sprt_stream_equals_batch(spark, tmp_path):
    pack = P.pack_by_id("in-psf-2026-pre-a")
    rows = [(lot, i, (lot * 7 + i * 3) % 13, 40) for lot in range(6) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "lot_id long, tray int, bad long, n long").withColumn("at", F.timestamp_seconds(F.col("tray") * 60))
    stream = M.feed(df, str(tmp_path), "at", slices=3, disorder="3 minutes")
    out = M.drain(M.sprt_stream(stream, pack, "3 minutes"), str(tmp_path))
    last = {r.lot_id: (r.decision, r.k) for r in out.groupBy("lot_id").agg(F.max_by("decision", "k").alias("decision"), F.max("k").alias("k")).collect()}
    assert last == {r.lot_id: (r.decision, r.decided_at) for r in Q.sequential_sprt(df, pack).collect()}


def test_lockout_ignores_attempts_in_cooldown(spark, tmp_path):
    times = [0, 1, 2, 3, 4, 10, 20, 40, 41, 42, 43, 44]
    df = at_seconds(spark, [(1, i, True, s) for i, s in enumerate(times)], "user_id long, event_id long, failed boolean, s long")
    got = {r.event_id for r in M.drain(M.lockout_stream(M.feed(df, str(tmp_path), "ts", disorder="20 seconds"), delay="20 seconds"), str(tmp_path)).collect()}
    assert got == {4, 11}


def test_rows_are_handled_in_time_order_across_batches(spark, tmp_path):
    names = "key long, event_id long, pass boolean, s long"
    # The failure at 20 arrives after the passes around it; the pass at 5 arrives behind the watermark.
    first = at_seconds(spark, [(1, 1, True, 0), (1, 2, True, 10), (1, 4, True, 30), (2, 9, True, 25)], names)
    second = at_seconds(spark, [(1, 3, False, 20), (1, 5, True, 40), (2, 8, True, 15), (2, 10, True, 26)], names)
    third = at_seconds(spark, [(1, 6, True, 100), (1, None, None, 200)], names)
    fourth = at_seconds(spark, [(1, 7, False, 5), (1, None, None, 900), (2, None, None, 901)], names)
    stream = batches(spark, [first, second, third, fourth], str(tmp_path / "in"))
    out = M.drain(M.steady_scan_stream(stream, 3, "30 seconds", "10 minutes"), str(tmp_path / "run"))
    assert sorted((r.key, r.event_id) for r in out.collect()) == [(1, 6), (2, 10)]


def test_idle_keys_start_afresh_and_leave_the_state(spark, tmp_path):
    names = "key long, event_id long, pass boolean, s long"
    early = at_seconds(spark, [(k, k, True, k) for k in range(20)] + [(k, 100 + k, True, 30 + k) for k in range(20)], names)
    late = at_seconds(spark, [(3, 200, True, 5000), (3, 201, True, 5001), (None, None, None, 9000)], names)
    end = at_seconds(spark, [(None, None, None, 20000)], names)
    stream = batches(spark, [early, late, end], str(tmp_path / "in"))
    query = M.tail(M.steady_scan_stream(stream, 3, "10 seconds", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    assert committed(spark, str(tmp_path / "out"), spark.createDataFrame([], "key long, event_id long").schema).count() == 0  # two and two passes, a gap between


def test_guard_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, (i * 7 + k) % 3 != 0, i % 11 == 10, i % 4 == 1, "sharp" if i % 2 else "glare", i * 13 % 400) for k in range(3) for i in range(60)]
    df = at_seconds(spark, rows, "key long, event_id long, pass boolean, shot boolean, press boolean, gate string, s long").withColumn("gate", F.expr("CASE WHEN NOT pass THEN gate END"))
    out = M.drain(M.guard_stream(M.feed(df, str(tmp_path), "ts", slices=5, disorder="90 seconds"), 2, "90 seconds"), str(tmp_path))
    want = Q.guard_telemetry(df).where("closed").drop("closed")
    assert sorted(map(tuple, out.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 3


def test_actions_stream_update_mode(spark, tmp_path):
    schema_ = "lot_id long, bulb_id string, kind string, to_bucket string, who string, seq long"
    one = spark.createDataFrame([(1, "b", "contest", None, "farmer", 2), (1, "c", "override", "URS", "officer", 1)], schema_)
    two = spark.createDataFrame([(1, "b", "override", "URS", "officer", 1), (1, "c", "override", "REJECT", "officer", 3)], schema_)
    out = M.drain(M.current_actions(batches(spark, [one, two], str(tmp_path / "in"))), str(tmp_path / "run"), "update")
    assert {(r.bulb_id, r.kind, r.to_bucket) for r in M.upsert(out, ["lot_id", "bulb_id"]).collect()} == {("b", "contest", None), ("c", "override", "REJECT")}


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, centre_id long")
    assert committed(spark, path, df.schema).count() == 0
    df.write.parquet(f"{path}/data/batch=7/attempt=lost")  # rows of an attempt that was never entered
    assert commit(df, path, 7, ["centre_id"]) and not commit(df, path, 7, ["centre_id"])
    assert commit(df.limit(0), path, 8, ["centre_id"]) and commit(df.where("id < 3"), path, "late", ["centre_id"])
    got = committed(spark, path, df.schema, with_batch=True)
    assert got.groupBy("batch").count().orderBy("batch").collect() == [("7", 10), ("late", 3)]
    assert sorted((r.id, r.centre_id) for r in committed(spark, path, df.schema).where("id >= 3").collect()) == [(i, i % 2) for i in range(3, 10)]


def test_tail_repeats_a_failed_batch_under_its_number(spark, tmp_path):
    parts = [spark.createDataFrame([(i,) for i in range(k, k + 5)], "id long") for k in (0, 5, 10)]
    stream = batches(spark, parts, str(tmp_path / "in"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def fail(batch, number):
        if number == 1:
            batch.write.parquet(f"{out}/data/batch=1/attempt=lost")
            raise RuntimeError("lost")
    with pytest.raises(StreamingQueryException):
        M.tail(stream, out, ck, fail).awaitTermination()
    assert committed(spark, out, parts[0].schema).count() == 5
    M.tail(stream, out, ck).awaitTermination()
    assert sorted(r.id for r in committed(spark, out, parts[0].schema).collect()) == list(range(15))


def test_session_stream_closes_on_gap(spark, tmp_path):
    df = spark.createDataFrame([(1, s) for s in (0, 60, 120, 5000, 900000)], "user_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 100_000)).drop("s")  # the first watermark is the epoch
    src = tmp_path / "in"
    df.where("unix_timestamp(ts) < 900000").coalesce(1).write.parquet(str(src / "a"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
    M.drain(M.session_stream(stream), str(tmp_path / "run"))
    df.where("unix_timestamp(ts) >= 900000").coalesce(1).write.parquet(str(src / "b"))
    out = M.drain(M.session_stream(stream), str(tmp_path / "run"))
    assert {r.n for r in out.collect()} == {3, 1}


def test_readers(spark, tmp_path):
    bundle = {"kind": "bundle", "cert": {"hash": "aa", "core": {"lot": {"id": "L1", "centre": "C", "farmerRef": "E2 p l 1"}, "rev": 2, "pack": {"id": "x", "hash": "h"}, "overrides": [{"bulb": "b0", "kind": "override"}, {"bulb": "b1", "kind": "contest"}],
                                                                "bulbs": [{"id": "b0", "tray": 1, "look": 1, "size": {"min": 550, "max": 600, "sd": 9}, "frac": {"rot": 4, "cut": None}, "fsd": 10, "shape": {"double": True}, "conf": 900, "w": 1, "wsd": 1}],
                                                                "headline": {"gradeA": 71.5}}}, "captures": [{"id": "c1", "guard": {"scans": 4, "failed": 1, "byGate": {"sharp": 1}}}]}
    (tmp_path / "r" / "deep").mkdir(parents=True)
    (tmp_path / "r" / "deep" / "one.json").write_text(json.dumps(bundle, indent=1))
    b = S.read_receipts(spark, str(tmp_path / "r"))
    r = S.receipt_table(b).first()
    assert (r.lot_id, r.rev, r.n_bulbs, r.n_actions, r.n_overrides, r.grade_a) == ("L1", 2, 1, 2, 1, 71.5)
    item = S.receipt_bulbs(b).first()
    assert item.size_min == 550 and item.rot == 4 and item.cut is None and item.is_double is True

    (tmp_path / "t.csv").write_text("image_id,relpath,items_visible,ambiguous\n a1 , x/y.jpg ,12,0\n\nb2,z.jpg,,1\n")
    rows = S.read_truth_csv(spark, str(tmp_path / "t.csv"), schema.COUNT_TRUTH).orderBy("image_id").collect()
    assert [(x.image_id, x.items_visible) for x in rows] == [("a1", 12), ("b2", None)]
    assert S.read_truth_csv(spark, str(tmp_path / "none.csv"), schema.COUNT_TRUTH).count() == 0

    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "img7.txt").write_text("1 0.5 0.5 0.2 0.4\n2 0.1\n")
    box = S.read_box_labels(spark, str(tmp_path / "labels"), 100, 100).collect()
    assert len(box) == 1 and box[0].stem == "img7" and (box[0].x0, box[0].y1) == (pytest.approx(40), pytest.approx(70))

    photo = tmp_path / "2. Unhealthy" / "1. Red" / "2. Multiple"
    photo.mkdir(parents=True)
    (photo / "photo00126.jpg").write_bytes(b"x")
    p = S.read_photo_index(spark, str(tmp_path)).first()
    assert (p.id, p.label, p.variety, p.qty, p.split) == (126, 1, "red", "multiple", "tune")


def test_ledger_append_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "id long, centre_id long, lot_ref string")
    assert [S.append_ledger(df, str(tmp_path / "lots"), n) for n in (1, 1, 2)] == [True, False, True]
    t = S.read_ledger(spark, str(tmp_path))
    assert t["lots"].where("centre_id = 5").count() == 2 and t["bulbs"].count() == 0


def test_evidence_pages_bound_each_row(spark):
    caps = spark.createDataFrame([(1, f"c{i}", i) for i in range(10)], "lot_id long, capture_id string, shot_at long")
    b = S.evidence_bundle(spark.createDataFrame([(1, "h"), (2, "g")], "lot_id long, hash string"), caps, per_page=4).orderBy("lot_id", "page").collect()
    assert [len(r.captures) for r in b] == [4, 4, 2, 0] and b[1].captures[0].capture_id == "c4"


def test_text_hygiene(spark):
    df = spark.createDataFrame([("Rames‮Kumar\x00 ",), ("é",), ("x" * 12,), (None,)], "s string")
    r = df.select(*X.clean_text("s", 11)).collect()
    assert [(x.text, x.error) for x in r] == [("RamesKumar", None), ("é", None), (None, "too long"), ("", None)]
    n = spark.createDataFrame([("NaN",), ("1e999",), ("7",), ("",), ("x",)], "s string").select(*X.finite_or_reject("s")).collect()
    assert [(x.number, x.error) for x in n] == [(None, "not finite"), (None, "not finite"), (7.0, None), (None, None), (None, "not a number")]


def test_severities_nest(spark):
    items = spark.createDataFrame([(1, f"i{i}", "sound" if i % 4 else "rotten", "A" if i % 2 else "B") for i in range(200)], "lot_id long, id string, class string, size_grade string")
    rows = W.what_if_bulbs(items, [0.0, 0.2, 0.5, 1.0]).orderBy("severity").collect()
    assert [r.n_degraded for r in rows] == sorted(r.n_degraded for r in rows) and rows[0].n_degraded == 0 and rows[-1].n_defects == 200
    assert all(r.to_rotten == r.n_degraded for r in rows)


def test_manifest_tolerates_junk(spark):
    good = json.dumps([{"look_index": 0, "tray_id": "1", "path": "lot_1/look_0.jpg", "sha256": "ab", "bytes": 3}])
    df = spark.createDataFrame([(0, good), (1, "not json"), (2, None), (3, "[]")], "i int, s string")
    got = {r.i: len(r.m) for r in df.select("i", X.parse_manifest("s").alias("m")).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0}


def test_ledger_tail_writes_every_row_once(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, i % 5 == 0) for i in range(50)], "id long, centre_id long, disputed boolean")
    stream = as_stream(spark, df, str(tmp_path / "in"))
    seen = []
    for _ in range(2):  # a second run over the same input adds nothing
        M.tail(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda b, i: seen.append(b.count())).awaitTermination()
    out = committed(spark, str(tmp_path / "out"), df.schema)
    assert out.count() == 50 and out.where("disputed").count() == 10 and sum(seen) == 50
