"""Steps that once grew faster than their input: chains by centre, gates by item, photos by slices, captures by lot."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lotlens.catalog import QUERIES, Tables, measures
from lotlens.catalog.carriers import chained_ledger
from lotlens.operators import classify as Y
from lotlens.operators import joins as J
from lotlens.operators import trust as T
from lotlens.plans import receipts
from lotlens.sources import files as S
from lotlens.streaming import sinks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def ledger(spark):
    t = Tables(spark, "/nowhere")
    t._seen["orders"] = spark.sql("""SELECT id * 7 % 501 AS o_orderkey, IF(id % 19 = 3, NULL, id % 13) AS o_custkey, TIMESTAMP '1996-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS o_orderdate,
      IF(id % 37 = 5, NULL, 100.0D + id * 3.25D) AS o_totalprice FROM range(500)""")
    return t


@pytest.mark.parametrize("block", [4, 8, 64, 4096])
def test_chained_blocks_equal_the_ledger(ledger, block):
    want, got = ledger("ledger_lots"), chained_ledger(ledger, block)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_window_holds_a_whole_centre(ledger):
    lags = [line for line in plan(T.audit_chain(chained_ledger(ledger))).splitlines() if "Window" in line and "lag(" in line]
    assert lags and all("_block" in line or "_slice" in line for line in lags)


def test_gates_multiply_no_items(spark):
    items = spark.sql("SELECT id, id DIV 3 AS photo, CAST(id DIV 3 % 2 AS INT) AS label, id % 10 / 10D AS p, IF(id % 7 = 0, NULL, id % 5 / 100D) AS rot, id % 4 / 100D AS blackening, id % 3 = 0 AS fails FROM range(120)")
    gates = [0.0, 0.3, 0.75]
    grid = Y.threshold_grid(items.drop("id"), gates)
    assert "explode(" not in plan(grid)
    photos = defaultdict(list)
    for r in items.collect():
        photos[r.photo, r.label].append(r)
    got = {r.gate: (r.tpr, r.fpr, r.healthy_fail) for r in grid.collect()}
    for g in gates:
        hits, n, failed, well = [0, 0], [0, 0], 0, 0
        for (_, label), rows in photos.items():
            worst = max((r.rot + r.blackening if r.p >= g else 0.0) for r in rows if r.rot is not None or r.p < g)
            hits[label] += worst > 0.03
            n[label] += 1
            failed += 0 if label else sum(r.p >= g and r.fails for r in rows)
            well += 0 if label else len(rows)
        assert got[g] == (hits[1] / n[1], hits[0] / n[0], failed / well)


def test_reading_order_slices_no_photo(spark):
    rows = [("a", i, float(i * 7 % 5), float(i * 11 % 9), float(3 + i % 4) if i % 5 else None) for i in range(12)] + [("b", 0, 1.0, 2.0, None), (None, 0, 1.0, 1.0, 1.0)]
    items = spark.createDataFrame(rows, "capture_id string, pos int, x double, y double, h double")
    order = J.reading_order(items)
    assert "percentile_approx" not in plan(order)
    heights = sorted(r[4] for r in rows[:12] if r[4] is not None)
    band = lambda r: r[3] // (heights[len(heights) // 2] * 0.6)
    want = {r[1]: (int(band(r)), i + 1) for i, r in enumerate(sorted(rows[:12], key=lambda r: (band(r), r[2], r[1])))}
    assert {r.pos: (r.row, r.ord) for r in order.collect()} == want  # photos without a height have no order
    truth = spark.createDataFrame([("a", b) for b in (5, 2, 9)], "capture_id string, bulb_no int")
    pairs = J.positional_join(truth, order, "capture_id", "bulb_no", "ord")
    assert "percentile_approx" not in plan(pairs)
    assert {(r.bulb_no, r.rn, r.ord) for r in pairs.collect()} == {(2, 1, 1), (5, 2, 2), (9, 3, 3)}


@pytest.mark.parametrize("per_lot", [1, 6, 100])
def test_evidence_of_small_and_large_lots(spark, per_lot):
    caps = spark.sql("SELECT CAST(IF(id % 20 = 19, NULL, id % 3 * (id % 2)) AS BIGINT) AS lot_id, id * 17 % 40 AS shot_at, concat('c', CAST(id AS STRING)) AS capture_id FROM range(40)")
    receipts = spark.createDataFrame([(0, "h"), (1, "g"), (1, "g2"), (2, "f"), (7, "e"), (None, "d")], "lot_id long, hash string")
    bundle = S.evidence_bundle(receipts, caps, per_page=4, per_lot=per_lot)
    assert bundle.columns == ["lot_id", "hash", "page", "captures"]
    lots = defaultdict(list)
    for r in sorted(caps.collect(), key=lambda r: (r.shot_at, r.capture_id)):
        lots[r.lot_id].append(r.capture_id)
    want = [(h, p, [(p * 4 + i + 1, c) for i, c in enumerate(own[p * 4:p * 4 + 4])]) for lot, h in [(0, "h"), (1, "g"), (1, "g2"), (2, "f"), (7, "e"), (None, "d")]
            for own in [lots[lot] if lot is not None else []] for p in range(max(1, -(-len(own) // 4)))]
    assert sorted((r.hash, r.page, [(c.ord, c.capture_id) for c in r.captures]) for r in bundle.collect()) == sorted(want)


def test_captures_of_small_lots_need_no_numbers(spark):
    caps = spark.sql("SELECT id % 3 AS lot_id, id AS shot_at, concat('c', CAST(id AS STRING)) AS capture_id FROM range(40)")
    assert "percentile_approx" not in plan(S.evidence_bundle(spark.createDataFrame([(1, "g")], "lot_id long, hash string"), caps))


def test_captures_carry_only_the_fields_asked_for(spark, monkeypatch):
    """Items without a photo's id share places, which all their fields order; the others bring only what is asked for."""
    t = Tables(spark, "/nowhere")
    rows = "SELECT id % 6 AS l_orderkey, IF(id % 4 = 0, NULL, id % 3) AS l_suppkey, id * 23 % 31 AS l_partkey, CAST(id % 2 AS INT) AS l_linenumber, 1.0D + id % 5 AS l_quantity, 90.0D + id AS l_extendedprice, 0.05D AS l_discount, 0.02D AS l_tax FROM range(120)"
    t._seen["lineitem"] = spark.sql(rows).unionByName(spark.sql(rows).where("l_extendedprice < 110"))
    whole, some = (c.withColumn("bulbs", F.transform("bulbs", lambda b: b["excluded"])) for c in (measures.captures(t), measures.captures(t, "excluded")))
    key = lambda r: str(tuple(r))
    assert sorted(whole.collect(), key=key) == sorted(some.collect(), key=key) and some.where("capture_id IS NULL").count()
    nested, asked = measures._nested, []
    monkeypatch.setattr(measures, "_nested", lambda raw, body: asked.append(body) or nested(raw, body))
    QUERIES["P01_usable_bulbs"].run(t)
    assert asked[0] == ("excluded",) and len(asked) == 2


def test_a_feed_works_its_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part
    rows = spark.range(20, numPartitions=2).mapInPandas(count, "id long").selectExpr("id", "timestamp_seconds(1750000000 + id * 3600) AS at")
    sinks.feed(rows, str(tmp_path), "at")
    assert seen.value == 20 and spark.read.parquet(f"{tmp_path}/in").where("id IS NOT NULL").count() == 20


def test_items_and_actions_meet_in_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(receipts, "PAGE", 4)
    t = Tables(spark, "/nowhere")
    t._seen["lineitem"] = spark.sql("SELECT id % 40 AS l_orderkey, id * 37 % 74 AS l_partkey, IF(id = 7, NULL, id % 3) AS l_suppkey, CAST(id % 4 AS INT) AS l_linenumber, 5.0D AS l_quantity, 90.0D + id AS l_extendedprice, 0.05D AS l_discount, 0.02D AS l_tax, "
                                    "DATE '1996-01-02' AS l_shipdate FROM range(60)")
    bulbs = t("bulbs").unionByName(t("bulbs").limit(5))  # some items twice
    acts = t("overrides").unionByName(t("overrides").limit(1).withColumn("bulb_id", F.lit("gone"))).unionByName(t("overrides").limit(1).withColumn("bulb_id", F.lit(None).cast("string")))
    pages = receipts.item_pages(bulbs, acts)
    per_item = {}
    for a in acts.collect():
        per_item.setdefault((a.lot_id, a.bulb_id), []).append((a.seq, a.who, a.kind, a.to_bucket, a.reason))
    want_items = sorted((b.lot_id, b.bulb_id) for b in bulbs.collect() if b.lot_id is not None)
    want_acts = sorted((k, *[str(x) for x in a[1:]]) for k in want_items for a in per_item.get(k, []))
    got = [(int(r.cert.core.lot.id), r.cert.core) for r in pages.collect()]
    assert sorted((lot, b.id) for lot, c in got for b in c.bulbs) == want_items and len(got) > 9
    assert sorted(((lot, o.bulb), *[str(o[f]) for f in ("by", "kind", "to", "reason")]) for lot, c in got for o in c.overrides) == want_acts and want_acts
    assert all([b.id for b in c.bulbs] == sorted(b.id for b in c.bulbs) for _, c in got)
    assert "LeftOuter" not in pages._jdf.queryExecution().optimizedPlan().toString()
