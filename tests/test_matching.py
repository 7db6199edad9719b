"""Matching of boxes and centres against brute force; receipts that are none."""

import json
import math
import random

from pyspark.sql import functions as F

from lotlens.operators import joins as J
from lotlens.sources import files as S


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def test_greedy_match_equals_the_ordered_pick(spark):
    rng = random.Random(5)
    truth, predicted = [], []
    for image in (1, 2, 3):
        for i in range(8 if image < 3 else 60):  # the last image holds most boxes
            x, y = rng.randint(0, 12) / 16, rng.randint(0, 12) / 16
            truth.append((image, i % 2, f"g{image}-{i:02}", x, y, x + 0.25, y + 0.25))
            for k in range(rng.randint(0, 4)):
                dx, dy = rng.randint(-2, 2) / 32, rng.randint(-2, 2) / 32
                predicted.append((image, i % 2, f"p{image}-{i:02}-{k}", rng.choice([0.5, 0.5, 0.75, 0.9, None]), x + dx, y + dy, x + dx + 0.25, y + dy + 0.25))
    names = "x0 double, y0 double, x1 double, y1 double"
    p = spark.createDataFrame(predicted, "image_id int, cls int, pred_id string, conf double, " + names)
    g = spark.createDataFrame(truth, "image_id int, cls int, gt_id string, " + names)
    want, taken = {}, set()
    for image, cls, pid, _, *box in sorted(predicted, key=lambda r: (r[3] is None, -(r[3] or 0), r[2])):
        fits = sorted((-overlap(box, b), gid) for im, c, gid, *b in truth if (im, c) == (image, cls) and gid not in taken and overlap(box, b) >= 0.5)
        want[pid] = fits[0][1] if fits else None
        taken.add(want[pid])
    assert {r.pred_id: r.gt_id for r in J.greedy_match(p, g).collect()} == want and sum(v is not None for v in want.values()) > 20
    assert J.greedy_match(p, g.limit(0)).where("correct = 1").count() == 0 and J.greedy_match(p.limit(0), g).count() == 0


def test_nearest_centre_meets_neighbouring_cells_only(spark):
    rng = random.Random(6)
    queries = [(i % 2, i, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 0.01, 1.0, 3.0, 40.0, 1e6, None])) for i in range(80)]
    targets = [(i % 2, i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)] + [(q[0], 900 + q[1], q[2], q[3]) for q in queries[:5]] + [(q[0], 800 + q[1], q[2], q[3]) for q in queries[:5]]
    q = spark.createDataFrame(queries, "image_id int, q_id int, q_x double, q_y double, far double")
    t = spark.createDataFrame(targets, "image_id int, t_id int, t_x double, t_y double")
    want = {}
    for image, qid, x, y, far in queries:
        near = min(((math.hypot(x - tx, y - ty), tid) for im, tid, tx, ty in targets if im == image), default=None)
        if far is not None and near[0] <= far:
            want[qid] = near[1]
    assert {r.q_id: r.t_id for r in J.nearest_centre(q, t, F.col("far")).collect()} == want and len(want) > 20


def test_nearest_centre_at_exactly_the_cap(spark):
    """Targets on cell borders at the cap's distance are met, by a query that goes to four cells at most."""
    queries = [(0, i, 8.0 * (i % 9) - 32, 8.0 * (i // 9) - 32, 2.0 ** (i % 3)) for i in range(81)]
    targets = [(0, 4 * q[1] + k, q[2] + dx * q[4], q[3] + dy * q[4]) for q in queries for k, (dx, dy) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    q = spark.createDataFrame(queries, "image_id int, q_id int, q_x double, q_y double, far double")
    t = spark.createDataFrame(targets, "image_id int, t_id int, t_x double, t_y double")
    for k in range(4):
        near = J.nearest_centre(q, t.where(f"t_id % 4 = {k}"), F.col("far"))
        assert near.where("dist <= far").count() == 81
    assert "[-1,0,1]" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_broken_receipts_are_set_aside(spark, tmp_path):
    good = {"kind": "bundle", "cert": {"hash": "aa", "core": {"lot": {"id": "L1"}, "rev": 2}}}
    texts = {"good": json.dumps(good, indent=1), "cut": json.dumps(good)[:-7], "type": json.dumps(good).replace('"rev": 2', '"rev": "two"'), "none": "{}", "list": "[1, 2]", "text": "hello"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    kept, left = S.checked_receipts(spark, str(tmp_path))
    assert [r.cert.core.rev for r in kept.collect()] == [2]
    got = {r.file.rsplit("/", 1)[1]: r.reason for r in left.collect()}
    assert got["cut.json"] == got["text.json"] == "not JSON" and got["type.json"] == "wrong type" and got["none.json"] == "no receipt" and "list.json" in got


def odd_boxes(rng):
    """Rows of four images, some twice, some with nulls."""
    box = lambda: [v if rng.random() < 0.97 else None for v in (lambda x, y: (x, y, x + 0.25, y + 0.25))(rng.randint(0, 9) / 16, rng.randint(0, 9) / 16)]
    key = lambda: (rng.choice([1, 1, 2, 3, 4, None]), rng.choice([0, 1, 1, None]))
    truth = [(*key(), f"g{i}", *box()) for i in range(90)]
    predicted = [(*key(), f"p{i}", rng.choice([0.5, 0.75, None, 0.9]), *box()) for i in range(120)]
    return predicted + predicted[::5], truth + truth[::4]


def test_small_images_are_matched_as_crowded_ones(spark, monkeypatch):
    predicted, truth = odd_boxes(random.Random(8))
    names = "x0 double, y0 double, x1 double, y1 double"
    p = spark.createDataFrame(predicted, "image_id int, cls int, pred_id string, conf double, " + names)
    g = spark.createDataFrame(truth, "image_id int, cls int, gt_id string, " + names)
    key = lambda r: tuple((v is None, v) for v in r)
    found = {}
    for most in (0, 60, 512):  # all, some, none by joins on cells
        monkeypatch.setattr(J, "IMAGE_BOXES", most)
        m = J.greedy_match(p, g)
        found[most] = sorted(m.collect(), key=key)
    assert found[0] == found[60] == found[512] and len(found[0]) == len(predicted) and sum(r.correct for r in found[0]) > 10
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1


def test_nearest_centre_of_small_images_needs_no_join(spark, monkeypatch):
    rng = random.Random(9)
    some = lambda v: v if rng.random() < 0.95 else None
    queries = [(rng.choice([1, 1, 2, 3, None]), i, some(rng.uniform(0, 9)), some(rng.uniform(0, 9)), some(1.5), i % 3) for i in range(80)]
    targets = [(rng.choice([1, 1, 2, 4, None]), i % 100, some(rng.uniform(0, 9)), some(rng.uniform(0, 9))) for i in range(120)]
    q = spark.createDataFrame(queries + queries[::6], "image_id int, q_id int, q_x double, q_y double, far double, kind int")
    t = spark.createDataFrame(targets + targets[::5], "image_id int, t_id int, t_x double, t_y double")
    found = {}
    for most in (0, 60, 512):  # all, some, none by joins on cells
        monkeypatch.setattr(J, "IMAGE_BOXES", most)
        near = J.nearest_centre(q, t, F.col("far"))
        found[most] = sorted(map(tuple, near.collect()))
    assert found[0] == found[60] == found[512] and len(found[0]) > 20
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1
