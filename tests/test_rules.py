"""Rules, verdicts, human actions."""

import random

import pytest

from lotlens.operators import rules as R
from lotlens.sources import packs as P

COLS = ("lot_id long, bulb_id string, tray int, look int, size_min int, size_max int, size_sd int, blackening int, rot int, sunburn int, spots int, "
        "sprouting int, peeled int, cut int, fsd int, is_double boolean, is_bottleneck boolean, is_split boolean, conf int, w int, wsd int")


def bulb(i, **kw):
    base = dict(lot_id=1, bulb_id=f"b{i}", tray=1, look=1, size_min=550, size_max=600, size_sd=10, blackening=0, rot=0, sunburn=0, spots=0, sprouting=0,
                peeled=0, cut=None, fsd=10, is_double=False, is_bottleneck=False, is_split=False, conf=900, w=900, wsd=150)
    return tuple({**base, **kw}.values())


def verdicts(spark, rows, pack):
    df = spark.createDataFrame(rows, COLS)
    return {r.bulb_id: r for r in R.adjudicate(df, [pack], ("bulb_id",)).collect()}


def test_reasons_and_buckets(spark):
    pack = P.default_pack()
    v = verdicts(spark, [bulb(0), bulb(1, conf=599), bulb(2, rot=342), bulb(3, size_min=413, size_max=420), bulb(4, size_min=448), bulb(5, is_split=True),
                         bulb(6, blackening=200), bulb(7, sprouting=300, rot=400)], pack)
    assert v["b0"].bucket == "GRADE_A" and v["b0"].codes == [] and v["b0"].notes == ["NOT_ASSESSED_CUT"]
    assert v["b1"].codes == ["LOW_CONFIDENCE_599_LT_600"] and v["b1"].notes == []
    assert v["b2"].bucket == "REJECT" and v["b2"].codes == ["ROT_34.2PCT_GT_1PCT"]
    assert v["b3"].bucket == "URS" and v["b3"].codes == ["SIZE_41.3MM_LT_45MM"]
    assert v["b4"].bucket == "REFER" and v["b4"].codes == ["BORDERLINE_SIZE_44.8MM_LT_45MM"]
    assert v["b5"].bucket == "REJECT" and v["b5"].codes == ["SPLIT_YES_NE_NO"]
    assert v["b6"].bucket == "URS"
    assert v["b7"].codes == ["ROT_40PCT_GT_1PCT", "SPROUTING_30PCT_GT_1PCT"]


def test_not_assessed_can_refer(spark):
    base = P.default_pack()
    strict = P.Pack("strict", "2026-01-01", None, base.buckets, base.procured, base.bad, (P.Rule("cut", "<=", 20, "refer"),))
    v = verdicts(spark, [bulb(0), bulb(1, cut=0)], strict)
    assert v["b0"].bucket == "REFER" and v["b0"].codes == ["NOT_ASSESSED_CUT"]
    assert v["b1"].bucket == "GRADE_A"


@pytest.mark.parametrize("op,limit,value,expected", [("<", 100, 99, "GRADE_A"), ("<", 100, 100, "REJECT"), (">", 100, 101, "GRADE_A"), (">", 100, 100, "REJECT"),
                                                      (">=", 100, 100, "GRADE_A"), ("==", 100, 100, "GRADE_A"), ("==", 100, 101, "REJECT")])
def test_every_operator(spark, op, limit, value, expected):
    pack = P.Pack("t", "2026-01-01", None, (P.Bucket("GRADE_A", "A", (P.Rule("size", op, limit),)),), ("GRADE_A",), ("REJECT",), (), k_sigma=0.0)
    df = spark.createDataFrame([bulb(0, size_min=value, size_sd=1)], COLS)
    assert R.bucket_verdicts(df, [pack]).first().bucket == expected


def test_worse_is_never_better(spark):
    """Raising a defect never moves an item to a better bucket, under any pack."""
    rng, rank = random.Random(3), {"GRADE_A": 0, "URS": 1, "REFER": 1, "REJECT": 2}
    rows = []
    for i in range(60):
        m = rng.choice(["blackening", "rot", "sunburn", "spots", "sprouting", "peeled"])
        low = rng.randint(0, 300)
        size = rng.randint(350, 749)
        for k, v in (("lo", low), ("hi", low + rng.randint(200, 600))):
            rows.append(bulb(f"{i}-{k}", size_min=size, size_max=size + 5, **{m: v}))
    got = R.bucket_verdicts(spark.createDataFrame(rows, COLS), P.PACKS, ("bulb_id",)).collect()
    table = {(r.bulb_id, r.pack_id): r.bucket for r in got}
    for i in range(60):
        for p in P.PACKS:
            lo, hi = table[(f"b{i}-lo", p.id)], table[(f"b{i}-hi", p.id)]
            if "REFER" not in (lo, hi):
                assert rank[hi] >= rank[lo], (i, p.id, lo, hi)


def test_last_action_in_order_wins(spark):
    v = spark.createDataFrame([(1, "b0", "REJECT"), (1, "b1", "GRADE_A"), (1, "b2", "URS")], "lot_id long, bulb_id string, bucket string")
    o = spark.createDataFrame([(1, "b0", "officer", "override", "GRADE_A", "X", 0), (1, "b0", "farmer", "contest", None, "Y", 1), (1, "b1", "officer", "override", None, "Z", 0)],
                              "lot_id long, bulb_id string, who string, kind string, to_bucket string, reason string, seq long")
    got = {r.bulb_id: (r.ai, r.final, r.actor) for r in R.apply_overrides(v, o).collect()}
    assert got == {"b0": ("REJECT", "REFER", "farmer:contest:Y"), "b1": ("GRADE_A", "GRADE_A", "officer:override:Z"), "b2": ("URS", "URS", None)}


def test_pack_documents_round_trip(spark, tmp_path):
    import json
    for p in P.PACKS:
        (tmp_path / f"{p.id}.json").write_text(json.dumps(P.pack_document(p)))
    packs = P.read_rule_packs(spark, str(tmp_path))
    assert packs.count() == 5
    want = {tuple(r) for r in P.pack_rules_table(spark).collect()}
    cols = ("pack_id", "stage", "bucket", "rule_ord", "measure", "op", "lim", "na")
    assert {tuple(r) for r in P.explode_pack_rules(packs).select(*cols).collect()} == want
    docs = [P.pack_document(p) for p in P.PACKS]
    assert P.packs_from_documents(docs) == P.PACKS


def test_plan_has_one_shuffle(spark):
    """Five packs in one pass: no join, one exchange for the tallies."""
    from lotlens.plans.grade import graded_looks
    plan = graded_looks(spark.createDataFrame([bulb(0)], COLS), P.PACKS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_verdicts_from_outcomes_shuffle_a_row_per_item(spark):
    """Outcomes meet as bits; without the rule table, with repeated items and with more slots than one number holds."""
    outcomes = [(lot, f"b{lot}", f"p{p}", stage, None if stage == 0 else f"B{stage}", na, o) for lot in (1, 2) for p in range(9) for stage, na, o in (
        (0, "skip", "pass"), (0, "refer", "na" if p == 8 else "pass"), (1, "skip", "fail" if p % 3 else "na"), (2, "skip", "borderline" if p == 4 else "fail" if p == 5 else "pass"))]
    outcomes.append((1, "b1", "p7", 0, None, "skip", "fail"))
    df = spark.createDataFrame(outcomes, "lot_id long, bulb_id string, pack_id string, stage int, bucket string, na string, outcome string")
    bulbs = spark.createDataFrame([(1, "b1", 900), (2, "b2", 900), (2, "b2", 100), (3, "b3", 900)], "lot_id long, bulb_id string, conf int")
    packs = spark.createDataFrame([(f"p{p}", 500) for p in range(10)], "pack_id string, min_conf int")

    def want(lot, p):
        return "REJECT" if p == 7 and lot == 1 else "REFER" if p in (8, 4) else "B1" if p % 3 == 0 else "REJECT" if p == 5 else "B2"
    expected = sorted([(lot, f"b{lot}", f"p{p}", want(lot, p)) for lot in (1, 2) for p in range(9)] + [(2, "b2", f"p{p}", "REFER") for p in range(9)])
    for rules in (None, df.select("pack_id", "stage", "bucket", "na").distinct()):
        v = R.verdicts_from_outcomes(df, bulbs, packs, rules)
        assert sorted(tuple(r) for r in v.collect()) == expected
        plan = v._jdf.queryExecution().optimizedPlan().toString()
        assert not any(line.strip(" :+-").startswith("Aggregate") and "[lot_id" in line and "pack_id" in line for line in plan.splitlines())
