"""Rule evaluation and verdicts.

Two forms: packs compiled into CASE expressions (no shuffle, whole-stage codegen; the default), and a rule
table joined to unpivoted measures (for many packs, or packs kept as data).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import half_up
from lotlens.sources.packs import DEFECTS, SHAPES, Pack, Rule

# Measures of the flat bulb table; shapes are boolean columns.
SHAPE_COLUMNS = {"double": "is_double", "bottleneck": "is_bottleneck", "split": "is_split"}
OP_WORD = {"<=": "GT", "<": "GE", ">=": "LT", ">": "LE", "==": "NE"}


def size_of(metric: str | Column) -> Column:
    """The size a pack judges: least, greatest or half-up mean diameter."""
    mean = half_up((F.col("size_min") + F.col("size_max")) / 2.0).cast("int")
    if isinstance(metric, str):
        return {"min_feret": F.col("size_min"), "max_feret": F.col("size_max")}.get(metric, mean)
    return (F.when(metric == "min_feret", F.col("size_min")).when(metric == "max_feret", F.col("size_max"))
            .otherwise(mean))


def fraction_sd(value: Column, fsd: Column) -> Column:
    """Uncertainty of a per-mille share: widest at one half, zero at the ends."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / 1000.0))
    return fsd * 2.0 * F.sqrt(p * (F.lit(1.0) - p))


def _margin_name(m: str, pack: Pack) -> str:
    return f"_m_{m}_{round(pack.k_sigma * 1000)}"


def _value_name(m: str, pack: Pack) -> str:
    return f"_v_size_{pack.size_metric}" if m == "size" else f"_v_{m}"


_SIZE_SQL = {"min_feret": "size_min", "max_feret": "size_max",
             "mean_feret": "CAST(floor((size_min + size_max) / 2.0D + 0.5D) AS INT)"}


def with_margins(bulbs: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Add, once per bulb, the integer values and k-sigma margins that the compiled rules compare."""
    extra: dict[str, str] = {}
    for p in packs:
        for _, _, rules in p.stages():
            for r in rules:
                v = _value_name(r.measure, p)
                if r.measure in SHAPES:
                    extra[v] = f"CAST({SHAPE_COLUMNS[r.measure]} AS INT)"
                    continue
                if r.measure == "size":
                    extra[v], sd = f"CAST({_SIZE_SQL[p.size_metric]} AS INT)", "size_sd"
                else:
                    share = f"least(1.0D, greatest(0.0D, {r.measure} / 1000.0D))"
                    extra[v], sd = f"CAST({r.measure} AS INT)", f"fsd * 2.0D * sqrt({share} * (1.0D - {share}))"
                extra[_margin_name(r.measure, p)] = f"CAST(floor({sd} * {p.k_sigma}D + 0.5D) AS INT)"
    return bulbs.selectExpr("*", *[f"{e} AS {n}" for n, e in extra.items()])


class Outcome:
    """Conditions of one compiled rule, as SQL text over the columns of ``with_margins``.

    A rule passes only if it holds at both ends of value +/- margin and fails only if it holds at neither; with one
    ordered comparison that is a single test against the far or the near end.
    """

    def __init__(self, rule: Rule, pack: Pack):
        v = _value_name(rule.measure, pack)
        exact = rule.op == "==" or rule.measure in SHAPES
        m = "" if exact else _margin_name(rule.measure, pack)
        low, high, lim = (v, v, rule.limit) if exact else (f"{v} - {m}", f"{v} + {m}", rule.limit)
        self.rule, self.value, self.missing = rule, v, f"{v} IS NULL"
        passed, fail = {
            "<=": (f"{high} <= {lim}", f"{low} > {lim}"), "<": (f"{high} < {lim}", f"{low} >= {lim}"),
            ">=": (f"{low} >= {lim}", f"{high} < {lim}"), ">": (f"{low} > {lim}", f"{high} <= {lim}"),
            "==": (f"{v} = {lim}", f"{v} <> {lim}"),
        }[rule.op]
        self.fail = f"({v} IS NOT NULL AND {fail})"
        self.border = f"({v} IS NOT NULL AND NOT ({passed}) AND NOT ({fail}))"
        self.refers = f"({self.border} OR {self.missing})" if rule.na == "refer" else self.border

    def shown(self, x: str) -> str:
        m = self.rule.measure
        if m in SHAPES:
            return f"IF({x} <> 0, 'YES', 'NO')"
        unit = "MM" if m == "size" else "PCT"
        return f"concat({x} DIV 10, IF({x} % 10 = 0, '', concat('.', {x} % 10)), '{unit}')"

    def code(self, borderline: bool = False) -> str:
        """Machine-readable reason, e.g. SIZE_41.3MM_LT_45MM; whole numbers print without decimals."""
        lead = "BORDERLINE_" if borderline else ""
        return (f"concat('{lead}{self.rule.measure.upper()}_', {self.shown(self.value)}, '_{OP_WORD[self.rule.op]}_', "
                f"{self.shown(str(self.rule.limit))})")

    def note(self) -> str:
        return f"'NOT_ASSESSED_{self.rule.measure.upper()}'"


def _any(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions or ["false"]) + ")"


def _stage_name(rules: Sequence[Rule], pack: Pack) -> str:
    """Column holding the status of a rule list; packs that share a list share the column."""
    body = "|".join(f"{r.measure}{r.op}{r.limit}{r.na}" for r in rules) + f"|{pack.size_metric}|{pack.k_sigma}"
    return "_s_" + hashlib.md5(body.encode()).hexdigest()[:10]


def with_stages(bulbs: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Add one status per distinct rule list: 2 some rule fails, 1 none fails but some is borderline, 0 all pass.

    Rules and lists shared between packs are evaluated once per bulb, which also keeps the generated code small.
    """
    rules: dict[str, str] = {}
    stages: dict[str, str] = {}
    for p in packs:
        for _, _, specs in p.stages():
            names = []
            for r in specs:
                o = Outcome(r, p)
                name = "_o_" + hashlib.md5((o.fail + o.refers).encode()).hexdigest()[:10]
                rules[name] = f"CASE WHEN {o.fail} THEN 2 WHEN {o.refers} THEN 1 ELSE 0 END"
                names.append(name)
            stages[_stage_name(specs, p)] = (f"greatest({', '.join(names)})" if len(names) > 1 else (names or ["0"])[0])
    base = with_margins(bulbs, packs).selectExpr(*bulbs.columns, *[f"{e} AS {n}" for n, e in rules.items()])
    return base.selectExpr(*bulbs.columns, *[f"{e} AS {n}" for n, e in stages.items()])


def bucket_case(pack: Pack) -> str:
    """One pack compiled to a CASE giving the bucket of a bulb (needs the columns of ``with_stages``)."""
    reject = _stage_name(pack.reject_rules, pack)
    whens = [f"WHEN conf < {pack.min_conf} THEN 'REFER'", f"WHEN {reject} = 2 THEN 'REJECT'", f"WHEN {reject} = 1 THEN 'REFER'"]
    for b in pack.buckets:
        s = _stage_name(b.rules, pack)
        whens += [f"WHEN {s} = 0 THEN '{b.id}'", f"WHEN {s} = 1 THEN 'REFER'"]
    return f"CASE {' '.join(whens)} ELSE 'REJECT' END"


_EMPTY = "CAST(array() AS ARRAY<STRING>)"


def _texts(pairs: list[tuple[str, str]]) -> str:
    return f"array_compact(array({', '.join(f'IF({c}, {t}, NULL)' for c, t in pairs)}))" if pairs else _EMPTY


def with_reasons(bulbs: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Add, per distinct rule list, its status and the reason texts behind it.

    The texts are built once per list however many packs use it, and only for items that fail or refer on it.
    """
    lists: dict[str, tuple[Sequence[Rule], Pack]] = {}
    for p in packs:
        for _, _, specs in p.stages():
            lists.setdefault(_stage_name(specs, p), (specs, p))
    status, texts = {}, {}
    for name, (specs, p) in lists.items():
        os_ = [Outcome(r, p) for r in specs]
        fails = " OR ".join(o.fail for o in os_) or "false"
        refers = " OR ".join(o.refers for o in os_) or "false"
        missing = " OR ".join(o.missing for o in os_) or "false"
        status[name] = f"CASE WHEN {fails} THEN 2 WHEN {refers} THEN 1 ELSE 0 END"
        borders = [(o.refers, f"IF({o.missing}, {o.note()}, {o.code(True)})" if o.rule.na == "refer" else o.code(True)) for o in os_]
        texts[f"{name}_f"] = f"IF({name} = 2, {_texts([(o.fail, o.code()) for o in os_])}, {_EMPTY})"
        texts[f"{name}_b"] = f"IF({name} = 1, {_texts(borders)}, {_EMPTY})"
        texts[f"{name}_n"] = f"IF({missing}, {_texts([(o.missing, o.note()) for o in os_])}, {_EMPTY})"
    base = with_margins(bulbs, packs).selectExpr("*", *[f"{e} AS {n}" for n, e in status.items()])
    return base.selectExpr(*bulbs.columns, *status, *[f"{e} AS {n}" for n, e in texts.items()])


def verdict_struct(pack: Pack) -> str:
    """bucket, codes and notes of a bulb under one pack (needs the columns of ``with_reasons``).

    Codes follow the deciding stage; notes accumulate over every stage that was looked at.
    """
    row = lambda bucket, codes, notes: f"named_struct('bucket', '{bucket}', 'codes', {codes}, 'notes', {notes})"
    joined = lambda xs: _EMPTY if not xs else xs[0] if len(xs) == 1 else f"concat({', '.join(xs)})"
    notes = lambda xs: f"array_distinct({joined(xs)})"
    low = f"array(concat('LOW_CONFIDENCE_', conf, '_LT_{pack.min_conf}'))"
    s = _stage_name(pack.reject_rules, pack)
    whens = [f"WHEN conf < {pack.min_conf} THEN {row('REFER', low, _EMPTY)}", f"WHEN {s} = 2 THEN {row('REJECT', s + '_f', notes([s + '_n']))}",
             f"WHEN {s} = 1 THEN {row('REFER', s + '_b', notes([s + '_n']))}"]
    why, seen = [], [s + "_n"]
    for b in pack.buckets:
        s = _stage_name(b.rules, pack)
        seen = [*seen, s + "_n"]
        whens += [f"WHEN {s} = 0 THEN {row(b.id, joined(why), notes(seen))}", f"WHEN {s} = 1 THEN {row('REFER', joined([*why, s + '_b']), notes(seen))}"]
        why = [*why, s + "_f"]
    return f"CASE {' '.join(whens)} ELSE {row('REJECT', f'array_distinct({joined(why)})', notes(seen))} END"


def _per_pack(bulbs: DataFrame, packs: Sequence[Pack], keep: Sequence[str], value) -> DataFrame:
    """One row per bulb and pack with ``value(pack)``. One scan, no join, no shuffle."""
    rows = ", ".join(f"named_struct('pack_id', '{p.id}', 'v', {value(p)})" for p in packs)
    return bulbs.selectExpr(*keep, f"explode(array({rows})) AS _v")


def bucket_verdicts(bulbs: DataFrame, packs: Sequence[Pack],
                    keep: Sequence[str] = ("lot_id", "bulb_id", "tray", "look", "w")) -> DataFrame:
    """Bucket of each bulb under each pack: keep..., pack_id, bucket."""
    return _per_pack(with_stages(bulbs, packs), packs, keep, bucket_case).selectExpr(*keep, "_v.pack_id", "_v.v AS bucket")


def adjudicate(bulbs: DataFrame, packs: Sequence[Pack], keep: Sequence[str] = ("lot_id", "bulb_id")) -> DataFrame:
    """Bucket with its reasons of each bulb under each pack: keep..., pack_id, bucket, codes, notes."""
    return _per_pack(with_reasons(bulbs, packs), packs, keep, verdict_struct).selectExpr(*keep, "_v.pack_id", "_v.v.*")


# ---- rule-table form -----------------------------------------------------------------------------------

def unpivot_measures(bulbs: DataFrame, keep: Sequence[str] = ("lot_id", "bulb_id")) -> DataFrame:
    """One row per bulb and measure. Sizes appear once per metric under the names size:<metric>."""
    rows = [F.struct(F.lit(f"size:{m}").alias("measure"), size_of(m).cast("int").alias("value"),
                     F.col("size_sd").cast("double").alias("sd"))
            for m in ("min_feret", "max_feret", "mean_feret")]
    for m in DEFECTS:
        rows.append(F.struct(F.lit(m).alias("measure"), F.col(m).cast("int").alias("value"),
                             F.coalesce(fraction_sd(F.col(m), F.col("fsd")), F.lit(0.0)).alias("sd")))
    for m in SHAPES:
        rows.append(F.struct(F.lit(m).alias("measure"), F.col(SHAPE_COLUMNS[m]).cast("int").alias("value"),
                             F.lit(0.0).alias("sd")))
    return bulbs.select(*keep, F.explode(F.array(*rows)).alias("_m")).select(*keep, "_m.*")


def eval_rules(bulbs: DataFrame, pack_rules: DataFrame, packs: DataFrame,
               keep: Sequence[str] = ("lot_id", "bulb_id")) -> DataFrame:
    """Outcome (pass / fail / borderline / na) of every rule for every bulb, by joining measures to rules."""
    rules = pack_rules.join(packs.select("pack_id", "size_metric", "k_sigma"), "pack_id").withColumn(
        "measure_key", F.when(F.col("measure") == "size", F.concat(F.lit("size:"), "size_metric"))
        .otherwise(F.col("measure")))
    m = unpivot_measures(bulbs, keep).withColumnRenamed("measure", "measure_key")
    j = m.join(rules, "measure_key")
    margin = F.when(F.col("op") == "==", F.lit(0)).otherwise(half_up(F.col("sd") * F.col("k_sigma")).cast("int"))
    ok = lambda v: (F.when(F.col("op") == "<=", v <= F.col("lim")).when(F.col("op") == "<", v < F.col("lim"))
                    .when(F.col("op") == ">=", v >= F.col("lim")).when(F.col("op") == ">", v > F.col("lim"))
                    .otherwise(v == F.col("lim")))
    j = j.withColumn("margin", margin)
    low, high = ok(F.col("value") - F.col("margin")), ok(F.col("value") + F.col("margin"))
    outcome = (F.when(F.col("value").isNull(), "na").when(low & high, "pass").when(~low & ~high, "fail")
               .otherwise("borderline"))
    return j.select(*keep, "pack_id", "stage", "bucket", "rule_ord", "measure", "op", "lim", "na", "value", "margin",
                    outcome.alias("outcome"))


#: Bits of a (pack, stage, bucket): some outcome, some failed, some referred; and how many such slots a whole number holds.
SEEN, FAILED, REFERS, SLOTS = 1, 2, 4, 21


def verdicts_from_outcomes(outcomes: DataFrame, bulbs: DataFrame, packs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Bucket per bulb and pack from a rule-outcome table: the first deciding stage wins.

    A bulb's outcomes under all packs meet as bits of a whole number (more for many packs), so one short row per bulb is
    shuffled however many rules there are. ``rules``, the table behind the outcomes, saves looking its stages up in them.
    """
    key = ["lot_id", "bulb_id", "pack_id"]
    source = outcomes if rules is None else rules
    kinds = [tuple(r) for r in source.select("pack_id", "stage", "bucket", "na").distinct().collect() if r.pack_id is not None]  # configuration, a few rows per pack
    slots = sorted({k[:3] for k in kinds}, key=lambda s: tuple((v is not None, v) for v in s))
    slots = [(*s, i) for i, s in enumerate(slots)]
    place = {s[:3]: s[3] for s in slots}
    # One lookup gives an outcome's bits; a reference to the outcome's expression in each of several conditions would evaluate it as often.
    bits = lambda o, na: SEEN | (FAILED if o == "fail" else REFERS if o == "borderline" or (o == "na" and na == "refer") else 0)
    table = [(*k, o, place[k[:3]] // SLOTS, bits(o, k[3]) << 3 * (place[k[:3]] % SLOTS)) for k in kinds for o in ("pass", "fail", "borderline", "na")]
    lookup = ("pack_id", "stage", "bucket", "na")
    lit = lambda c, v: F.lit(v).cast(source.schema[c].dataType)
    names = ("m_outcome", "word", "bits")
    rows = [F.struct(*[lit(c, v).alias(f"m_{c}") for c, v in zip(lookup, row)], *[F.lit(v).cast(kind).alias(c) for c, v, kind in zip(names, row[len(lookup):], ("string", "int", "bigint"), strict=True)]) for row in table]
    marks = source.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("m")).select("m.*") if rows else None
    same = (F.col("outcome") == F.col("m_outcome")) & (F.col("pack_id") == F.col("m_pack_id"))
    for c in lookup[1:]:
        whole = all(k[lookup.index(c)] is not None for k in kinds)
        same = same & (F.col(c) == F.col(f"m_{c}") if whole else F.col(c).eqNullSafe(F.col(f"m_{c}")))
    if marks is None:
        return outcomes.limit(0).select(*key, "bucket")
    placed = outcomes.select(*key, "stage", "bucket", "na", "outcome").join(marks, same)
    words = placed.groupBy("lot_id", "bulb_id").agg(F.array(*[F.expr(f"bit_or(IF(word = {w}, bits, 0L))") for w in range(-(-len(slots) // SLOTS))]).alias("words"))
    by_pack = F.array(*[F.struct(lit("pack_id", pack).alias("pack_id"), F.array(*[F.struct(lit("stage", stage).alias("stage"), lit("bucket", bucket).alias("bucket"), F.lit(i).alias("place"))
                        for p, stage, bucket, i in slots if p == pack]).alias("slots")) for pack in {s[0]: None for s in slots}])
    found = words.join(bulbs.select("lot_id", "bulb_id", "conf"), ["lot_id", "bulb_id"])
    found = found.select("*", F.explode(by_pack).alias("p")).select("lot_id", "bulb_id", "conf", "words", "p.*")
    marked = f"filter(transform(slots, s -> named_struct('stage', s.stage, 'bucket', s.bucket, 'b', shiftright(words[s.place DIV {SLOTS}], 3 * (s.place % {SLOTS})))), s -> s.b & {SEEN} <> 0)"
    decided = f"""transform(marked, s -> named_struct('stage', s.stage, 'decided', CASE WHEN s.stage = 0 AND s.b & {FAILED} <> 0 THEN 'REJECT' WHEN s.stage = 0 AND s.b & {REFERS} <> 0 THEN 'REFER'
      WHEN s.stage > 0 AND s.b & {FAILED} = 0 AND s.b & {REFERS} <> 0 THEN 'REFER' WHEN s.stage > 0 AND s.b & {FAILED} = 0 THEN s.bucket END))"""
    found = found.withColumn("marked", F.expr(marked)).where(F.size("marked") > 0)
    first = found.select(*key, "conf", F.expr(f"array_min(filter({decided}, s -> s.decided IS NOT NULL))").alias("d"))
    return (first.join(packs.select("pack_id", "min_conf"), "pack_id")
            .select(*key, F.when(F.col("conf") < F.col("min_conf"), "REFER")
                    .otherwise(F.coalesce("d.decided", F.lit("REJECT"))).alias("bucket")))


# ---- human actions -------------------------------------------------------------------------------------

def latest_actions(overrides: DataFrame) -> DataFrame:
    """The last recorded action per bulb, by sequence number and not by time."""
    return (overrides.groupBy("lot_id", "bulb_id")
            .agg(F.max_by(F.struct("kind", "who", "to_bucket", "reason"), "seq").alias("act"))
            .select("lot_id", "bulb_id", "act.*"))


def final_bucket(ai: Column) -> Column:
    """Bucket after the latest action (columns kind, to_bucket); the AI bucket itself is kept beside it."""
    return (F.when(F.col("kind").isNull(), ai).when(F.col("kind") == "contest", "REFER")
            .otherwise(F.coalesce(F.col("to_bucket"), ai)))


def apply_overrides(verdicts: DataFrame, overrides: DataFrame) -> DataFrame:
    """verdict rows plus ai, final and actor ("who:kind:reason", NULL when untouched)."""
    joined = verdicts.join(latest_actions(overrides), ["lot_id", "bulb_id"], "left")
    actor = F.when(F.col("kind").isNotNull(), F.concat_ws(":", "who", "kind", "reason"))
    return (joined.withColumn("final", final_bucket(F.col("bucket"))).withColumn("actor", actor)
            .withColumnRenamed("bucket", "ai").drop("kind", "who", "to_bucket", "reason"))


def verdict_changes(bulbs: DataFrame, packs: Sequence[Pack], overrides: DataFrame) -> DataFrame:
    """Signed corrections to AI tallies: -1 for the AI bucket and +1 for the final one, overridden bulbs only.

    The join is inner and starts from the small action table, so a runtime filter trims the bulb scan before
    it is shuffled; bulbs nobody touched never move.
    """
    touched = bulbs.join(latest_actions(overrides), ["lot_id", "bulb_id"])
    graded = bucket_verdicts(touched, packs, ("lot_id", "bulb_id", "tray", "look", "w", "kind", "to_bucket"))
    final = final_bucket(F.col("bucket"))
    pair = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(-1).alias("k")),
                   F.struct(final.alias("bucket"), F.lit(1).alias("k")))
    return (graded.where(final != F.col("bucket")).select("lot_id", "bulb_id", "tray", "look", "w", "pack_id",
                                                          F.explode(pair).alias("_c"))
            .select("lot_id", "tray", "look", "w", "pack_id", "_c.bucket", "_c.k"))


# ---- pack lookups --------------------------------------------------------------------------------------

def pack_in_force(lots: DataFrame, packs: Sequence[Pack], purchase_date: str = "purchase_date") -> DataFrame:
    """Every pack variant whose effective dates contain the purchase date (ISO text); one row per match."""
    rows = F.array(*[F.struct(F.lit(p.id).alias("pack_id"), F.lit(p.effective_from).alias("effective_from"),
                              F.lit(p.effective_to).cast("string").alias("effective_to")) for p in packs])
    day = F.date_format(F.col(purchase_date), "yyyy-MM-dd")
    live = F.filter(rows, lambda p: (p["effective_from"] <= day)
                    & (day <= F.coalesce(p["effective_to"], F.lit("9999-12-31"))))
    keep = [c for c in lots.columns if c != "pack_id"]
    return lots.select(*keep, F.explode(live).alias("_p")).select(*keep, "_p.pack_id")


def pack_limits(pack_rules: DataFrame) -> DataFrame:
    """Displayed limit per pack and defect: the strictest bucket wins, reject rules fill the gaps."""
    defects = pack_rules.where(F.col("measure").isin(*DEFECTS))
    # Bucket rules outrank reject rules; the earliest bucket and, inside it, the last rule wins.
    priority = F.struct((F.col("stage") > 0).cast("int"), -F.col("stage"),
                        F.when(F.col("stage") > 0, F.col("rule_ord")).otherwise(-F.col("rule_ord")))
    return defects.groupBy("pack_id", "measure").agg(F.max_by("lim", priority).alias("lim"))


def stale_receipts(lots: DataFrame, latest: DataFrame) -> DataFrame:
    """Lots whose receipt is missing or no longer matches: lots(lot_id, pack_id, n_actions) vs latest receipts."""
    r = latest.select("lot_id", F.col("pack_id").alias("receipt_pack"), F.col("n_actions").alias("receipt_actions"))
    j = lots.join(r, "lot_id", "left")
    stale = (F.col("receipt_pack").isNull() | (F.col("receipt_actions") != F.col("n_actions"))
             | (F.col("receipt_pack") != F.col("pack_id")))
    return j.withColumn("stale", stale)


# Which role may do what.
ROLE_ACTIONS = {
    "supervisor": ("lot.create", "bulb.override", "bulb.contest", "cert.sign", "pack.change", "users.manage",
                   "settings.edit", "fleet.view", "log.export"),
    "officer": ("lot.create", "bulb.override", "bulb.contest", "cert.sign"),
    "auditor": ("fleet.view", "log.export"),
}


def unauthorised_receipts(receipts: DataFrame, users: DataFrame, action: str = "cert.sign") -> DataFrame:
    """Receipts whose issuer is unknown, inactive or holds a role without the action."""
    roles = [r for r, acts in ROLE_ACTIONS.items() if action in acts]
    allowed = users.where(F.col("active") & F.col("role").isin(*roles)).select(F.col("user_id").alias("issuer_id"))
    return receipts.join(allowed, "issuer_id", "left_anti")


def reason_template(code) -> Column:
    """Reason with its first measured number masked."""
    return F.regexp_replace(F.col(code) if isinstance(code, str) else code, r"^(.*?)_[\d.]+(PCT|MM)_", "$1_x_")


def reason_census(verdicts: DataFrame, n: int = 14) -> DataFrame:
    """Most frequent masked reasons (count descending, then text)."""
    return (verdicts.select(F.explode("codes").alias("code")).groupBy(reason_template("code").alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(n))


def bucket_census(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("pack_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
