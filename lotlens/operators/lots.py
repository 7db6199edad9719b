"""Items -> trays -> lots: look merging, shares, design effects, intervals, sequential decisions.

Everything before the intervals is built from mergeable sums, so a lot that holds a large part of all rows is
reduced map-side before anything is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.beta import jeffreys
from lotlens.functions.numeric import (cluster_deff, half_up, percent, round_half_up, wilson)
from lotlens.functions.ordered import row_index
from lotlens.sources.packs import BUCKETS, Pack

SHORT = {"GRADE_A": "a", "URS": "u", "REJECT": "r", "REFER": "f"}
COUNTS = [f"c_{s}" for s in SHORT.values()]
WEIGHTS = [f"w_{s}" for s in SHORT.values()]
TALLY = ["n", "w", *COUNTS, *WEIGHTS]
# Trays kept inside one lot row for the in-row bootstrap; lots with more trays take the joined form.
ROW_TRAYS = 64
#: Lots with more trays than the first are resampled by counts, in blocks of the second.
COUNTED_TRAYS, BLOCK_TRAYS = 4096, 1024
#: Draws of the joined form that are in memory at once.
ROUND_DRAWS = 1 << 18


def look_aggregates(verdicts: DataFrame, multiplicity: str | None = None) -> DataFrame:
    """Per lot, pack, tray, look: items and weight, in total and per bucket. ``multiplicity`` holds +1/-1 corrections."""
    k = multiplicity or "1"
    w = f"CAST(w AS BIGINT) * {k}" if multiplicity else "CAST(w AS BIGINT)"
    aggs = [F.expr(f"sum(CAST({k} AS BIGINT)) AS n"), F.expr(f"sum({w}) AS w")]
    for b, s in SHORT.items():
        aggs += [F.expr(f"sum(IF(bucket = '{b}', CAST({k} AS BIGINT), 0L)) AS c_{s}"),
                 F.expr(f"sum(IF(bucket = '{b}', {w}, 0L)) AS w_{s}")]
    return verdicts.groupBy("lot_id", "pack_id", "tray", "look").agg(*aggs)


def non_grade_a(n="n", a="c_a") -> Column:
    return F.when(F.col(n) > 0, F.lit(1.0) - F.col(a) / F.col(n)).otherwise(F.lit(0.0))


def merge_looks(looks: DataFrame, mode: str = "max_nonA") -> DataFrame:
    """One row per tray: the look showing most non-Grade-A (ties: the first look), or the mean over looks."""
    keys = ["lot_id", "pack_id", "tray"]
    n_looks = F.count(F.lit(1)).alias("n_looks")
    if mode == "mean":
        return looks.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in TALLY], n_looks)
    best = F.max_by(F.struct(*TALLY), F.struct(non_grade_a(), -F.col("look"))).alias("best")
    return looks.groupBy(*keys).agg(best, n_looks).select(*keys, "best.*", "n_looks")


def merge_looks_by_pack(looks: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Looks merged as each pack says."""
    parts = []
    for mode in dict.fromkeys(p.look_merge for p in packs):
        rows = merge_looks(looks.where(F.col("pack_id").isin([p.id for p in packs if p.look_merge == mode])), mode)
        parts.append(rows)
    out = parts[0]
    for rows in parts[1:]:
        out = out.selectExpr(*[f"CAST({c} AS DOUBLE) AS {c}" if c in TALLY else c for c in out.columns]).unionByName(
            rows.selectExpr(*[f"CAST({c} AS DOUBLE) AS {c}" if c in TALLY else c for c in rows.columns]))
    return out


def _by_pack(packs: Sequence[Pack], value) -> str:
    """CASE over pack_id giving ``value(pack)``."""
    return "CASE pack_id " + " ".join(f"WHEN '{p.id}' THEN {value(p)}" for p in packs) + " END"


def add_pack_sums(trays: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Procured and "bad" tallies, which depend on the pack."""
    total = lambda prefix, ids: " + ".join(f"{prefix}_{SHORT[b]}" for b in ids)
    return trays.selectExpr("*", _by_pack(packs, lambda p: total("c", p.procured)) + " AS c_p",
                            _by_pack(packs, lambda p: total("w", p.procured)) + " AS w_p",
                            _by_pack(packs, lambda p: total("c", p.bad)) + " AS bad")


SELECTORS = [*[("count", b, f"c_{s}", "n") for b, s in SHORT.items()], ("count", "PROCURED", "c_p", "n"),
             *[("weight", b, f"w_{s}", "w") for b, s in SHORT.items()], ("weight", "PROCURED", "w_p", "w")]


def selected(trays: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Trays in long form: one row per tray and share, with amount x out of m (count or weight) and items n."""
    rows = ", ".join(f"named_struct('basis', '{basis}', 'bucket', '{b}', 'x', CAST({x} AS DOUBLE), 'm', CAST({n} AS DOUBLE))"
                     for basis, b, x, n in SELECTORS)
    return (add_pack_sums(trays, packs).selectExpr("lot_id", "pack_id", "tray", "CAST(n AS DOUBLE) AS n", f"inline(array({rows}))"))


def lot_shares(trays: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """One row per lot, pack, basis (count / weight) and bucket with share p and its design effect."""
    sums = selected(trays, packs).groupBy("lot_id", "pack_id", "basis", "bucket").agg(
        F.count(F.lit(1)).alias("n_trays"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("m").alias("total"),
        F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("m")).alias("xm"),
        F.sum(F.col("m") * F.col("m")).alias("mm"))
    p = F.when(F.col("total") > 0, F.col("x") / F.col("total")).otherwise(F.lit(0.0))
    return (sums.withColumn("deff", cluster_deff("n_trays", "total", "x", "xx", "xm", "mm")).withColumn("p", p)
            .withColumn("est", percent("p")).drop("xx", "xm", "mm"))


def lot_totals(trays: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Sums per (lot, pack) behind the lot decision, with the Grade-A design effect by count."""
    t = add_pack_sums(trays, packs)
    d = lambda c: F.col(c).cast("double")
    out = t.groupBy("lot_id", "pack_id").agg(
        F.count(F.lit(1)).alias("n_trays"), F.max("n_looks").alias("n_looks"), F.sum("n").alias("n"),
        F.sum("c_a").alias("c_a"), F.sum("c_f").alias("c_f"), F.sum(half_up(d("bad"))).alias("bad"),
        F.sum(half_up(d("n"))).alias("n_round"), F.sum(d("c_a") * d("c_a")).alias("_xx"),
        F.sum(d("c_a") * d("n")).alias("_xn"), F.sum(d("n") * d("n")).alias("_nn"))
    return out.withColumn("deff_a", cluster_deff("n_trays", "n", "c_a", "_xx", "_xn", "_nn")).drop("_xx", "_xn", "_nn")


# ---- bootstrap -----------------------------------------------------------------------------------------

def lot_seed(lot_id="lot_id", sampling_seed: str | None = None, prefix: str = "lot-bootstrap|") -> Column:
    """Seed of a lot's resampling: the recorded sampling seed if there is one, else a hash of the lot id."""
    own = F.sha2(F.concat(F.lit(prefix), F.col(lot_id).cast("string")), 256)
    return F.coalesce(F.col(sampling_seed), own) if sampling_seed else own


def draw_sql(seed: str, rep: str, j: str, m: str) -> str:
    """Tray position 0..m-1 of draw j in replicate rep: 32 bits of an md5 counter block, four draws per block."""
    return (f"CAST(conv(substr(md5(concat_ws('|', {seed}, {rep}, {j} DIV 4)), 1 + 8 * ({j} % 4), 8), 16, 10) AS BIGINT) % {m}")


def quantile_positions(b: int, level: float) -> tuple[int, int]:
    t = (1.0 - level) / 2.0
    at = lambda q: min(b - 1, max(0, math.floor(q * b)))
    return at(t), at(1.0 - t)


_BOOT = ["n", "w", *dict.fromkeys(x for _, _, x, _ in SELECTORS)]
_BOUNDS = "lot_id long, pack_id string, basis string, bucket string, lo double, hi double"


def cluster_bootstrap(trays: DataFrame, packs: Sequence[Pack], b: int | None = None, level: float = 0.95, seeds: DataFrame | None = None,
                      row_trays: int = ROW_TRAYS, min_trays: int = 3, counted_trays: int = COUNTED_TRAYS) -> DataFrame:
    """Percentile bootstrap over whole trays for every share of every lot: lot_id, pack_id, basis, bucket, lo, hi.

    Each pack's own number of replicates holds unless ``b`` is given; ``seeds`` (lot_id, sampling_seed) has the recorded
    seeds, where there are any. One resample per replicate serves all shares of a lot and all packs with as many trays.
    Lots with up to ``row_trays`` trays are resampled as one small group; lots with more by joining drawn positions to
    trays, some replicates at a time; lots with over ``counted_trays`` by how often each tray is drawn, block by block,
    with a row per block and replicate instead of one per draw.
    """
    t = add_pack_sums(trays, packs)
    sizes = t.groupBy("lot_id", "pack_id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_trays)
    seeded = lambda df: (df.withColumn("_seed", lot_seed()) if seeds is None else
                         df.join(seeds.select("lot_id", "sampling_seed"), "lot_id", "left").withColumn("_seed", lot_seed("lot_id", "sampling_seed")).drop("sampling_seed"))
    sized = t.join(sizes, ["lot_id", "pack_id"]).selectExpr("lot_id", "pack_id", "tray", "m", *[f"CAST({c} AS DOUBLE) AS {c}" for c in _BOOT])
    reps = {p.id: b or p.bootstrap_b for p in packs}
    small = seeded(sized.where(F.col("m") <= row_trays))
    # Few bytes but much work per lot: adaptive execution would merge it all into one task.
    tasks = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = small.repartition(tasks, "lot_id").sortWithinPartitions("lot_id", "pack_id", F.col("tray").asc_nulls_last())
    narrow = ordered.select("lot_id", "pack_id", "_seed", *_BOOT).mapInPandas(_resampled(reps, level), _BOUNDS)
    wide = sized.where(F.col("m") > row_trays)
    joined = seeded(wide.where(F.col("m") <= counted_trays)).repartition(tasks, "lot_id").groupBy("lot_id").applyInPandas(_joined_bootstrap(reps, level), _BOUNDS)
    counted = row_index(seeded(wide.where(F.col("m") > counted_trays)), "tray", ["lot_id", "pack_id"], "_i").withColumn("_i", F.col("_i") - 1)
    return narrow.unionByName(joined).unionByName(_counted_bootstrap(counted, reps, level))


@lru_cache(8)
def _counters(first: int, b: int, blocks: int) -> list[bytes]:
    return [f"{rep}|{k}".encode() for rep in range(first, first + b) for k in range(blocks)]


def draws(seed: str, b: int, m: int, first: int = 0) -> np.ndarray:
    """Tray positions of b replicates of m draws, from replicate ``first`` on, as draw_sql gives them."""
    raw, begun = bytearray(), hashlib.md5(f"{seed}|".encode())
    for counter in _counters(first, b, -(-m // 4)):
        block = begun.copy()
        block.update(counter)
        raw += block.digest()
    return np.frombuffer(raw, ">u4").reshape(b, -1)[:, :m].astype(np.int64) % m


def _resampled(reps: dict[str, int], level: float):
    """Lots of few trays, many at a time: rows come in order of lot, pack and tray, and a lot may go on in the next part."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            cut = int(np.argmax(part["lot_id"].to_numpy() == part["lot_id"].iloc[-1])) if len(part) else 0
            rest = part.iloc[cut:]
            if cut:
                yield _resampled_lots(part.iloc[:cut], reps, level)
        if rest is not None and len(rest):
            yield _resampled_lots(rest, reps, level)
    return run


def _resampled_lots(rows: pd.DataFrame, reps: dict[str, int], level: float) -> pd.DataFrame:
    """Bounds of whole lots, in rounds of gradings with as many trays and replicates; sums add trays in the order drawn."""
    lots, packs, seeds, values = rows["lot_id"].to_numpy(), rows["pack_id"].to_numpy(), rows["_seed"].to_numpy(), rows[_BOOT].to_numpy(float)
    first = np.flatnonzero(np.r_[True, (lots[1:] != lots[:-1]) | (packs[1:] != packs[:-1])])
    trays = np.diff(np.r_[first, len(lots)])
    alike: dict[tuple[int, int], list[int]] = {}
    for start, m in zip(first.tolist(), trays.tolist(), strict=True):
        alike.setdefault((m, reps[packs[start]]), []).append(start)
    found = []
    for (m, b), starts in alike.items():
        (lo, hi), size = quantile_positions(b, level), max(1, ROUND_DRAWS // 8 // (b * m))
        seed, drawn = None, None
        for i in range(0, len(starts), size):
            at = np.array(starts[i:i + size])
            draw = np.empty((m, len(at), b), np.int64)
            for j, start in enumerate(at):
                if seeds[start] != seed:  # a lot's packs come one after another
                    seed, drawn = seeds[start], draws(seeds[start], b, m).T
                draw[:, j] = drawn
            draw += at[:, None]
            total = values.take(draw[0], 0)
            for d in draw[1:]:
                total += values.take(d, 0)
            sums = dict(zip(_BOOT, np.ascontiguousarray(total.transpose(2, 0, 1)), strict=True))
            for basis, bucket, x, n in SELECTORS:
                share = np.divide(sums[x], sums[n], out=np.zeros_like(sums[x]), where=sums[n] > 0)
                share.partition(sorted({lo, hi}), axis=1)
                found.append((lots[at], packs[at], np.repeat(basis, len(at)), np.repeat(bucket, len(at)), share[:, lo], share[:, hi]))
    return pd.DataFrame(dict(zip(("lot_id", "pack_id", "basis", "bucket", "lo", "hi"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def block_draws(seed: str, b: int, m: int, block: int, size: int) -> np.ndarray:
    """How many of the m draws of each of b replicates fall into a block of ``size`` neighbouring trays.

    The blocks' numbers are multinomial: halves of the lot get binomial shares of the draws of the whole, quarters of the
    halves and so on. Every half has its own seeded generator, so any task works out its block's numbers alone.
    """
    n, low, high = np.full(b, m), 0, -(-m // size)
    while high - low > 1:
        mid = (low + high) // 2
        share = (mid - low) * size / (min(m, high * size) - low * size)
        left = np.random.default_rng(int(hashlib.sha256(f"{seed}|{low}|{high}".encode()).hexdigest()[:32], 16)).binomial(n, share)
        n, low, high = (left, low, mid) if block < mid else (n - left, mid, high)
    return n


def tray_draws(seed: str, b: int, m: int, block: int, size: int) -> np.ndarray:
    """How often each replicate draws each tray of a block: a row per replicate."""
    trays = min(m, (block + 1) * size) - block * size
    inside = np.random.default_rng(int(hashlib.sha256(f"{seed}|block {block}".encode()).hexdigest()[:32], 16))
    return inside.multinomial(block_draws(seed, b, m, block, size), np.full(trays, 1 / trays))


def _counted_bootstrap(indexed: DataFrame, reps: dict[str, int], level: float) -> DataFrame:
    size = BLOCK_TRAYS

    def sums(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_i")
        lot, pack, m, seed, first = (block[c].iloc[0] for c in ("lot_id", "pack_id", "m", "_seed", "_i"))
        total = tray_draws(seed, reps[pack], int(m), int(first) // size, size) @ block[_BOOT].to_numpy()
        return pd.DataFrame(total, columns=_BOOT).assign(lot_id=lot, pack_id=pack, rep=np.arange(len(total)))
    tasks = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = (indexed.withColumn("_block", F.floor(F.col("_i") / size)).repartition(tasks, "lot_id", "pack_id", "_block").groupBy("lot_id", "pack_id", "_block")
             .applyInPandas(sums, ", ".join(f"{c} double" for c in _BOOT) + ", lot_id long, pack_id string, rep long"))
    return _percentiles(parts.groupBy("lot_id", "pack_id", "rep").agg(*[F.sum(c).alias(c) for c in _BOOT]), reps, level)


def _per_pack_sql(reps: dict[str, int], f) -> str:
    return "CASE pack_id " + " ".join(f"WHEN '{k}' THEN {f(v)}" for k, v in reps.items()) + " END"


def _joined_bootstrap(reps: dict[str, int], level: float):
    """All packs of one lot of more trays: drawn positions meet trays in rounds of at most ROUND_DRAWS draws.

    Only how often each tray was drawn in a replicate matters. Neither draws nor replicates are rows of a table.
    """
    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values("tray", na_position="first")
        seed, sums = lot["_seed"].iloc[0], {}
        trays = {pack: np.nan_to_num(own[_BOOT].to_numpy(float)) for pack, own in lot.groupby("pack_id", sort=False)}  # sums leave out missing weights
        for m in sorted({len(x) for x in trays.values()}):
            same = {pack: x for pack, x in trays.items() if len(x) == m}
            sums |= {pack: np.empty((reps[pack], len(_BOOT))) for pack in same}
            most = max(reps[pack] for pack in same)
            rounds = min(most, max(1, ROUND_DRAWS // m))
            for first in range(0, most, rounds):
                drawn = draws(seed, rounds, m, first) + m * np.arange(rounds)[:, None]
                hits = np.bincount(drawn.ravel(), minlength=rounds * m).reshape(rounds, m)
                for pack, x in same.items():
                    part = sums[pack][first:first + rounds]
                    part[:] = hits[:len(part)] @ x
        found = []
        for pack, total in sums.items():
            of = dict(zip(_BOOT, total.T, strict=True))
            lo, hi = quantile_positions(reps[pack], level)
            for basis, bucket, x, n in SELECTORS:
                share = np.sort(np.divide(of[x], of[n], out=np.zeros(len(total)), where=of[n] > 0))
                found.append((lot["lot_id"].iloc[0], pack, basis, bucket, share[lo], share[hi]))
        return pd.DataFrame(found, columns=["lot_id", "pack_id", "basis", "bucket", "lo", "hi"])
    return run


def _percentiles(sums: DataFrame, reps: dict[str, int], level: float) -> DataFrame:
    """Bounds of every share from a row of resampled sums per lot, pack and replicate."""
    shares = sums.selectExpr("lot_id", "pack_id", *[f"IF({n} > 0, {x} / {n}, 0.0D) AS {x}" for _, _, x, n in SELECTORS])
    # Exactly as many numbers per lot and share as the pack has replicates.
    lists = shares.groupBy("lot_id", "pack_id").agg(*[F.expr(f"sort_array(collect_list({x})) AS s_{x}") for _, _, x, _ in SELECTORS])
    lo, hi = (_per_pack_sql(reps, lambda b, k=k: quantile_positions(b, level)[k]) for k in (0, 1))
    rows = ", ".join(f"named_struct('basis', '{basis}', 'bucket', '{bucket}', 'lo', s_{x}[{lo}], 'hi', s_{x}[{hi}])" for basis, bucket, x, _ in SELECTORS)
    return lists.selectExpr("lot_id", "pack_id", f"inline(array({rows}))")


def lot_intervals(shares: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """95 % interval per share: tray bootstrap with three or more trays, otherwise Wilson on the deflated n."""
    n_eff = F.greatest(F.lit(1.0), half_up(F.col("n") / F.col("deff")).cast("double"))
    wlo, whi = wilson(half_up(F.col("p") * n_eff), n_eff)
    j = shares.join(bootstrap, ["lot_id", "pack_id", "basis", "bucket"], "left")
    boot = F.col("n_trays") >= 3
    return (j.withColumn("ci_lo", percent(F.when(boot, F.col("lo")).otherwise(wlo)))
            .withColumn("ci_hi", percent(F.when(boot, F.col("hi")).otherwise(whi)))
            .withColumn("method", F.when(boot, "cluster-bootstrap").otherwise("wilson-deff")).drop("lo", "hi"))


def with_jeffreys(shares: DataFrame, level: float = 0.95) -> DataFrame:
    """Jeffreys bounds per share, in percent, beside the frequentist interval."""
    lo, hi = jeffreys(half_up(F.col("p") * F.col("n")), half_up("n"), F.col("deff"), level)
    return shares.withColumn("bayes_lo", percent(lo)).withColumn("bayes_hi", percent(hi))


# ---- sequential test and decision ------------------------------------------------------------------------

def sprt(totals: DataFrame, packs: Sequence[Pack], deff: str = "deff_a") -> DataFrame:
    """Wald's sequential test on the bad share, each tray deflated by the design effect.

    Adds llr, upper and lower limits, decision and the expected number of further trays (-1: never).
    """
    per = lambda f: F.expr(_by_pack(packs, lambda p: f"{float(f(p))!r}D"))
    upper = per(lambda p: math.log((1 - p.beta) / p.alpha))
    lower = per(lambda p: math.log(p.beta / (1 - p.alpha)))
    l1 = per(lambda p: math.log(p.p1 / p.p0))
    l0 = per(lambda p: math.log((1 - p.p1) / (1 - p.p0)))
    d = F.greatest(F.lit(1.0), F.col(deff))
    t = totals.withColumn("llr", (F.col("bad") * l1 + (F.col("n_round") - F.col("bad")) * l0) / d)
    t = t.withColumn("upper", upper).withColumn("lower", lower)
    t = t.withColumn("sprt_decision", F.when(F.col("llr") >= F.col("upper"), "REJECT_LOT")
                     .when(F.col("llr") <= F.col("lower"), "ACCEPT_LOT").otherwise("SAMPLE_MORE"))
    rate = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("bad") / F.greatest(F.lit(1.0), F.col("n_round"))))
    drift = (F.col("n_round") / F.col("n_trays")) * (rate * l1 + (F.lit(1.0) - rate) * l0) / d
    more = F.greatest(F.lit(1), F.ceil((F.when(drift > 0, F.col("upper")).otherwise(F.col("lower")) - F.col("llr")) / drift))
    return t.withColumn("trays_more", F.when(F.col("sprt_decision") != "SAMPLE_MORE", F.lit(0))
                        .when(F.abs(drift) > 1e-9, more).otherwise(F.lit(-1)).cast("bigint"))


def lot_decision(tested: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Final decision: too many referred items or an undecided test at the tray cap goes to a human."""
    refer = F.when(F.col("n") > 0, F.col("c_f") / F.col("n")).otherwise(F.lit(0.0))
    cap = F.expr(_by_pack(packs, lambda p: p.max_trays))
    top = F.expr(_by_pack(packs, lambda p: f"{p.refer_share_max}D"))
    human = (refer > top) | ((F.col("sprt_decision") == "SAMPLE_MORE") & (F.col("n_trays") >= cap))
    return (tested.withColumn("refer_share", percent(refer))
            .withColumn("decision", F.when(human, "REFER_TO_HUMAN").otherwise(F.col("sprt_decision"))))


def headline(intervals: DataFrame, decisions: DataFrame, *more: Column) -> DataFrame:
    """One row per lot and pack: weight shares per bucket, Grade-A and procured intervals, decision; ``more`` aggregates of all shares."""
    pick = lambda b, c, name: F.max(F.when((F.col("basis") == "weight") & (F.col("bucket") == b), F.col(c))).alias(name)
    wide = intervals.groupBy("lot_id", "pack_id").agg(
        pick("GRADE_A", "est", "grade_a"), pick("URS", "est", "urs"), pick("REJECT", "est", "reject"),
        pick("REFER", "est", "refer"), pick("GRADE_A", "ci_lo", "grade_a_lo"), pick("GRADE_A", "ci_hi", "grade_a_hi"),
        pick("PROCURED", "est", "procured"), pick("PROCURED", "ci_lo", "procured_lo"),
        pick("PROCURED", "ci_hi", "procured_hi"), *more)
    return wide.join(decisions.select("lot_id", "pack_id", "decision"), ["lot_id", "pack_id"])


def indicative_value(kg, rate_per_quintal, lo, mid, hi) -> list[Column]:
    """Whole-rupee value at the procured share's bounds and estimate (shares in percent)."""
    q = F.col(kg) / 100.0
    money = lambda c, name: half_up(q * rate_per_quintal * F.col(c) / 100.0).alias(name)
    return [money(lo, "value_low"), money(mid, "value_mid"), money(hi, "value_high")]


def look_spread(looks: DataFrame) -> DataFrame:
    """Per lot and pack: mean and largest spread of non-Grade-A between looks of a tray, and the second look's mean change."""
    v = percent(non_grade_a())
    first2 = F.array_sort(F.collect_list(F.struct("look", v.alias("v"))))
    # A tray has a handful of looks, so its list is short.
    per = looks.groupBy("lot_id", "pack_id", "tray").agg(
        F.max(v).alias("hi"), F.min(v).alias("lo"), F.count(F.lit(1)).alias("k"), first2.alias("vs")).where(F.col("k") > 1)
    return per.groupBy("lot_id", "pack_id").agg(
        F.count(F.lit(1)).alias("n_repeat_trays"), round_half_up(F.avg(F.col("hi") - F.col("lo")), 4).alias("mean_spread"),
        F.max(F.col("hi") - F.col("lo")).alias("max_spread"),
        round_half_up(F.avg(F.col("vs")[1]["v"] - F.col("vs")[0]["v"]), 4).alias("mean_second_change"))
