"""Order-dependent helpers that stay distributed when one group holds most of the rows.

A plain window puts a whole group in one task. Here the order column is cut into slices at approximate
quantiles (read once as a scalar subquery), windows run inside (group, slice), and the per-slice totals,
at most ``slices`` rows per group, carry the state from one slice to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 32


def _keys(by: Sequence[str]) -> list[str]:
    return list(by)


def with_slices(df: DataFrame, order: str, slices: int = SLICES) -> DataFrame:
    """Add ``_slice``: the number of approximate quantile cuts of ``order`` at or below the row's value."""
    probs = [i / slices for i in range(1, slices)]
    # Zone-less timestamps have no numeric cast of their own.
    number = f"CAST(CAST({order} AS TIMESTAMP) AS DOUBLE)" if df.schema[order].dataType.typeName() in ("timestamp_ntz", "date") else f"CAST({order} AS DOUBLE)"
    value = F.expr(number)
    cuts = df.agg(F.percentile_approx(value, probs, 10000).alias("_cuts")).scalar()
    passed = " + ".join(f"IF(_cuts[{i}] <= {number}, 1, 0)" for i in range(slices - 1))
    return df.select("*", cuts.alias("_cuts")).selectExpr(*df.columns, f"{passed} AS _slice")


def _join_offsets(df: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    drop = offsets.select([F.col(k).alias(f"_o_{k}") for k in [*by, "_slice"]]
                          + [c for c in offsets.columns if c not in [*by, "_slice"]])
    cond = None
    for k in [*by, "_slice"]:
        e = df[k].eqNullSafe(drop[f"_o_{k}"])
        cond = e if cond is None else cond & e
    return df.join(drop, cond, "left").drop(*[f"_o_{k}" for k in [*by, "_slice"]])


def running_sums(df: DataFrame, order: str, sums: dict[str, Column | str], by: Sequence[str] = (),
                 descending: bool = False, tie: Sequence[str] = (), slices: int = SLICES) -> DataFrame:
    """Inclusive running totals of ``sums`` (new name -> value column) along ``order`` within ``by``.

    Rows equal on ``order`` and ``tie`` get an arbitrary order among themselves, so pass a unique order, or
    collapse equal values first.
    """
    values = {name: (F.col(v) if isinstance(v, str) else v) for name, v in sums.items()}
    base = with_slices(df, order, slices)
    base = base.select("*", *[v.alias(f"_v_{name}") for name, v in values.items()])
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = (Window.partitionBy(*_keys(by), "_slice").orderBy(direction(order), *[F.col(t) for t in tie])
              .rowsBetween(Window.unboundedPreceding, 0))
    slice_order = F.col("_slice").desc() if descending else F.col("_slice").asc()
    before = Window.partitionBy(*_keys(by)).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (base.groupBy(*_keys(by), "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
               .select(*_keys(by), "_slice",
                       *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values]))
    local = base.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in values])
    out = _join_offsets(local, offsets, by)
    keep = [c for c in df.columns if c not in values]
    return out.select(*keep, *[(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in values])


def row_index(df: DataFrame, order: str, by: Sequence[str] = (), name: str = "rn", descending: bool = False,
              tie: Sequence[str] = (), slices: int = SLICES) -> DataFrame:
    """1-based position along ``order`` within ``by``."""
    return running_sums(df, order, {name: F.lit(1).cast("bigint")}, by, descending, tie, slices)


def previous(df: DataFrame, order: str, values: dict[str, str], by: Sequence[str] = (),
             tie: Sequence[str] = (), slices: int = SLICES) -> DataFrame:
    """Value of the preceding row along ``order`` within ``by`` (new name -> source column); NULL on the first."""
    base = with_slices(df, order, slices)
    keys = [F.col(order), *[F.col(t) for t in tie]]
    inside = Window.partitionBy(*_keys(by), "_slice").orderBy(*keys)
    rank = F.struct(*keys)
    lasts = base.groupBy(*_keys(by), "_slice").agg(
        F.max_by(F.struct(*[F.col(s).alias(n) for n, s in values.items()]), rank).alias("_last"))
    across = Window.partitionBy(*_keys(by)).orderBy("_slice")
    carried = lasts.select(*_keys(by), "_slice", F.lag("_last").over(across).alias("_carry"))
    local = base.select("*", F.lag(F.struct(*[F.col(s).alias(n) for n, s in values.items()])).over(inside).alias("_prev"),
                        F.row_number().over(inside).alias("_pos"))
    out = _join_offsets(local, carried, by)
    picked = F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    return out.select(*df.columns, *[picked[n].alias(n) for n in values])


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), slices: int = SLICES) -> DataFrame:
    """Distinct values with their count, the running count ``cum`` and the group size ``total``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*_keys(by), value).agg(F.count(F.lit(1)).alias("cnt"))
    cum = running_sums(counts, value, {"cum": F.col("cnt")}, by, slices=slices)
    if not by:
        total = counts.agg(F.sum("cnt").alias("total")).scalar()
        return cum.withColumn("total", total)
    totals = counts.groupBy(*by).agg(F.sum("cnt").alias("total"))
    return cum.join(totals.select(*[F.col(k).alias(f"_k_{k}") for k in by], "total"),
                    _all_equal(cum, by), "inner").drop(*[f"_k_{k}" for k in by])


def _all_equal(df: DataFrame, by: Sequence[str]) -> Column:
    cond = None
    for k in by:
        e = df[k].eqNullSafe(F.col(f"_k_{k}"))
        cond = e if cond is None else cond & e
    return cond


def nearest_rank(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Order statistic at 0-based index min(n-1, floor(q*n)), one output column per quantile."""
    ranks = value_ranks(df, value, by)
    picks = []
    for name, q in quantiles.items():
        pos = F.least(F.col("total"), F.floor(F.col("total") * F.lit(float(q))) + 1)
        picks.append(F.min(F.when(F.col("cum") >= pos, F.col(value))).alias(name))
    return ranks.groupBy(*_keys(by)).agg(*picks)


def linear_percentiles(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated percentiles at position q*(n-1), one output column per quantile."""
    ranks = value_ranks(df, value, by)
    picks = []
    for name, q in quantiles.items():
        pos = (F.col("total") - 1) * F.lit(float(q))
        low = F.min(F.when(F.col("cum") >= F.floor(pos) + 1, F.col(value)))
        high = F.min(F.when(F.col("cum") >= F.ceil(pos) + 1, F.col(value)))
        frac = F.max(pos - F.floor(pos))
        picks.append((low + (high - low) * frac).alias(name))
    return ranks.groupBy(*_keys(by)).agg(*picks)
