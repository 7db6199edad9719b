"""Inter-rater agreement, method comparison and repeat-measurement statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import num


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Fleiss' kappa over ratings(item, grade); every item needs the same number of ratings. One row."""
    cells = ratings.groupBy("item", "grade").agg(F.count(F.lit(1)).alias("c"))
    items = cells.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    pbar = items.agg(F.count(F.lit(1)).alias("n_items"), F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p_bar"), F.sum("n").alias("total"))
    cats = cells.groupBy("grade").agg(F.sum("c").alias("c"))
    sq = cats.agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s")).scalar()
    return (pbar.withColumn("p_e", sq / (F.col("total").cast("double") * F.col("total")))
            .select("n_items", "p_bar", "p_e", ((F.col("p_bar") - F.col("p_e")) / (F.lit(1.0) - F.col("p_e"))).alias("kappa")))


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa and agreement per group from label pairs; kappa is 1 when chance agreement is certain."""
    by = list(by)
    cell = pairs.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("c"))
    marg = (cell.select(*by, F.col("_a").alias("cat"), F.col("c").alias("ca"), F.lit(0).cast("bigint").alias("cb"))
            .unionByName(cell.select(*by, F.col("_b").alias("cat"), F.lit(0).cast("bigint").alias("ca"), F.col("c").alias("cb")))
            .groupBy(*by, "cat").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb")))
    chance = marg.groupBy(*by).agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("s"))
    total = cell.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("c")).otherwise(0)).alias("agree"))
    j = total.join(chance, by) if by else total.withColumn("s", chance.scalar())
    po, pe = F.col("agree") / F.col("n"), F.col("s") / (F.col("n").cast("double") * F.col("n"))
    return j.select(*by, "n", po.alias("agreement"), F.when(pe == 1.0, F.lit(1.0)).otherwise((po - pe) / (F.lit(1.0) - pe)).alias("kappa"))


def bland_altman(pairs: DataFrame, method: str, ref: str, by: Sequence[str] = ()) -> DataFrame:
    """n, bias, sd, mean absolute error and 95 % limits of agreement per group."""
    d = num(method) - num(ref)
    sd = F.sqrt(F.var_pop(d) * F.count(F.lit(1)) / F.greatest(F.lit(1), F.count(F.lit(1)) - 1))
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), sd.alias("sd"), F.avg(F.abs(d)).alias("mae"))
    return out.withColumn("loa_lo", F.col("bias") - F.col("sd") * 1.96).withColumn("loa_hi", F.col("bias") + F.col("sd") * 1.96)


def icc1(values: DataFrame, group: str = "grp", value: str = "v", min_size: int = 1) -> DataFrame:
    """One-way ICC(1,1) with the mean group size. One row."""
    g = values.groupBy(group).agg(F.count(F.lit(1)).alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("vp")).where(F.col("k") >= min_size)
    s = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("grand"),
              F.sum(F.col("k") * F.col("m") * F.col("m")).alias("kmm"), F.sum(F.col("vp") * F.col("k")).alias("ssw"))
    msb = (F.col("kmm") - F.col("n") * F.col("grand") * F.col("grand")) / (F.col("groups") - 1)
    msw = F.col("ssw") / (F.col("n") - F.col("groups"))
    k = F.col("n") / F.col("groups")
    return s.select("groups", "n", ((msb - msw) / (msb + (k - 1) * msw)).alias("icc"))


def majority(ratings: DataFrame, item: str = "item", grade: str = "grade", by: Sequence[str] = ()) -> DataFrame:
    """Most frequent grade per item, '?' when the top is shared."""
    counts = ratings.groupBy(*by, item, grade).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(*by, item).agg(F.max(F.struct("c", grade)).alias("hi"), F.min(F.struct(-F.col("c"), F.col(grade))).alias("lo"))
    # Largest and smallest grade among the most frequent ones differ exactly when the top is tied.
    label = F.when(F.col(f"hi.{grade}") != F.col(f"lo.{grade}"), "?").otherwise(F.col(f"hi.{grade}"))
    return best.select(*by, item, label.alias("majority"))


def rater_vs_rest(ratings: DataFrame) -> DataFrame:
    """Each rater against the majority of the others: rater, n, agreement, kappa.

    The majority without a rater follows from the item's grade counts minus that rater's own grade, so ratings are joined
    to at most a handful of count rows and raters are never paired with each other.
    """
    counts = ratings.groupBy("item", "grade").agg(F.count(F.lit(1)).alias("c")).withColumnRenamed("grade", "g")
    own = ratings.select("item", "rater", "grade")
    rest = own.join(counts, "item").withColumn("c", F.col("c") - (F.col("g") == F.col("grade")).cast("int")).where(F.col("c") > 0)
    best = rest.groupBy("item", "rater", "grade").agg(F.max(F.struct("c", "g")).alias("hi"), F.min(F.struct(-F.col("c"), F.col("g"))).alias("lo"))
    m = best.select("rater", F.col("grade").alias("a"), F.when(F.col("hi.g") != F.col("lo.g"), "?").otherwise(F.col("hi.g")).alias("b"))
    return cohen_kappa(m, "a", "b", ["rater"])


def model_vs_humans(ratings: DataFrame, model: DataFrame) -> DataFrame:
    """Model against the human majority, and whether it agrees at least as much as the average rater. One row."""
    j = model.select("item", F.col("grade").alias("a")).join(majority(ratings), "item").select("a", F.col("majority").alias("b"))
    humans = rater_vs_rest(ratings).agg(F.avg("agreement").alias("h")).scalar()
    return cohen_kappa(j).withColumn("mean_human_agreement", humans).withColumn("at_least_average", F.col("agreement") >= F.col("mean_human_agreement"))


def fit_weight_model(pairs: DataFrame, d: str, g: str, by: Sequence[str] = (), min_n: int = 5) -> DataFrame:
    """Least squares of log weight on log diameter: a, b, residual sd and n; groups under ``min_n`` give no model."""
    x, y = F.ln(num(d)), F.ln(num(g))
    s = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("la"),
                               F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")).where(F.col("n") >= min_n)
    ss = F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("sxy"))
    return s.select(*by, F.exp("la").alias("a"), "b", F.sqrt(ss / F.greatest(F.lit(1), F.col("n") - 2)).alias("residual_sd"), "n")


def count_errors(pairs: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean absolute error, exact and within-one shares, mean error of counts."""
    e = num(predicted) - num(truth)
    ok = pairs.where(num(truth).isNotNull() & num(predicted).isNotNull())
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg((e == 0).cast("int")).alias("exact"),
                               F.avg((F.abs(e) <= 1).cast("int")).alias("within1"), F.avg(e).alias("mean_error"))


def interval_coverage(lots: DataFrame, truth: str, est: str, lo: str, hi: str) -> DataFrame:
    """Mean absolute error of an estimated share and how often its interval holds the truth. One row."""
    return lots.agg(F.count(F.lit(1)).alias("n_lots"), F.avg(F.abs(num(est) - num(truth))).alias("mae"),
                    F.avg(num(truth).between(num(lo), num(hi)).cast("int")).alias("coverage"))
