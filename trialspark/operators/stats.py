"""Descriptive and rank statistics of groups of trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The coefficients of formula 7.1.26 of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / 2**0.5
    t = 1.0 / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = F.signum(z) * (1.0 - poly * F.exp(-x * x))
    return 0.5 * (1.0 + erf)


def describe(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, min, max of the non-null values and how many were null;
    statistics of nothing are NaN."""
    v = F.col(value).cast("double")
    nan = F.lit(float("nan"))
    return values.groupBy(*by).agg(
        F.count(v).alias("n"),
        *[F.coalesce(f, nan).alias(n) for n, f in (("mean", F.avg(v)), ("median", F.median(v)), ("min", F.min(v)), ("max", F.max(v)))],
        F.count_if(v.isNull()).alias("excluded"),
    )


def average_ranks(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``rank``: the mean rank of equal values.

    Equal values are counted first, so the ordered window sees a row for each
    distinct value and a hot value costs nothing more.
    """
    keys = by or []
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("rank", before + (F.col("_n") + 1) / 2).drop("_n")
    return values.join(ranks, [*keys, value])


def mann_whitney(values: DataFrame, group: str, value: str, a: str = "A", b: str = "B", by: list[str] | None = None) -> DataFrame:
    """One row, or one for each ``by``: u, z, p, n_a, n_b, small_sample, significant, excluded (nulls).

    No correction of sigma for ties; continuity of a half towards the mean. With
    an empty group u is NaN and z and p are NULL.
    """
    keys = by or []
    both = values.where(F.col(group).isin(a, b))
    known = both.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(group) == a).alias("in_a"), F.count_if(F.col(group) == b).alias("in_b"))
    n = F.col("in_a") + F.col("in_b")
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = known.withColumn("rank", before + (n + 1) / 2).groupBy(*keys).agg(
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("in_b"), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.col("rank") * F.col("in_a")), F.lit(0.0)).alias("r_a")
    )
    lost = both.groupBy(*keys).agg(F.count_if(F.col(value).isNull()).alias("excluded"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    some = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    u1 = F.col("r_a") - na * (na + 1) / 2
    sums = lost.join(sums, keys, "left").fillna(0, ["n_a", "n_b", "r_a"]) if keys else sums.crossJoin(lost)
    d = sums.withColumn("u", F.when(some, F.least(u1, na * nb - u1)).otherwise(F.lit(float("nan"))))
    mu, sigma = na * nb / 2, F.sqrt(na * nb * (na + nb + 1) / 12)
    z = F.when(some, (F.col("u") - mu + F.when(F.col("u") < mu, 0.5).otherwise(-0.5)) / F.nullif(sigma, F.lit(0.0)))
    d = d.withColumn("z", z).withColumn("p", 2 * (1 - normal_cdf(F.abs(F.col("z")))))
    return d.select(*keys, "u", "z", "p", "n_a", "n_b", ((F.col("n_a") < 8) | (F.col("n_b") < 8)).alias("small_sample"), (F.col("p") < 0.05).alias("significant"), "excluded")


#: The measures that groups of trials are compared by.
COMPARED = ("primary_latency_s", "total_latency_s", "primary_errors", "total_errors", "path_length_cm", "avg_speed_cm_s")


def compare_groups(measures: DataFrame, groups: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """mann_whitney of each compared measure between two groups of trials.
    ``groups``: trial_id, grp; trials of no group are left out."""
    both = measures.join(groups.select("trial_id", "grp"), "trial_id")
    long = both.select("grp", *[F.col(m).cast("double").alias(m) for m in COMPARED]).unpivot("grp", list(COMPARED), "measure", "value")
    return mann_whitney(long, "grp", "value", a, b, ["measure"])
