"""Rank correlation and small numeric helpers."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rng import places
from .storage import kept


def rounded(c: Column | str) -> Column:
    """Six decimals, without a negative zero; what registered queries return.

    The factor moves values off the exact ties of rounding, where engines' last bits would decide.
    """
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(1.000000001), 6) + F.lit(0.0)


def xlogy_ratio(x: Column, y: Column) -> Column:
    """x ln(x/y), 0 where x is 0; null where only y is 0."""
    return F.when(x > 0, x * F.log(F.try_divide(x, y))).otherwise(0.0)


def ranked(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the average rank of ``value`` (ties share their mean rank).

    Values are dealt to ranges between approximate quantiles: windows within a range, and the counts of the ranges before it.
    """
    sizes = df.groupBy(value).agg(F.count("*").alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limits = sizes.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)] or [1.0])).first()[0] or []
    limit = F.array(*map(F.lit, sorted({*limits}))) if limits else F.array().cast("array<double>")
    sizes = sizes.withColumn("_range", places(F.col(value), limit))
    # a row a range, so at most as many as there are partitions
    whole = sizes.groupBy("_range").agg(F.sum("_n").alias("_whole"))
    earlier = whole.select("_range", F.coalesce(F.sum("_whole").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + (F.col("_n") + 1) / 2
    placed = sizes.join(F.broadcast(earlier), "_range").select(value, rank.alias(out))
    return df.join(placed, value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho) over the rows of ``df``; rho is null where all values of a column are equal."""
    # each ranking reads its rows several times, so they are stored before it
    both = ranked(kept(ranked(kept(df.select(x, y), "rank-rows"), x, "_rx"), "ranked-rows"), y, "_ry")
    return both.agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("rho"))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation, by Student's t with n - 2 degrees of freedom."""
    if n < 3 or rho != rho:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    if n > 5000:
        return erfc(sqrt(t2 / 2))
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f
