"""Statistics used to relate frequency to performance."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linspace(low: Column, high: Column, n: int) -> Column:
    """n equally spaced edges; the last is exactly ``high``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, high).otherwise(low + i * (high - low) / (n - 1)))


def digitize(x: Column, edges: Column) -> Column:
    """How many edges lie strictly below x."""
    return F.size(F.filter(edges, lambda e: e < x))


def log_count(n: Column) -> Column:
    """Natural logarithm of a count; zero counts as one."""
    return F.log(F.greatest(n, F.lit(1)).cast("double"))


def log_bins(rows: DataFrame, n_col: str, value_col: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """([by], bin, edge, n, mean, std) for each of ``bins`` edges over log counts; an empty bin has mean and deviation 0.

    The range is one row of minima and maxima (one for each group), which is broadcast where there are no
    groups; the result has ``bins`` rows a group.
    """
    by = by or []
    x = rows.select(*by, log_count(F.col(n_col)).alias("x"), F.col(value_col).cast("double").alias("v"))
    ends = x.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo IS NOT NULL").select(*by, linspace(F.col("lo"), F.col("hi"), bins).alias("edges"))
    met = x.join(ends, by) if by else x.join(F.broadcast(ends))
    placed = met.select(*by, digitize(F.col("x"), F.col("edges")).cast("long").alias("bin"), "v")
    found = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    every = ends.select(*by, F.posexplode("edges").alias("bin", "e")).select(*by, F.col("bin").cast("long"), F.exp("e").alias("edge"))
    return every.join(found if by else F.broadcast(found), [*by, "bin"], "left").select(*by, "bin", "edge", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"))


def average_rank(order: Column, within: list[str] | None = None) -> Column:
    """Rank with ties at their mean; grouped counts keep the unpartitioned form to small tables."""
    w = Window.partitionBy(*(within or []))
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*(within or []), order)) - 1) / 2


def rank_by_value(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out): average rank of value over all rows, without a single-task sort of the rows.

    Ranks come from the table of distinct values with their counts: one window over distinct values.
    """
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    below = F.sum("__c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__c")
    ranks = counts.select(value, (below + (F.col("__c") + 1) / 2).alias(out))
    return rows.join(ranks, value).select(key, out)


def bucket_regression(buckets: DataFrame, bins: int = 5) -> DataFrame:
    """(slope, intercept, r) of bucket means over bucket centres: least squares over all buckets, then, without the
    bucket of the largest centre, the correlation of log edges and means of log bins.

    buckets: (lo, hi, mean), a few dozen rows.
    """
    points = buckets.select(((F.col("lo") + F.col("hi")) / 2).alias("n"), F.col("mean").alias("v"))
    line = points.agg(F.regr_slope("v", "n").alias("slope"), F.regr_intercept("v", "n").alias("intercept"))
    last = points.agg(F.max(F.struct("n", "v")).alias("last"))
    rest = points.join(F.broadcast(last)).where(F.struct("n", "v") < F.col("last")).select("n", "v")
    r = log_bins(rest, "n", "v", bins).agg(F.corr(F.log("edge"), F.col("mean")).alias("r"))
    return line.join(F.broadcast(r)).select("slope", "intercept", "r")


def with_p(rows: DataFrame, r: str, n: str) -> DataFrame:
    """rows with p, the two-sided p-value of a correlation r of n pairs; null without r."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else pearson_p(a, int(b)) for a, b in zip(r, n)], dtype="float64")

    return rows.withColumn("p", p(F.col(r).cast("double"), F.col(n)))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or 1e-300)
            c = 1 + term / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs (Student's t with n - 2 degrees of freedom)."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return betainc((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))
