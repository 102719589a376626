"""Correlations, moments, histograms and densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def value_counts(df: DataFrame, c: str, ranges: int = 64) -> DataFrame:
    """(_v, _c, _before): each value that is no null, its rows, and the rows with smaller values.

    Values are ordered range by range: ranges of equal numbers of rows are cut at
    approximate quantiles, so a task orders the distinct values of one range, and one task
    the totals of the ranges.
    """
    d = df.select(F.col(c).alias("_v")).filter("_v is not null")
    cuts = sorted(set(d.agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))

    def place(low: int, high: int) -> Column:
        """The number of cuts below the value, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("_v") <= cuts[mid], place(low, mid)).otherwise(place(mid + 1, high))

    counts = d.groupBy("_v").agg(F.count("*").alias("_c")).withColumn("_b", place(0, len(cuts)))
    before = lambda n, w: F.sum(n).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    totals = counts.groupBy("_b").agg(F.sum("_c").alias("_n")).select("_b", before("_n", W.orderBy("_b")).alias("_above"))
    within = counts.withColumn("_in", before("_c", W.partitionBy("_b").orderBy("_v")))
    return within.join(F.broadcast(totals), "_b").select("_v", "_c", (F.col("_above") + F.col("_in")).alias("_before"))


def quantiles(df: DataFrame, c: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between the two nearest rows; None without a value."""
    counts = value_counts(df, c)
    n = df.agg(F.count(c)).first()[0]
    if not n:
        return [None] * len(shares)
    places = sorted({int(k) for p in shares for k in (p * (n - 1), min(p * (n - 1) + 1, n - 1))})
    held = lambda k: (F.col("_before") <= k) & (F.col("_before") + F.col("_c") > k)
    row = counts.agg(*[F.max(F.when(held(k), F.col("_v"))).alias(str(k)) for k in places]).first()
    out = []
    for p in shares:
        k, part = divmod(p * (n - 1), 1)
        low, high = (float(row[str(min(int(k) + i, n - 1))]) for i in (0, 1))
        out.append(low + (high - low) * part)
    return out


def describe(df: DataFrame, c: str, digits: int = 6) -> DataFrame:
    """count, mean, std, min, exact quartiles and max; no task holds all values."""
    r = lambda x: F.round(x, digits)
    q25, q50, q75 = quantiles(df, c, [0.25, 0.5, 0.75])
    q = lambda v: r(F.lit(v).cast("double"))
    return df.agg(F.count(c).alias("count"), r(F.avg(c)).alias("mean"), r(F.stddev_samp(c)).alias("std"), r(F.min(c)).alias("min"), q(q25).alias("q25"), q(q50).alias("q50"), q(q75).alias("q75"), r(F.max(c)).alias("max"))


def average_ranks(df: DataFrame, c: str, out: str, ranges: int = 64) -> DataFrame:
    """Adds average ranks (ties share their mean), from value counts."""
    ranks = value_counts(df, c, ranges).select("_v", (F.col("_before") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, F.col(c) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.select(x, y).na.drop()
    return average_ranks(average_ranks(d, x, "_rx"), y, "_ry").agg(F.round(F.corr("_rx", "_ry"), 6).alias("spearman"))


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation by Student's t (a continued fraction of the incomplete beta function)."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if x < 1 else 0.0

    def fraction(a, b, x):
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def correlations(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """Pearson's and Spearman's coefficients with their two-sided p-values, over rows that have both."""
    d = df.select(x, y).na.drop()
    row = d.agg(F.corr(x, y).alias("r"), F.count("*").alias("n")).first()
    out = {"n": row["n"], "pearson": row["r"], "spearman": spearman(d, x, y).first()["spearman"]}
    for k in ("pearson", "spearman"):
        out[f"{k}_p"] = None if out[k] is None else correlation_p_value(out[k], row["n"])
    return out


def conclusion(r: Column) -> Column:
    return F.when(r < -0.3, "negative").when(r > 0.3, "positive").otherwise("weak")


def bucket(v: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of equal width, the largest value in the last one."""
    return F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, c: str, bins: int, by: list[str] | None = None) -> DataFrame:
    d = df.filter(F.col(c).isNotNull())
    d = d.crossJoin(F.broadcast(d.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))))
    return d.groupBy(*(by or []), bucket(F.col(c), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    d = df.crossJoin(F.broadcast(df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))))
    return d.groupBy(bucket(F.col(x), F.col("_x0"), F.col("_x1"), bins).alias("bx"), bucket(F.col(y), F.col("_y0"), F.col("_y1"), bins).alias("by")).agg(F.count("*").alias("n"))


def hexbin(df: DataFrame, x: str, y: str, grid: int = 40) -> DataFrame:
    """Counts by the nearer of two interleaved lattices."""
    d = df.crossJoin(F.broadcast(df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))))
    ny = int(grid / math.sqrt(3))
    u, v = (F.col(x) - F.col("_x0")) / ((F.col("_x1") - F.col("_x0")) / grid), (F.col(y) - F.col("_y0")) / ((F.col("_y1") - F.col("_y0")) / ny)
    i1, j1, i2, j2 = F.floor(u + 0.5), F.floor(v + 0.5), F.floor(u), F.floor(v)
    first = F.pow(u - i1, 2) + 3 * F.pow(v - j1, 2) < F.pow(u - i2 - 0.5, 2) + 3 * F.pow(v - j2 - 0.5, 2)
    return d.groupBy(F.when(first, 0).otherwise(1).alias("lattice"), F.when(first, i1).otherwise(i2).cast("int").alias("i"), F.when(first, j1).otherwise(j2).cast("int").alias("j")).agg(F.count("*").alias("n"))


def kde(df: DataFrame, c: str, points: int = 50, adjust: float = 0.5) -> DataFrame:
    """Gaussian density at equally spaced points, bandwidth adjust * n^(-1/5) * sd; the points table is the bounded side."""
    stats = df.agg(F.count(c).alias("_n"), F.stddev_samp(c).alias("_s"), F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    g = stats.select("*", (adjust * F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_s")).alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    g = g.withColumn("_x", F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1))
    values = df.groupBy(c).agg(F.count("*").alias("_c")).filter(F.col(c).isNotNull())
    z = (F.col("_x") - F.col(c)) / F.col("_h")
    return values.crossJoin(F.broadcast(g)).groupBy("point", "_x").agg((F.sum(F.col("_c") * F.exp(-z * z / 2)) / (F.first("_n") * F.first("_h") * math.sqrt(2 * math.pi))).alias("density")).select("point", F.round("_x", 6).alias("x"), F.round("density", 9).alias("density"))


def moments(c: Column) -> tuple[Column, Column]:
    """Population skewness and excess kurtosis."""
    return F.skewness(c), F.kurtosis(c)
