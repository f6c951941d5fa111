"""Statistics as column expressions: intervals, paired tests, step-down correction. Nulls are skipped as in SQL aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return a / F.when(b != 0, b)


def geometric_mean(logs: Column) -> Column:
    return F.exp(F.avg(logs))


def log_or_null(x: Column) -> Column:
    """ln x, null for 0 and null."""
    return F.ln(F.when(x != 0, x))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, by the series of the error function (error below 1e-15)."""
    z = x / math.sqrt(2)
    start = F.struct(z.cast("double").alias("term"), z.cast("double").alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * z * z / (2 * n + 1)
        return F.struct(term.cast("double").alias("term"), (acc["total"] + term).cast("double").alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step)["total"] * F.exp(-z * z) * (2 / math.sqrt(math.pi))
    erf = F.when(z > 6, 1.0).when(z < -6, -1.0).otherwise(series)
    return (1 + erf) / 2


def wilson(k: Column, n: Column) -> tuple[Column, Column, Column]:
    """Share and its Wilson interval; nulls for n = 0."""
    some = F.when(n > 0, n.cast("double"))
    p = k / some
    base = 1 + Z * Z / some
    centre = (p + Z * Z / (2 * some)) / base
    half = Z * F.sqrt(p * (1 - p) / some + Z * Z / (4 * some * some)) / base
    return p, centre - half, centre + half


def mean_ci(x: Column) -> dict[str, Column]:
    """Aggregates: mean, lower and upper end of the 95 % interval (the mean itself for a single value), and count."""
    half = F.coalesce(Z * F.sqrt(F.var_samp(x) / F.count(x)), F.lit(0.0))
    return {"mean": F.avg(x), "lo": F.avg(x) - half, "hi": F.avg(x) + half, "n": F.count(x)}


def paired(d: Column) -> dict[str, Column]:
    """Aggregates over paired differences: mean, interval, count and the one-sided p of a mean above 0.

    Without spread the test is decided by the sign: p = 0 above 0, else 1."""
    out = mean_ci(d)
    error = F.sqrt(F.var_samp(d) / F.count(d))
    p = F.when(error > 0, 1 - normal_cdf(F.avg(d) / F.when(error > 0, error))).when(F.avg(d) > 0, 0.0).otherwise(1.0)
    return out | {"p": F.when(F.count(d) > 0, p)}


def holm(df: DataFrame, p: str, by: tuple[str, ...], order: tuple[str, ...], name: str = "p_holm") -> DataFrame:
    """Adds the step-down corrected p within groups: the running maximum of (m - i) p, at most 1. `order` breaks ties."""
    sorted_ = Window.partitionBy(*by).orderBy(p, *order)
    whole = Window.partitionBy(*by)
    scaled = F.least(F.lit(1.0), (F.count(p).over(whole) - F.row_number().over(sorted_) + 1) * F.col(p))
    return df.withColumn("_scaled", scaled).withColumn(name, F.max("_scaled").over(sorted_.rowsBetween(Window.unboundedPreceding, 0))).drop("_scaled")
