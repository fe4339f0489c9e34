"""Scalar series of areas: clustering by value and correlation of two series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_value(rows: DataFrame, value: str, width: float) -> DataFrame:
    """Rows with `bin`: half-open bins from the smallest value; one at the top edge stays unassigned (null)."""
    span = rows.agg(F.min(value).alias("low"), F.max(value).alias("high")).select("low", F.greatest(F.floor((F.col("high") - F.col("low")) / width + 0.5), F.lit(1)).alias("bins"))
    at = F.floor((F.col(value) - F.col("low")) / width)
    return rows.join(F.broadcast(span)).withColumn("bin", F.when(at < F.col("bins"), at)).drop("low", "bins")


def bin_sizes(rows: DataFrame, value: str, width: float) -> DataFrame:
    return by_value(rows, value, width).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Extremes, means, deviations, covariance and R2 of linear, logarithmic, exponential and power fits, in one pass."""

    def r2(a: Column, b: Column) -> Column:
        r = F.corr(a, b)
        return r * r

    a, b = F.col(x), F.col(y)
    la, lb = F.when(a > 0, F.log(a)), F.when(b > 0, F.log(b))
    return rows.agg(
        *[f(F.col(c)).alias(f"{name}_{axis}") for axis, c in (("x", x), ("y", y)) for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_pop))],
        F.covar_pop(a, b).alias("covariance"),
        r2(a, b).alias("linear"),
        r2(la, b).alias("logarithmic"),
        r2(a, lb).alias("exponential"),
        r2(la, lb).alias("power"),
    )
