"""Crossings of a slab: the stateful counter, as windows over a batch.

A particle's status is 1 in the upper zone, 0 in the lower one, 3 (outside) beyond either by delta or
more or outside of the cylinder, and what it was before while it is between them; it starts outside.
A crossing is a change between 0 and 1. streaming.crossings has the same counter over a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTSIDE = 3


def decided(z: Column, lower: float, upper: float, delta: float, inside: Column | None = None) -> Column:
    """Status where the position alone decides it, null between the zones."""
    beyond = (z >= upper + delta) | (z <= lower - delta)
    if inside is not None:
        beyond = beyond | ~inside
    return F.when(beyond, OUTSIDE).when(z >= upper, 1).when(z <= lower, 0)


def statuses(rows: DataFrame, key: str, order: str, z: str, lower: float, upper: float, delta: float = 5.0) -> DataFrame:
    """Rows with `status` and `crossed`."""
    by = Window.partitionBy(key).orderBy(order)
    held = F.coalesce(F.last(decided(F.col(z), lower, upper, delta), True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(OUTSIDE))
    out = rows.withColumn("status", held)
    before = F.coalesce(F.lag("status").over(by), F.lit(OUTSIDE))
    return out.withColumn("crossed", (F.col("status") != OUTSIDE) & (before != OUTSIDE) & (F.col("status") != before))


def crossings(rows: DataFrame, key: str, order: str, z: str, lower: float, upper: float, delta: float = 5.0) -> DataFrame:
    """(key, n): number of crossings of every particle."""
    return statuses(rows, key, order, z, lower, upper, delta).groupBy(key).agg(F.sum(F.col("crossed").cast("long")).alias("n"))
