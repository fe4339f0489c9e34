"""Distance joins by cells: points are put into cubes as wide as the cutoff, and only the 27 cubes
around a point are met, so the work follows the number of near pairs, not of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AXES = ("x", "y", "z")


def _cell(axis: str, cutoff: float):
    return F.floor(F.col(axis) / F.lit(float(cutoff))).alias(f"c{axis}")


def near_pairs(points: DataFrame, cutoff: float, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(by..., i, j, d) of the pairs i < j of atoms of one `by` group within the cutoff."""
    return _meet(points, points, cutoff, by or [], strict).where("i < j")


def _meet(left: DataFrame, right: DataFrame, cutoff: float, by: list[str], strict: bool) -> DataFrame:
    around = F.explode(F.expr("flatten(transform(array(-1, 0, 1), a -> flatten(transform(array(-1, 0, 1), b -> transform(array(-1, 0, 1), c -> struct(a, b, c))))))")).alias("o")
    cells = [_cell(a, cutoff) for a in _AXES]
    a = left.select(*by, F.col("atom_id").alias("i"), *[F.col(x).alias(f"a{x}") for x in _AXES], *cells)
    b = right.select(*by, F.col("atom_id").alias("j"), *[F.col(x).alias(f"b{x}") for x in _AXES], *cells, around)
    b = b.select(*by, "j", *[f"b{x}" for x in _AXES], *[(F.col(f"c{x}") + F.col(f"o.{o}")).alias(f"c{x}") for x, o in zip(_AXES, "abc")])
    d = F.sqrt(sum((F.col(f"a{x}") - F.col(f"b{x}")) * (F.col(f"a{x}") - F.col(f"b{x}")) for x in _AXES))
    met = a.join(b, [*by, *[f"c{x}" for x in _AXES]]).withColumn("d", d)
    return met.where(F.col("d") < cutoff if strict else F.col("d") <= cutoff).select(*by, "i", "j", "d")


def within(atoms: DataFrame, chosen: DataFrame, cutoff: float, strict: bool = False, count: str | None = None) -> DataFrame:
    """(atom_id[, count]) of the atoms within the cutoff of a chosen one, with the number of those."""
    met = _meet(atoms, chosen, cutoff, [], strict).groupBy("i").agg(F.count(F.lit(1)).alias(count or "n")).withColumnRenamed("i", "atom_id")
    return met if count else met.select("atom_id")
