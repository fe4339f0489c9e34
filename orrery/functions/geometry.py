"""Scalar geometry as columns: everything stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
_UNROLL = 64


def atom(k: int) -> Vec:
    """Position of atom k (from 1) of the frame."""
    return tuple(F.element_at(F.col(a), k) for a in ("x", "y", "z"))


def total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def _sum(axis: str, atoms: Sequence[int], weights: Sequence[float] | None = None) -> Column:
    """Sum over atoms: an unrolled expression for short selections, an array fold for long ones."""
    if len(atoms) <= _UNROLL:
        return total([F.element_at(F.col(axis), k) * (F.lit(float(w)) if weights else 1.0) for k, w in zip(atoms, weights or atoms)])
    picked = F.transform(F.lit(list(atoms)), lambda k: F.element_at(F.col(axis), k))
    if weights:
        picked = F.zip_with(picked, F.lit([float(w) for w in weights]), lambda v, w: v * w)
    return F.aggregate(picked, F.lit(0.0), lambda a, v: a + v)


def centre(atoms: Sequence[int], masses: Sequence[float] | None = None) -> Vec:
    whole = float(sum(masses)) if masses else float(len(atoms))
    return tuple(_sum(a, atoms, masses) / whole for a in ("x", "y", "z"))


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return total([p * q for p, q in zip(a, b)])


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def triple(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def minimum_image(d: Vec, box: Sequence[float] | None) -> Vec:
    """Difference to the nearest image in an orthorhombic box (round half to even)."""
    return d if box is None else tuple(c - F.lit(float(size)) * F.rint(c / float(size)) for c, size in zip(d, box))


def nearest_image(a: Vec, anchor: Vec, box: Sequence[float]) -> Vec:
    """The image of `a` nearest to `anchor`."""
    return tuple(p + q for p, q in zip(anchor, minimum_image(minus(a, anchor), box)))


def distance(a: Vec, b: Vec, box: Sequence[float] | None = None) -> Column:
    return norm(minimum_image(minus(a, b), box))


def _degrees(cosine: Column) -> Column:
    """Degrees of a cosine; 0 where rounding (or a straight line) takes it to 1 or beyond."""
    return F.when(F.abs(cosine) < 1, F.degrees(F.acos(cosine))).otherwise(F.lit(0.0))


def angle(a: Vec, b: Vec, c: Vec) -> Column:
    """Degrees at b, by the law of cosines."""
    ab, bc, ac = distance(a, b), distance(b, c), distance(a, c)
    return _degrees((ab * ab + bc * bc - ac * ac) / (2 * ab * bc))


def dihedral(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Signed degrees between the planes (a, b, c) and (b, c, d)."""
    u, v, w = minus(b, a), minus(c, b), minus(d, c)
    p, q = cross(u, v), cross(v, w)
    sign = F.when(triple(u, v, w) <= 1e-9, F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * _degrees(dot(p, q) / (norm(p) * norm(q)))


def sigmoid_contact(d: Column, r0: float) -> Column:
    """Smooth contact r0^6 / (r0^6 + d^6)."""
    return F.lit(r0**6) / (F.lit(r0**6) + F.pow(d, F.lit(6.0)))


def tanimoto(a: Column, b: Column) -> Column:
    """s1 / (s2 + s3 - s1) of two arrays: shared over joint weight."""
    both = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    own = [F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p) for v in (a, b)]
    return both / (own[0] + own[1] - both)


def let(values: dict[str, Column], body) -> Column:
    """`body` over named values that are computed once, where repeating them would blow up the plan."""
    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), body)[0]


def symmetric_top(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Largest eigenvalue of a symmetric 3 by 3 matrix, in closed form."""

    def shifted(m: Column) -> Column:
        q = (m["xx"] + m["yy"] + m["zz"]) / 3
        return let({"a": m["xx"] - q, "b": m["yy"] - q, "c": m["zz"] - q, "d": m["xy"], "e": m["xz"], "f": m["yz"], "q": q}, scaled)

    def scaled(m: Column) -> Column:
        p = F.sqrt((m["a"] * m["a"] + m["b"] * m["b"] + m["c"] * m["c"] + 2 * (m["d"] * m["d"] + m["e"] * m["e"] + m["f"] * m["f"])) / 6)
        det = m["a"] * (m["b"] * m["c"] - m["f"] * m["f"]) - m["d"] * (m["d"] * m["c"] - m["f"] * m["e"]) + m["e"] * (m["d"] * m["f"] - m["b"] * m["e"])
        return let({"p": p, "det": det, "q": m["q"]}, solved)

    def solved(m: Column) -> Column:
        half = F.greatest(F.least(m["det"] / (2 * m["p"] * m["p"] * m["p"]), F.lit(1.0)), F.lit(-1.0))
        return F.when(m["p"] < 1e-300, m["q"]).otherwise(m["q"] + 2 * m["p"] * F.cos(F.acos(half) / 3))

    return let({"xx": xx, "yy": yy, "zz": zz, "xy": xy, "xz": xz, "yz": yz}, shifted)


# One-letter codes of residue names (fixed values).
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def one_letter(name: Column, default: str = "X") -> Column:
    table = F.create_map(*[F.lit(v) for pair in LETTERS.items() for v in pair])
    return F.coalesce(F.element_at(table, F.upper(F.trim(name))), F.lit(default))
