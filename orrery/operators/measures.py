"""Per-frame measures. Each is a projection of the frames table: no shuffle, and any number of them
share one scan (see plans.blocks). Atoms are numbered from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import angle, atom, centre, dihedral, distance, dot, let, minus, sigmoid_contact, symmetric_top, total

Pair = tuple[Sequence[int], Sequence[int]]


def pair_distance(pair: Pair, masses: Sequence[float] | None = None, box: Sequence[float] | None = None) -> Column:
    """Distance of the centres of two selections; the box applies to the difference of the centres."""
    a, b = (centre(s, [masses[k - 1] for k in s] if masses else None) for s in pair)
    return distance(a, b, box)


def contacts(pairs: Sequence[Pair], cutoff: float, masses: Sequence[float] | None = None, box: Sequence[float] | None = None) -> Column:
    """Number of pairs of selections nearer than the cutoff."""
    return total([F.when(pair_distance(p, masses, box) < cutoff, 1).otherwise(0) for p in pairs])


def bond_angle(i: int, j: int, k: int) -> Column:
    return angle(atom(i), atom(j), atom(k))


def torsion(i: int, j: int, k: int, m: int) -> Column:
    return dihedral(atom(i), atom(j), atom(k), atom(m))


def gyration(atoms: Sequence[int], masses: Sequence[float] | None = None) -> Column:
    """Radius of gyration; with masses, about the centre of mass."""
    weights = [masses[k - 1] for k in atoms] if masses else [1.0] * len(atoms)
    middle = centre(atoms, weights)
    squares = total([dot(d, d) * float(w) for d, w in ((minus(atom(k), middle), w) for k, w in zip(atoms, weights))])
    return F.sqrt(squares / float(sum(weights)))


def hydrogen_bonds(triples: Sequence[tuple[int, int, int]], reach: float = 3.6, least_angle: float = 130.0) -> Column:
    """Triples (donor, hydrogen, acceptor) with donor and acceptor within reach and a wide enough angle."""
    return total([F.when((distance(atom(a), atom(c)) < reach) & (bond_angle(a, b, c) > least_angle), 1).otherwise(0) for a, b, c in triples])


def order_parameter(pairs: Sequence[tuple[int, int]]) -> Column:
    """Second-rank order parameter: the largest eigenvalue of the mean of (3 v v - 1) / 2."""
    units = F.array(*[F.struct(*[c.alias(n) for c, n in zip(minus(atom(b), atom(a)), "xyz")]) for a, b in pairs])
    n = float(len(pairs))

    def entry(units: Column, i: str, j: str) -> Column:
        one = 1.0 if i == j else 0.0
        fold = F.aggregate(units, F.lit(0.0), lambda s, v: s + (3 * v[i] * v[j] / (v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]) - one) / 2)
        return fold / n

    def top(m: Column) -> Column:
        return symmetric_top(*[entry(m["units"], i, j) for i, j in ("xx", "yy", "zz", "xy", "xz", "yz")])

    return let({"units": units}, top)


def com(atoms: Sequence[int], masses: Sequence[float] | None = None, box: Sequence[float] | None = None) -> tuple[Column, Column, Column]:
    """Centre of a selection; in a periodic box by circular means."""
    weights = [masses[k - 1] for k in atoms] if masses else [1.0] * len(atoms)
    if box is None:
        return centre(atoms, weights)
    out = []
    for axis, size in enumerate(box):
        turns = [atom(k)[axis] * float(2 * 3.141592653589793 / size) for k in atoms]
        zeta = total([F.sin(t) * float(w) for t, w in zip(turns, weights)])
        xi = total([F.cos(t) * float(w) for t, w in zip(turns, weights)])
        out.append((F.atan2(-zeta, -xi) + F.pi()) * float(size / (2 * 3.141592653589793)))
    return tuple(out)


def rmsd_in_place(atoms: Sequence[int], reference: dict[str, list[float]]) -> Column:
    """Root mean square deviation from a reference without superposition."""
    parts = [(F.element_at(F.col(a), k) - float(reference[a][k - 1])) for k in atoms for a in ("x", "y", "z")]
    return F.sqrt(total([p * p for p in parts]) / float(len(atoms)))


def pair_list(atoms: Sequence[int]) -> list[tuple[int, int]]:
    return [(a, b) for i, a in enumerate(atoms) for b in atoms[:i]]


def drms(atoms: Sequence[int], reference: dict[str, list[float]], contact_radius: float | None = None) -> Column:
    """Root mean square difference of pair distances (or of smooth contacts) from the reference."""
    terms = []
    for a, b in pair_list(atoms):
        d0 = sum((reference[x][a - 1] - reference[x][b - 1]) ** 2 for x in ("x", "y", "z")) ** 0.5
        d = distance(atom(a), atom(b))
        if contact_radius is not None:
            d, d0 = sigmoid_contact(d, contact_radius), contact_radius**6 / (contact_radius**6 + d0**6)
        terms.append((d - float(d0)) * (d - float(d0)))
    return F.sqrt(total(terms) / float(len(terms)))


def around(centre_atoms: Sequence[int], radius: float, n_atoms: int, per_residue: int | None = None) -> Column:
    """Number of atoms (or of residues of `per_residue` atoms) within a radius of any chosen atom, in each frame."""
    near = [F.greatest(*[F.when(distance(atom(k), atom(c)) <= radius, 1).otherwise(0) for c in centre_atoms], F.lit(0)) for k in range(1, n_atoms + 1)]
    if per_residue is None:
        return total(near)
    groups = [near[i : i + per_residue] for i in range(0, n_atoms, per_residue)]
    return total([F.greatest(*g) if len(g) > 1 else g[0] for g in groups])
