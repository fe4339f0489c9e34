"""Shape measures of single frames: tilt and twist of axes, surfaces, volumes, pore radii."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .dense import per_frame

# --- axes -----------------------------------------------------------------------------------


def inertia_axis(xyz: np.ndarray, masses: np.ndarray | None = None) -> np.ndarray:
    """Long axis (F, 3) of each stack: the eigenvector of the smallest moment of inertia."""
    m = np.ones(xyz.shape[1]) if masses is None else masses
    d = xyz - np.einsum("fnd,n->fd", xyz, m)[:, None] / m.sum()
    squares = np.einsum("fnd,fnd,n->f", d, d, m)
    tensor = squares[:, None, None] * np.eye(3) - np.einsum("fni,fnj,n->fij", d, d, m)
    return np.linalg.eigh(tensor)[1][:, :, 0]


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
    return np.degrees(np.arccos(np.clip(c, -1, 1)))


def tilt(frames: DataFrame, axis: Sequence[int], segment: Sequence[int], oriented: bool = True) -> DataFrame:
    """(frame, tilt): degrees between the long axes of two selections.

    Oriented axes point from the first to the last atom of their selection and tilt by 0 to 180
    degrees; without orientation by 0 to 90.
    """
    one, two = np.array(axis) - 1, np.array(segment) - 1

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        axes = []
        for at in (one, two):
            v = inertia_axis(s[:, at])
            if oriented:
                v = v * np.where(((s[:, at[-1]] - s[:, at[0]]) * v).sum(-1) < 0, -1, 1)[:, None]
            axes.append(v)
        angle = _between(*axes)
        return {"tilt": angle if oriented else np.minimum(angle, 180 - angle)}

    return per_frame(frames, kernel, "tilt double")


def tilt_components(frames: DataFrame, axis: Sequence[int], reference: Sequence[int], segment: Sequence[int]) -> DataFrame:
    """(frame, theta, phi): the segment's long axis in a frame whose z is the axis selection's long axis
    and whose x points from it to the reference selection.

    The axis is oriented by its end points, which gives every frame its sign without looking back.
    """
    one, ref, two = (np.array(v) - 1 for v in (axis, reference, segment))

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        def pointing(at: np.ndarray) -> np.ndarray:
            v = inertia_axis(s[:, at])
            return v * np.where(((s[:, at[-1]] - s[:, at[0]]) * v).sum(-1) < 0, -1, 1)[:, None]

        z = pointing(one)
        x = s[:, ref].mean(1) - s[:, one].mean(1)
        x = x - (x * z).sum(-1, keepdims=True) * z
        x /= np.linalg.norm(x, axis=-1, keepdims=True)
        y = np.cross(z, x)
        v = pointing(two)
        return {"theta": _between(v, z), "phi": np.degrees(np.arctan2((v * y).sum(-1), (v * x).sum(-1)))}

    return per_frame(frames, kernel, "theta double, phi double")


def twist(frames: DataFrame, axis: Sequence[int], first: tuple[Sequence[int], Sequence[int]], second: tuple[Sequence[int], Sequence[int]]) -> DataFrame:
    """(frame, twist): degrees between two centre-to-centre vectors seen along the axis selection's long axis."""

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        z = inertia_axis(s[:, np.array(axis) - 1])
        flat = []
        for a, b in (first, second):
            v = s[:, np.array(b) - 1].mean(1) - s[:, np.array(a) - 1].mean(1)
            flat.append(v - (v * z).sum(-1, keepdims=True) * z)
        return {"twist": _between(*flat)}

    return per_frame(frames, kernel, "twist double")


# --- surfaces -------------------------------------------------------------------------------


@lru_cache
def sphere(divisions: int) -> np.ndarray:
    """Centres of the equal-share triangles of a unit sphere: the 60 faces of a pentakis dodecahedron,
    each cut into four divisions - 1 times."""
    g = (1 + 5**0.5) / 2
    ico = np.array([p for a in (-1, 1) for b in (-g, g) for p in ((0, a, b), (a, b, 0), (b, 0, a))], float)
    ico /= np.linalg.norm(ico, axis=1, keepdims=True)
    edge = np.sort(np.linalg.norm(ico[:, None] - ico[None], axis=-1)[0])[1] * 1.01
    near = np.linalg.norm(ico[:, None] - ico[None], axis=-1) < edge
    faces = [(i, j, k) for i in range(12) for j in range(i + 1, 12) for k in range(j + 1, 12) if near[i, j] and near[j, k] and near[i, k]]
    corner = np.array([ico[list(f)].sum(0) for f in faces])
    corner /= np.linalg.norm(corner, axis=1, keepdims=True)  # corners of the dodecahedron
    triangles = []
    for v in range(12):
        around = [k for k, f in enumerate(faces) if v in f]
        for i in around:
            for j in around:
                if i < j and len(set(faces[i]) & set(faces[j])) == 2:
                    triangles.append((ico[v], corner[i], corner[j]))
    for _ in range(divisions - 1):
        cut = []
        for a, b, c in triangles:
            ab, bc, ca = ((p + q) / np.linalg.norm(p + q) for p, q in ((a, b), (b, c), (c, a)))
            cut += [(a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca)]
        triangles = cut
    centre = np.array([a + b + c for a, b, c in triangles])
    return centre / np.linalg.norm(centre, axis=1, keepdims=True)


def _exposed(atoms: np.ndarray, radii: np.ndarray, measured: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Area of each measured atom's sphere that lies outside all other spheres."""
    out = np.zeros(len(measured))
    for k, i in enumerate(measured):
        if radii[i] <= 0:
            continue
        d = np.linalg.norm(atoms - atoms[i], axis=1)
        near = np.nonzero((d < radii + radii[i]) & (np.arange(len(atoms)) != i) & (radii > 0))[0]
        dots = atoms[i] + radii[i] * points
        free = np.ones(len(points), bool)
        for j in near:
            free &= ((dots - atoms[j]) ** 2).sum(1) >= radii[j] ** 2
        out[k] = 4 * np.pi * radii[i] ** 2 * free.mean()
    return out


def dotted_surface(frames: DataFrame, radii: Sequence[float], atoms: Sequence[int] | None = None, solvent: float = 1.4, divisions: int = 3, accessible: bool = True) -> DataFrame:
    """(frame, area): surface of the chosen atoms by dots; accessible to a solvent sphere, or of the bare spheres."""
    r = np.array(radii, float) + (solvent if accessible else 0.0)
    of = np.arange(len(r)) if atoms is None else np.array(atoms) - 1
    dots = sphere(divisions)
    return per_frame(frames, lambda s: {"area": np.array([_exposed(f, r, of, dots).sum() for f in s])}, "area double")


def filled_surface(frames: DataFrame, radii: Sequence[float], solvent: float = 1.4, divisions: int = 2, overlap: float = 0.8, smallest: float = 0.5) -> DataFrame:
    """(frame, area): surface of the spheres together with filling spheres in the gaps the solvent can't enter."""
    base = np.array(radii, float)
    dots = sphere(divisions)

    def area(atoms: np.ndarray) -> float:
        xyz, r = atoms.copy(), base.copy()
        while made := _filling(xyz, r, solvent, overlap, smallest, dots):  # ends, as spheres keep apart from each other
            xyz = np.vstack([xyz, np.array([m[0] for m in made])])
            r = np.append(r, [m[1] for m in made])
        return float(_exposed(xyz, r, np.arange(len(r)), dots).sum())

    return per_frame(frames, lambda s: {"area": np.array([area(f) for f in s])}, "area double")


def _filling(xyz: np.ndarray, r: np.ndarray, solvent: float, overlap: float, smallest: float, dots: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """New spheres between pairs too close for the solvent to pass and not overlapping too much."""
    made: list[tuple[np.ndarray, float]] = []
    for i in range(len(r)):
        for j in range(i):
            d = float(np.linalg.norm(xyz[i] - xyz[j]))
            big, small = max(r[i], r[j]), min(r[i], r[j])
            if d >= r[i] + r[j] + 2 * solvent or d <= big + small * (1 - 2 * overlap) or d + r[j] - r[i] <= 0:
                continue
            f = (d - r[j] + r[i]) / (d + r[j] - r[i])
            centre = (xyz[i] + f * xyz[j]) / (f + 1)
            if big < smallest:
                continue
            others = np.vstack([xyz, *[m[0][None] for m in made]])
            sizes = np.append(r, [m[1] for m in made])
            apart = np.linalg.norm(others - centre, axis=1)
            if (apart < np.abs(sizes - big) + 1e-6).any() or (apart < np.maximum(sizes, big) * (2 - 2 * overlap)).any():
                continue
            shell = centre + (big + solvent) * dots
            covered = (((shell[:, None] - xyz[None]) ** 2).sum(-1) < (r + solvent)[None] ** 2).any(1)
            if covered.all():
                made.append((centre, big))
    return made


def analytic_surface(frames: DataFrame, radii: Sequence[float], atoms: Sequence[int] | None = None, solvent: float = 1.4) -> DataFrame:
    """(frame, area): accessible surface from the arcs in which neighbours cut each sphere, in closed form."""
    r = np.array(radii, float) + solvent
    of = np.arange(len(r)) if atoms is None else np.array(atoms) - 1
    return per_frame(frames, lambda s: {"area": np.array([sum(arc_area(f, r, i) for i in of) for f in s])}, "area double")


def arc_area(xyz: np.ndarray, r: np.ndarray, i: int) -> float:
    """Exposed area of sphere i by the Gauss-Bonnet theorem over the arcs of its boundary.

    Each neighbour cuts a cap off the sphere; the exposed part is bounded by the arcs of cap circles
    that lie in no other cap. Its area is R^2 (2 pi chi + sum of arc curvatures + sum of corner turns).
    """
    R, centre = r[i], xyz[i]
    d = xyz - centre
    far = np.sqrt((d * d).sum(1))
    others = [j for j in range(len(r)) if j != i and r[j] > 0 and far[j] < R + r[j]]
    if any(far[j] + R <= r[j] + 1e-12 and (far[j] > 1e-12 or r[j] > R or j < i) for j in others):
        return 0.0
    caps = []  # axis, cosine of the half angle
    for j in others:
        if far[j] + r[j] <= R:
            continue
        caps.append((d[j] / far[j], (far[j] ** 2 + R * R - r[j] ** 2) / (2 * far[j] * R)))
    # drop caps that lie in others
    kept = []
    for a, (u, c) in enumerate(caps):
        inside = False
        for b, (v, e) in enumerate(caps):
            if a == b:
                continue
            gap = np.arccos(np.clip(u @ v, -1, 1))
            if gap + np.arccos(np.clip(c, -1, 1)) < np.arccos(np.clip(e, -1, 1)) + 1e-12 and (gap > 1e-12 or c > e or a > b):
                inside = True
                break
        if not inside:
            kept.append((u, float(np.clip(c, -1, 1))))
    if not kept:
        return 4 * np.pi * R * R
    total, corners, whole = 0.0, [], 0
    for a, (u, c) in enumerate(kept):
        s = np.sqrt(max(0.0, 1 - c * c))
        side = np.array([1.0, 0, 0]) if abs(u[0]) < 0.9 else np.array([0, 1.0, 0])
        p = np.cross(u, side)
        p /= np.linalg.norm(p)
        q = np.cross(u, p)
        covered = []
        hidden = False
        for b, (v, e) in enumerate(kept):
            if a == b:
                continue
            # points c u + s (cos t p + sin t q) lie in cap b where their product with v is over e
            x, y, k = s * (v @ p), s * (v @ q), e - c * (v @ u)
            size = np.hypot(x, y)
            if k >= size:
                continue
            if k <= -size:
                hidden = True
                break
            middle, half = np.arctan2(y, x), np.arccos(k / size)
            covered.append(((middle - half) % (2 * np.pi), 2 * half, b))
        if hidden:
            continue
        if not covered:
            total += 2 * np.pi * c
            whole += 1
            continue
        covered.sort()
        marks = [(start, start + size, b) for start, size, b in covered]
        reach, by = max((m[1] - 2 * np.pi, m[2]) for m in marks)
        arcs = []
        for start, end, b in marks:
            if start > reach + 1e-12:
                arcs.append((reach, start, by, b))
            if end > reach:
                reach, by = end, b
        for start, end, before, after in arcs:
            total += (end - start) * c
            corners.append((a, start, before, end, after))
    # the exterior angle at a corner is the angle between the two circles' tangents
    turns = 0.0
    for a, _, before, _, _ in corners:
        (u, c), (v, e) = kept[a], kept[before]
        s1, s2 = np.sqrt(max(0.0, 1 - c * c)), np.sqrt(max(0.0, 1 - e * e))
        turns += np.arccos(np.clip((u @ v - c * e) / (s1 * s2), -1, 1))
    if not corners and not whole:
        return 0.0
    loops = whole + _loops(kept, corners)
    area = 2 * np.pi * (2 - loops) + total - turns
    while area < -1e-9:
        area += 4 * np.pi
    while area > 4 * np.pi + 1e-9:
        area -= 4 * np.pi
    return float(area * R * R)


def _loops(kept: list, corners: list) -> int:
    """Number of closed boundaries that the arcs form: an arc's end is the next arc's start."""

    def at(a: int, t: float) -> np.ndarray:
        u, c = kept[a]
        side = np.array([1.0, 0, 0]) if abs(u[0]) < 0.9 else np.array([0, 1.0, 0])
        p = np.cross(u, side)
        p /= np.linalg.norm(p)
        return c * u + np.sqrt(max(0.0, 1 - c * c)) * (np.cos(t) * p + np.sin(t) * np.cross(u, p))

    starts = [at(a, s) for a, s, *_ in corners]
    ends = [at(a, e) for a, _, _, e, _ in corners]
    left, count = set(range(len(corners))), 0
    while left:
        k = left.pop()
        count += 1
        while True:
            gaps = [(float(((ends[k] - starts[j]) ** 2).sum()), j) for j in left]
            here = min(gaps, default=(np.inf, -1))
            if here[0] > 1e-10:
                break
            k = here[1]
            left.discard(k)
    return count


# --- volumes --------------------------------------------------------------------------------

# Radii by element (fixed values).
ELEMENT_RADII = {"C": 1.70, "O": 1.52, "S": 1.80, "N": 1.55, "H": 1.20, "P": 1.80}
OTHER_RADIUS = 2.0


def filled_voxels(xyz: np.ndarray, radii: np.ndarray, low: np.ndarray, step: float, shape: tuple[int, int, int]) -> np.ndarray:
    """Voxels whose centre lies in a sphere; only the box around each sphere is looked at."""
    out = np.zeros(shape, bool)
    for p, r in zip(xyz, radii):
        a = np.maximum(np.floor((p - r - low) / step).astype(int), 0)
        b = np.minimum(np.ceil((p + r - low) / step).astype(int) + 1, shape)
        if (b <= a).any():
            continue
        grids = [low[k] + (np.arange(a[k], b[k]) + 0.5) * step - p[k] for k in range(3)]
        inside = grids[0][:, None, None] ** 2 + grids[1][None, :, None] ** 2 + grids[2][None, None] ** 2 <= r * r
        out[a[0] : b[0], a[1] : b[1], a[2] : b[2]] |= inside
    return out


def volumes(frames: DataFrame, radii: Sequence[float], ligand: Sequence[int], step: float = 0.5, margin: float = 2.0) -> DataFrame:
    """(frame, volume, ligand, overlap, difference) by voxels: of all atoms, of a part, of what the part
    shares with the rest, and of what it doesn't."""
    r = np.array(radii, float)
    of = np.zeros(len(r), bool)
    of[np.array(ligand) - 1] = True

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        rows = []
        for f in s:
            low = np.floor((f.min(0) - r.max() - margin) / step) * step
            shape = tuple(np.ceil((f.max(0) + r.max() + margin - low) / step).astype(int) + 1)
            part, rest = filled_voxels(f[of], r[of], low, step, shape), filled_voxels(f[~of], r[~of], low, step, shape)
            rows.append([(part | rest).sum(), part.sum(), (part & rest).sum(), (part & ~rest).sum()])
        v = np.array(rows, float) * step**3
        return {c: v[:, k] for k, c in enumerate(("volume", "ligand", "overlap", "difference"))}

    return per_frame(frames, kernel, "volume double, ligand double, overlap double, difference double")


def pore(frames: DataFrame, radii: Sequence[float], point: Sequence[float], vector: Sequence[float], step: float = 0.1, widest: float = 10.0, trials: int = 1000, seed: int = 1989) -> DataFrame:
    """(frame, at, radius): largest sphere at every step along a pore, both ways until it is wider than `widest`.

    At each plane the centre walks at random within it, with a falling temperature, to where the
    nearest atom's surface is farthest. The walk is seeded by the frame's place in its batch only
    through its coordinates, so results don't depend on how frames are dealt.
    """
    r = np.array(radii, float)
    z = np.array(vector, float) / np.linalg.norm(vector)
    x = np.cross(z, [1.0, 0, 0] if abs(z[0]) < 0.9 else [0, 1.0, 0])
    x /= np.linalg.norm(x)
    y = np.cross(z, x)

    def best(atoms: np.ndarray, sizes: np.ndarray, centre: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        def gap(c: np.ndarray) -> float:
            return float((np.sqrt(((atoms - c) ** 2).sum(1)) - sizes).min())

        now = top = gap(centre)
        at = at_top = centre
        heat = 0.1
        for _ in range(trials):
            move = rng.normal(0, 0.1, 2)
            there = at + move[0] * x + move[1] * y
            value = gap(there)
            if value > now or rng.random() < np.exp((value - now) / max(heat, 1e-9)):
                at, now = there, value
                if now > top:
                    at_top, top = at, now
            heat *= 0.9
        return at_top, top

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        places, found = [], []
        for f in s:
            profile = {}
            for way in (1, -1):
                rng = np.random.default_rng(seed)
                centre, k = np.array(point, float), 0 if way == 1 else -1
                centre = centre if way == 1 else centre - step * z
                while True:
                    near = np.abs((f - centre) @ z) < widest + r.max() + 5
                    if not near.any():
                        break
                    centre, radius = best(f[near], r[near], centre, rng)
                    profile[k] = radius
                    if radius > widest:
                        break
                    centre = centre + way * step * z
                    k += way
            order = sorted(profile)
            places.append([k * step for k in order])
            found.append([profile[k] for k in order])
        return {"at": np.array(places + [None], object)[:-1].reshape(-1), "radius": np.array(found + [None], object)[:-1].reshape(-1)}

    from pyspark.sql import functions as F

    rows = per_frame(frames, kernel, "at array<double>, radius array<double>")
    return rows.select("frame", F.explode(F.arrays_zip("at", "radius")).alias("p")).select("frame", "p.at", "p.radius")
