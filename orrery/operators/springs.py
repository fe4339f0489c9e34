"""Elastic networks: normal modes of a structure whose near atoms are joined by springs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions.linalg import eigh_desc
from .dense import per_frame

BOLTZMANN = 1.380649e-3  # in units that give Angstrom^2 with k in N/m x 1e2


def linear(cutoff: float, k: float = 1.0, bonded: float = 10.0) -> Callable[[np.ndarray], np.ndarray]:
    """Spring constants by distance: one value under the cutoff, a stiffer one between neighbours in order."""

    def of(d: np.ndarray) -> np.ndarray:
        out = np.where(d < cutoff, k, 0.0)
        i = np.arange(len(d) - 1)
        out[i, i + 1] = out[i + 1, i] = bonded
        np.fill_diagonal(out, 0)
        return out

    return of


def sixth_power(k: float = 1.0, contact: float = 3.8) -> Callable[[np.ndarray], np.ndarray]:
    """Spring constants that fall with the sixth power of the distance, (3.8 / d)^6 k."""

    def of(d: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            out = k * (contact / d) ** 6
        np.fill_diagonal(out, 0)
        return out

    return of


def hessian(xyz: np.ndarray, springs: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Second derivatives (3N, 3N) of the network's energy."""
    d = xyz[:, None] - xyz[None]
    r = np.sqrt((d * d).sum(-1))
    k = springs(r)
    with np.errstate(invalid="ignore", divide="ignore"):
        u = np.where(r[..., None] > 0, d / r[..., None], 0)
    blocks = -k[..., None, None] * u[..., :, None] * u[..., None, :]
    n = len(xyz)
    i = np.arange(n)
    blocks[i, i] = -blocks.sum(1)
    return blocks.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n)


def modes(h: np.ndarray, still: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors (columns) without the rigid motions, the softest first."""
    values, vectors = np.linalg.eigh(h)
    return values[still:], vectors[:, still:]


def b_factors(values: np.ndarray, vectors: np.ndarray, temperature: float = 300.0) -> np.ndarray:
    """8 pi^2 k T / 3 times the mean square displacement of each atom."""
    keep = values > 1e-9
    square = (vectors[:, keep] ** 2 / values[keep]).sum(1).reshape(-1, 3).sum(1)
    return 8 * np.pi**2 / 3 * BOLTZMANN * temperature * square


def correlation(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cross correlation of atoms' displacements over all modes."""
    keep = values > 1e-9
    scaled = vectors[:, keep] / np.sqrt(values[keep])
    v = scaled.reshape(-1, 3, scaled.shape[1])
    c = np.einsum("idm,jdm->ij", v, v)
    own = np.sqrt(np.diag(c))
    return c / own[:, None] / own[None]


def effective(h: np.ndarray, kept: Sequence[int]) -> np.ndarray:
    """Hessian of a part with the rest relaxed: Hss - Hse Hee^-1 Hes."""
    at = np.concatenate([[3 * k - 3, 3 * k - 2, 3 * k - 1] for k in kept]).astype(int)
    rest = np.setdiff1d(np.arange(len(h)), at)
    return h[np.ix_(at, at)] - h[np.ix_(at, rest)] @ np.linalg.pinv(h[np.ix_(rest, rest)]) @ h[np.ix_(rest, at)]


def rigid_blocks(xyz: np.ndarray, blocks: Sequence[Sequence[int]], masses: np.ndarray | None = None) -> np.ndarray:
    """Orthonormal projector (3N, 6B) onto translations and rotations of rigid blocks of atoms (from 1)."""
    masses = np.ones(len(xyz)) if masses is None else masses
    out = np.zeros((3 * len(xyz), 6 * len(blocks)))
    for b, atoms in enumerate(blocks):
        at = np.array(atoms) - 1
        root = np.sqrt(masses[at])
        d = xyz[at] - (xyz[at] * masses[at, None]).sum(0) / masses[at].sum()
        columns = np.zeros((len(at), 3, 6))
        for k in range(3):
            columns[:, k, k] = root
        x, y, z = (d * root[:, None]).T
        columns[:, 1, 3], columns[:, 2, 3] = -z, y
        columns[:, 0, 4], columns[:, 2, 4] = z, -x
        columns[:, 0, 5], columns[:, 1, 5] = -y, x
        q, _ = np.linalg.qr(columns.reshape(-1, 6))
        rows = (3 * at[:, None] + np.arange(3)).ravel()
        out[rows, 6 * b : 6 * b + 6] = q
    return out


def block_modes(h: np.ndarray, projector: np.ndarray, still: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Modes of the reduced Hessian, taken back to all atoms."""
    values, vectors = np.linalg.eigh(projector.T @ h @ projector)
    return values[still:], (projector @ vectors)[:, still:]


def overlap(vectors: np.ndarray, other: np.ndarray) -> np.ndarray:
    """|v1 . v2| of every mode of one set (columns) with every one of another, or with one displacement."""
    other = other[:, None] if other.ndim == 1 else other
    return np.abs((vectors / np.linalg.norm(vectors, axis=0)).T @ (other / np.linalg.norm(other, axis=0)))


def cumulative_overlap(overlaps: np.ndarray) -> np.ndarray:
    """Cumulative square overlap sqrt(sum o^2) of each column over the first modes."""
    return np.sqrt(np.cumsum(overlaps**2, axis=0))


def inner_product(a: np.ndarray, b: np.ndarray, modes: int = 10) -> float:
    """Root mean square inner product of the first modes of two sets."""
    return float(np.sqrt((overlap(a[:, :modes], b[:, :modes]) ** 2).sum() / modes))


def deformation(xyz: np.ndarray, springs: Callable[[np.ndarray], np.ndarray], vector: np.ndarray, value: float) -> np.ndarray:
    """Energy of each atom's springs when the structure moves along a mode."""
    moved = xyz + vector.reshape(-1, 3)
    r0 = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    r1 = np.sqrt(((moved[:, None] - moved[None]) ** 2).sum(-1))
    return (0.5 * springs(r0) * (r1 - r0) ** 2).sum(1) / (len(xyz) * value)


def perturbation(xyz: np.ndarray, springs: Callable[[np.ndarray], np.ndarray], vectors: np.ndarray, values: np.ndarray, delta: float = 0.1) -> np.ndarray:
    """Change of each mode's frequency (atoms by modes) when the springs of one atom stiffen by delta."""
    d = xyz[:, None] - xyz[None]
    r = np.sqrt((d * d).sum(-1))
    k = springs(r)
    with np.errstate(invalid="ignore", divide="ignore"):
        u = np.where(r[..., None] > 0, d / r[..., None], 0)
    v = vectors.reshape(len(xyz), 3, -1)
    stretch = np.einsum("ijd,ijdm->ijm", u, v[:, None] - v[None])
    gained = delta * (k[..., None] * stretch**2).sum(1)
    return np.sqrt(np.maximum(values + gained, 0)) - np.sqrt(np.maximum(values, 0))


def per_frame_modes(frames: DataFrame, springs: Callable[[np.ndarray], np.ndarray], count: int = 5) -> DataFrame:
    """(frame, trace, values array, b_factors array): softest modes of every frame's network."""

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        trace, values, b = [], [], []
        for f in s:
            h = hessian(f, springs)
            w, v = modes(h)
            trace.append(np.trace(h))
            values.append(w[:count])
            b.append(b_factors(w, v))
        return {"trace": np.array(trace), "values": np.array(values), "b_factors": np.array(b)}

    return per_frame(frames, kernel, "trace double, values array<double>, b_factors array<double>")


def principal(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return eigh_desc(cov)
