"""Secondary structure of a protein chain from backbone hydrogen bonds, one letter per residue."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .dense import per_frame

# Energy scale, single cutoff, and the weighted cutoffs of the continuous assignment.
SCALE = 27.888
CUTOFF = -0.5
CUTOFFS = (-0.1, -0.2, -0.3, -0.4, -0.5, -0.6, -0.7, -0.8, -0.9, -1.0)
CUTOFF_WEIGHTS = (4, 7, 23, 23, 22, 14, 7, 4, 2, 1)
BEND = 70.0
ORDER = "HBEGITSLX"


def bond_energies(n: np.ndarray, h: np.ndarray, c: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Energies (R, R) of the bonds from donor residue (row) to acceptor residue (column).

    Missing atoms are NaN and bond with nothing; a residue doesn't bond with itself or its neighbours.
    """

    def inverse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return 1 / np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))

    e = SCALE * (inverse(n, o) + inverse(h, c) - inverse(h, o) - inverse(n, c))
    i = np.arange(len(n))
    e[np.abs(i[:, None] - i[None]) < 2] = 0
    return np.where(np.isfinite(e), e, 0.0)


def _letters(bonds: np.ndarray, ca: np.ndarray) -> str:
    """Letters of one set of bonds: H and the bridges come first, then the other turns and bends."""
    size = len(bonds)
    mark = [""] * size

    def bond(donor: int, acceptor: int) -> bool:
        return 0 <= donor < size and 0 <= acceptor < size and bool(bonds[donor, acceptor])

    turns = {n: [bond(k + n, k) for k in range(size)] for n in (3, 4, 5)}

    def helix(n: int, letter: str) -> None:
        for k in range(1, size - n):
            if turns[n][k - 1] and turns[n][k]:
                span = range(k, k + n)
                if letter == "H" or all(mark[i] in ("", letter) for i in span):
                    for i in span:
                        mark[i] = letter

    helix(4, "H")
    bridged: dict[int, set[tuple[int, str]]] = {}
    for i in range(1, size - 1):
        for j in range(i + 3, size - 1):
            along = (bond(i, j - 1) and bond(j + 1, i)) or (bond(j, i - 1) and bond(i + 1, j))
            against = (bond(i, j) and bond(j, i)) or (bond(i + 1, j - 1) and bond(j + 1, i - 1))
            for yes, kind in ((along, "p"), (against, "a")):
                if yes:
                    bridged.setdefault(i, set()).add((j, kind))
                    bridged.setdefault(j, set()).add((i, kind))

    def ladder(i: int) -> bool:
        for j, kind in bridged[i]:
            for step in (-1, 1):
                other = j + step if kind == "p" else j - step
                if (other, kind) in bridged.get(i + step, ()):
                    return True
        return False

    for i in bridged:
        if mark[i] != "H":
            mark[i] = "E" if ladder(i) else "B"
    helix(3, "G")
    helix(5, "I")
    for n in (3, 4, 5):
        for k in range(size - n):
            if turns[n][k]:
                for i in range(k + 1, k + n):
                    mark[i] = mark[i] or "T"
    for k in range(2, size - 2):
        a, b = ca[k] - ca[k - 2], ca[k + 2] - ca[k]
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())
        if np.isfinite(cosine) and np.degrees(np.arccos(np.clip(cosine, -1, 1))) > BEND:
            mark[k] = mark[k] or "S"
    return "".join(m or ("L" if np.isfinite(ca[k]).all() else "X") for k, m in enumerate(mark))


def assign(backbone: np.ndarray, continuous: bool = False) -> str:
    """Letters of a frame's backbone (R, 5, 3) of N, H, CA, C, O; NaN where an atom is missing.

    `continuous` repeats the assignment at ten cutoffs and lets their weights vote, ties in ORDER.
    """
    n, h, ca, c, o = (backbone[:, k] for k in range(5))
    e = bond_energies(n, h, c, o)
    if not continuous:
        return _letters(e < CUTOFF, ca)
    each = [_letters(e < cutoff, ca) for cutoff in CUTOFFS]
    out = []
    for k in range(len(backbone)):
        votes: dict[str, int] = {}
        for letters, w in zip(each, CUTOFF_WEIGHTS):
            votes[letters[k]] = votes.get(letters[k], 0) + w
        out.append(max(votes, key=lambda s: (votes[s], -ORDER.index(s))))
    return "".join(out)


def secondary_structure(frames: DataFrame, backbone: Sequence[tuple[int | None, int | None, int | None, int | None, int | None]], continuous: bool = False) -> DataFrame:
    """(frame, ss): letters of residues given by the numbers of their N, H, CA, C and O atoms (from 1)."""
    at = np.array([[(k or 0) - 1 for k in residue] for residue in backbone])

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        xyz = np.where((at >= 0)[None, :, :, None], s[:, np.maximum(at, 0)], np.nan)
        return {"ss": np.array([assign(f, continuous) for f in xyz], object)}

    return per_frame(frames, kernel, "ss string")
