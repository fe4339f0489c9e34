"""Declarative analysis: BEGIN ... END blocks compiled into few plans.

All blocks that are projections of a frame become one select over one scan, whatever their number;
dense per-frame blocks are joined to it by frame; whole-trajectory blocks are plans of their own.
New modules are registered under their name with a function that makes columns or a frame.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..functions.selection import select
from ..operators import dense, manipulate, measures
from ..schema import points, reference


class BlockError(ValueError):
    """An input block that cannot be read."""


@dataclass
class Block:
    module: str
    options: list[tuple[str, str]] = field(default_factory=list)

    def all(self, name: str) -> list[str]:
        return [v for k, v in self.options if k == name]

    def one(self, name: str, default: str | None = None) -> str | None:
        found = self.all(name)
        return found[-1] if found else default

    def flag(self, name: str) -> bool:
        return any(k == name for k, _ in self.options)


def parse(text: str) -> list[Block]:
    """Blocks of an input text; # starts a comment, module names are not case-sensitive."""
    out: list[Block] = []
    block: Block | None = None
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        words = line.split(None, 1)
        head = words[0].upper()
        if head == "BEGIN":
            if block is not None or len(words) < 2:
                raise BlockError(f"line {number}: BEGIN wants a module, outside of other blocks")
            block = Block(words[1].strip().lower())
        elif head == "END":
            if block is None:
                raise BlockError(f"line {number}: END without BEGIN")
            out.append(block)
            block = None
        elif block is None or not line.startswith("--"):
            raise BlockError(f"line {number}: --OPTION wanted within a block")
        else:
            block.options.append((words[0][2:].upper(), words[1].strip() if len(words) > 1 else ""))
    if block is not None:
        raise BlockError("last block has no END")
    return out


@dataclass
class Context:
    """What blocks are compiled against: frames, atoms, and the reference structure."""

    frames: DataFrame
    atoms: DataFrame
    reference: dict[str, list[float]]
    masses: list[float] | None = None
    box: tuple[float, float, float] | None = None

    def selection(self, text: str) -> list[int]:
        """Atom numbers of a selection, resolved once on the structure."""
        found = sorted(r["atom_id"] for r in select(self.atoms, text.strip()).select("atom_id").collect())
        if not found:
            raise BlockError(f"nothing selected by {text!r}")
        return found

    def weights(self, block: Block) -> list[float] | None:
        """Masses for a block that asks for them."""
        if not block.flag("MASS"):
            return None
        if not self.masses or not sum(self.masses):
            raise BlockError(f"{block.module}: --MASS wants masses, given or in the structure's B-factor column")
        return self.masses


Projection = Callable[[Block, Context], list[Column]]
Framed = Callable[[Block, Context], DataFrame]
PROJECTIONS: dict[str, Projection] = {}
DENSE: dict[str, Framed] = {}
WHOLE: dict[str, Framed] = {}


def projection(name: str):
    """Register a module whose output is columns of the frame it is computed from."""
    return lambda f: PROJECTIONS.setdefault(name, f)


def dense_module(name: str):
    """Register a module that makes (frame, columns...)."""
    return lambda f: DENSE.setdefault(name, f)


def whole(name: str):
    """Register a module that makes a table about the whole trajectory."""
    return lambda f: WHOLE.setdefault(name, f)


def _title(block: Block, default: str) -> str:
    return re.sub(r"\W+", "_", block.one("TITLE", default))


def _sides(text: str, n: int) -> list[str]:
    sides = [s.strip() for s in text.split(":")]
    if len(sides) != n:
        raise BlockError(f"{n} parts wanted in {text!r}")
    return sides


@projection("distance")
def _distance(block: Block, on: Context) -> list[Column]:
    title = _title(block, "dist")
    pairs = [[on.selection(s) for s in _sides(text, 2)] for text in block.all("SELE")]
    return [measures.pair_distance(tuple(p), on.weights(block), on.box).alias(title if len(pairs) == 1 else f"{title}_{k + 1}") for k, p in enumerate(pairs)]


@projection("contacts")
def _contacts(block: Block, on: Context) -> list[Column]:
    groups: dict[float, list] = {}
    for text in block.all("SELE"):
        a, b, cutoff = _sides(text, 3)
        groups.setdefault(float(cutoff), []).append((on.selection(a), on.selection(b)))
    parts = [measures.contacts(pairs, cutoff, on.weights(block), on.box) for cutoff, pairs in groups.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [total.alias(_title(block, "cont"))]


@projection("angle")
def _angle(block: Block, on: Context) -> list[Column]:
    i, j, k = (on.selection(s)[0] for s in _sides(block.one("SELE", ""), 3))
    return [measures.bond_angle(i, j, k).alias(_title(block, "angle"))]


@projection("dihedral")
def _dihedral(block: Block, on: Context) -> list[Column]:
    i, j, k, m = (on.selection(s)[0] for s in _sides(block.one("SELE", ""), 4))
    return [measures.torsion(i, j, k, m).alias(_title(block, "dihe"))]


@projection("rgyr")
def _gyration(block: Block, on: Context) -> list[Column]:
    return [measures.gyration(on.selection(block.one("SELE", "/*/*/*/*")), on.weights(block)).alias(_title(block, "rgyr"))]


@projection("hbond")
def _hydrogen_bonds(block: Block, on: Context) -> list[Column]:
    triples = [tuple(on.selection(s)[0] for s in _sides(text, 3)) for text in block.all("SELE")]
    return [measures.hydrogen_bonds(triples, float(block.one("DIST", "3.6")), float(block.one("ANGLE", "130"))).alias(_title(block, "hb"))]


@projection("orienta")
def _orientation(block: Block, on: Context) -> list[Column]:
    pairs = [tuple(on.selection(s)[0] for s in _sides(text, 2)) for text in block.all("SELE")]
    return [measures.order_parameter(pairs).alias(_title(block, "p2"))]


@projection("com")
def _com(block: Block, on: Context) -> list[Column]:
    title = _title(block, "com")
    columns = measures.com(on.selection(block.one("SELE", "/*/*/*/*")), on.weights(block), on.box if block.flag("PBC") else None)
    return [c.alias(f"{title}_{a}") for a, c in zip("xyz", columns)]


@projection("within")
def _within(block: Block, on: Context) -> list[Column]:
    m = re.fullmatch(r"(.*)\[(\d+(?:\.\d*)?)\]", block.one("SELE", "").strip())
    if not m:
        raise BlockError("within wants a selection with a distance, sele[5.0]")
    return [measures.around(on.selection(m[1]), float(m[2]), len(on.reference["x"])).alias(_title(block, "within"))]


@dense_module("drms")
def _drms(block: Block, on: Context) -> DataFrame:
    radius = block.one("CMAPD")
    return dense.drms(on.frames, on.reference, on.selection(block.one("SELE", "/*/*/*/*")), (float(radius) if radius else None,)).withColumnRenamed("d0", _title(block, "drms"))


@dense_module("rmsd")
def _rmsd(block: Block, on: Context) -> DataFrame:
    atoms, title = on.selection(block.one("SELE", "/*/*/*/*")), _title(block, "rmsd")
    if len(atoms) < 3:
        raise BlockError("rmsd wants three atoms or more")
    if block.flag("PROGRESSIVE"):
        return manipulate.progressive_rmsd(manipulate.project(on.frames, atoms)).withColumnRenamed("rmsd", title)
    if block.flag("NOSUPER"):
        return on.frames.select("frame", measures.rmsd_in_place(atoms, on.reference).alias(title))
    fit = on.selection(block.one("FIT")) if block.one("FIT") else atoms
    return dense.rmsd(on.frames, on.reference, fit, atoms).withColumnRenamed("rmsd", title)


@whole("rmsf")
def _rmsf(block: Block, on: Context) -> DataFrame:
    atoms = on.selection(block.one("SELE", "/*/*/*/*"))
    return manipulate.fluctuation(points(on.frames), on.reference).where(f"atom_id in ({', '.join(map(str, atoms))})")


@whole("avg")
def _average(block: Block, on: Context) -> DataFrame:
    return manipulate.average(points(on.frames))


@whole("pca")
def _pca(block: Block, on: Context) -> DataFrame:
    values, _, share = dense.modes(dense.covariance(on.frames, on.reference, on.selection(block.one("SELE", "/*/*/*/*")))[0])
    rows = [(k + 1, float(v), float(s)) for k, (v, s) in enumerate(zip(values, share))]
    return on.frames.sparkSession.createDataFrame(rows, "mode int, value double, share double")


def run(text: str, on: Context) -> dict[str, DataFrame]:
    """`frames`: one row per frame with the columns of all per-frame blocks; others by name and number."""
    columns: list[Column] = []
    joined: list[DataFrame] = []
    out: dict[str, DataFrame] = {}
    for number, block in enumerate(parse(text), 1):
        # a module may be written longer than its name
        name = next((n for table in (PROJECTIONS, DENSE, WHOLE) for n in sorted(table, key=len, reverse=True) if block.module.startswith(n)), None)
        if name is None:
            raise BlockError(f"no module {block.module!r}")
        if name in PROJECTIONS:
            columns += PROJECTIONS[name](block, on)
        elif name in DENSE:
            joined.append(DENSE[name](block, on))
        else:
            out[f"{name}_{number}"] = WHOLE[name](block, on)
    if columns or joined:
        rows = on.frames.select("frame", *columns)
        for part in joined:
            rows = rows.join(part, "frame", "left")
        out["frames"] = rows
    return out


def context(frames: DataFrame, atoms: DataFrame, masses: list[float] | None = None, box: tuple[float, float, float] | None = None) -> Context:
    """The structure's own coordinates are the reference, and its B-factors the masses unless others are given.

    A structure without coordinates leaves the first frame as the reference.
    """
    if not {"x", "y", "z"} <= set(atoms.columns):
        return Context(frames, atoms, reference(frames), masses, box)
    more = ["b_factor"] if "b_factor" in atoms.columns else []
    rows = atoms.select("atom_id", "x", "y", "z", *more).orderBy("atom_id").collect()  # one structure
    if masses is None and more:
        masses = [float(r["b_factor"] or 0.0) for r in rows]
    return Context(frames, atoms, {a: [float(r[a]) for r in rows] for a in ("x", "y", "z")}, masses, box)
