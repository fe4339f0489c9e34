"""Trajectory and structure manipulation: merging, extracting, combining, averaging, listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AXES


def sample(frames: DataFrame, begin: int = 1, end: int | None = None, skip: int = 1) -> DataFrame:
    """Every skip-th frame from begin to end; the condition on `frame` reaches the scan."""
    out = frames.where(F.col("frame") >= begin)
    out = out if end is None else out.where(F.col("frame") <= end)
    return out if skip == 1 else out.where((F.col("frame") - begin) % skip == 0)


def pick(frames: DataFrame, wanted: DataFrame | Sequence[int]) -> DataFrame:
    """Frames of a list, as often and in the order (`ord`) that the list names them."""
    if isinstance(wanted, DataFrame):
        return frames.join(wanted, "frame")
    spark = frames.sparkSession
    rows = spark.createDataFrame([(k, int(f)) for k, f in enumerate(wanted)], "ord long, frame long")
    return frames.join(F.broadcast(rows), "frame")


def project(frames: DataFrame, atoms: Sequence[int]) -> DataFrame:
    """Only the named atoms (from 1), in the order of their numbers; nothing else of the frame changes."""
    keep = F.array(*[F.lit(k) for k in sorted(set(atoms))])

    def chosen(axis: str):
        return F.transform(keep, lambda k: F.element_at(F.col(axis), k))

    return frames.withColumns({a: chosen(a) for a in AXES})


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """Trajectories one after another, with frames numbered on."""
    out, offset = None, 0
    for part in parts:
        moved = part.withColumn("frame", F.col("frame") + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += part.agg(F.coalesce(F.max("frame"), F.lit(0))).first()[0]
    return out


def append_structure(frames: DataFrame, structure: dict[str, list[float]]) -> DataFrame:
    """One more frame, the given structure, after the last."""
    last = frames.agg((F.coalesce(F.max("frame"), F.lit(0)) + 1).alias("frame"))
    row = last.select(*[F.lit(None).cast(frames.schema[c].dataType).alias(c) if c not in ("frame", *AXES) else (F.col(c) if c == "frame" else F.lit([float(v) for v in structure[c]]).alias(c)) for c in frames.columns])
    return frames.unionByName(row)


def keys(*tables: DataFrame) -> list[str]:
    """What names a frame in all of the tables: its number, and its trajectory where each names one."""
    return [c for c in ("traj_id", "frame") if all(c in t.columns for t in tables)]


def _both(value: Column, name: str) -> Column:
    """A column that must be there on both sides of a full join."""
    return F.coalesce(value, F.raise_error(F.lit(f"trajectories of different frames: {name} is missing in one of them")))


def add_up(parts: Sequence[DataFrame], reference: dict[str, list[float]], atoms: Sequence[int]) -> DataFrame:
    """reference + sum over trajectories of (trajectory - reference) on the chosen atoms; others stay as in the reference."""
    chosen = set(atoms)
    by = keys(*parts)
    whole = parts[0].select(*by, *AXES)
    for part in parts[1:]:
        other = part.select(*by, *[F.col(a).alias(f"o{a}") for a in AXES])
        whole = whole.join(other, by).select(
            *by, *[F.zip_with(F.zip_with(F.col(a), F.col(f"o{a}"), lambda p, q: p + q), F.lit([float(v) for v in reference[a]]), lambda s, r: s - r).alias(a) for a in AXES]
        )
    mask = F.lit([k + 1 in chosen for k in range(len(reference["x"]))])
    still = {a: F.lit([float(v) for v in reference[a]]) for a in AXES}
    return whole.select(*by, *[F.transform(F.arrays_zip(F.col(a).alias("v"), mask.alias("m"), still[a].alias("r")), lambda t: F.when(t["m"], t["v"]).otherwise(t["r"])).alias(a) for a in AXES])


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Atoms of two trajectories in one, frame by frame; a frame that one of them lacks is an error."""
    by = keys(left, right)
    other = right.select(*by, *[F.col(a).alias(f"o{a}") for a in AXES])
    return left.select(*by, *AXES).join(other, by, "full").select(*by, *[F.concat(_both(F.col(a), a), _both(F.col(f"o{a}"), a)).alias(a) for a in AXES])


def average(points: DataFrame) -> DataFrame:
    """Mean position of every atom over the frames: one partial row per atom and task is shuffled."""
    return points.groupBy("atom_id").agg(*[F.avg(a).alias(a) for a in AXES])


def fluctuation(points: DataFrame, reference: dict[str, list[float]]) -> DataFrame:
    """(atom_id, rmsf): root mean square distance of every atom from its reference, without superposition."""
    d2 = sum((F.col(a) - F.element_at(F.lit([float(v) for v in reference[a]]), F.col("atom_id"))) ** 2 for a in AXES)
    return points.groupBy("atom_id").agg(F.sqrt(F.avg(d2)).alias("rmsf"))


def previous(frames: DataFrame) -> DataFrame:
    """Each frame with the coordinates of the one before (px, py, pz) by one equi-join, in place of a
    window that would gather a whole trajectory in one task."""
    by = keys(frames)
    before = frames.select(*[(F.col(c) + 1).alias(c) if c == "frame" else F.col(c) for c in by], *[F.col(a).alias(f"p{a}") for a in AXES])
    return frames.select(*by, *AXES).join(before, by)


def progressive_rmsd(frames: DataFrame) -> DataFrame:
    """([traj_id,] frame, rmsd): deviation from the frame before in the same trajectory, in place."""
    squares = [F.aggregate(F.zip_with(F.col(a), F.col(f"p{a}"), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v) for a in AXES]
    return previous(frames).select(*keys(frames), F.sqrt((squares[0] + squares[1] + squares[2]) / F.size("x")).alias("rmsd"))


def header(frames: DataFrame) -> DataFrame:
    """One row about a trajectory: frames, first, last, atoms."""
    return frames.agg(F.count(F.lit(1)).alias("n_frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.max(F.size("x")).alias("n_atoms"))


def structure_info(atoms: DataFrame) -> DataFrame:
    """Atoms, chains, segments and residues of a structure."""
    return atoms.agg(F.count(F.lit(1)).alias("n_atoms"), F.countDistinct("chain_id").alias("n_chains"), F.countDistinct("chain_id", "seg_id").alias("n_segments"), F.countDistinct("chain_id", "seg_id", "res_seq").alias("n_residues"))


def residue_pairs(residues: DataFrame) -> DataFrame:
    """All ordered pairs of different residues: a listing whose size is the point of it."""
    other = residues.select(F.col("residue").alias("other"))
    return residues.select("residue").join(other, F.col("residue") != F.col("other"))


def selection_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Atoms of one selection that the other lacks."""
    return left.join(right.select("atom_id"), "atom_id", "left_anti")


def xyz_text(frames: DataFrame) -> DataFrame:
    """(frame, text): one frame in the plain text form, a count and one line per atom."""
    lines = F.transform(F.arrays_zip(*AXES), lambda p: F.format_string("%8.3f%8.3f%8.3f", p["x"], p["y"], p["z"]))
    return frames.select("frame", F.concat(F.lit("XYZ "), F.size("x").cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


def mono(structure: dict[str, list[float]]) -> dict[str, object]:
    """Header fields of a one-frame trajectory made of a structure (fixed values)."""
    return {"nframe": 1, "begstp": 100, "skpstp": 100, "numstp": 100, "tmstp": 0.04091, "nato": len(structure["x"])}


def modify_header(header: DataFrame, **fields: object) -> DataFrame:
    unknown = set(fields) - {"begstp", "numstp", "nframe", "skpstp", "varpbc", "tmstp", "64made"}
    if unknown:
        raise ValueError(f"no such header fields: {sorted(unknown)}")
    return header.withColumns({k: F.lit(v) for k, v in fields.items()})
