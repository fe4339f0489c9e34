"""Files by their extension: structures, trajectories, lists of trajectories, and their writers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manipulate import merge, xyz_text
from ..schema import AXES
from . import dcd, structures, xtc

STRUCTURES = {"pdb": "pdb", "crd": "crd", "cor": "crd", "xyz": "xyz"}
TRAJECTORIES = {"dcd": "dcd", "trj": "dcd", "xtc": "xtc", "txt": "list", "pdb": "pdb", "crd": "crd", "cor": "crd", "xyz": "xyz", "parquet": "parquet"}


def kind(path: str, kinds: dict[str, str]) -> str:
    """Kind by the extension's first letters, whatever their case."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    found = next((v for k, v in kinds.items() if extension.startswith(k)), None)
    if found is None:
        raise ValueError(f"{path}: unknown extension; one of {sorted(kinds)}")
    return found


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    what = kind(path, STRUCTURES)
    if what == "xyz":
        raise ValueError("plain coordinates hold no atom names; read them as a trajectory")
    return (structures.read_pdb if what == "pdb" else structures.read_crd)(spark, path)


def frame_of(atoms: DataFrame) -> DataFrame:
    """A structure as a trajectory of one frame."""
    ordered = F.sort_array(F.collect_list(F.struct("atom_id", *AXES)))
    return atoms.agg(ordered.alias("p")).select(F.lit(1).cast("long").alias("frame"), *[F.col(f"p.{a}").alias(a) for a in AXES])


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(frame, x, y, z); a text file is a list of trajectories that follow one another."""
    what = kind(path, TRAJECTORIES)
    if what in ("dcd", "xtc"):
        spark.dataSource.register(dcd.DcdSource if what == "dcd" else xtc.XtcSource)
        return spark.read.format(what).load(path).select("frame", *AXES)
    if what == "list":
        names = [r["value"] for r in structures.read_list(spark, path).orderBy("ord").collect()]
        return merge([read_trajectory(spark, name) for name in names])
    if what == "parquet":
        return spark.read.parquet(path).select("frame", *AXES)
    if what == "pdb":
        return structures.read_pdb_models(spark, path).withColumn("frame", F.col("frame").cast("long"))
    if what == "xyz":
        return structures.read_xyz(spark, path).withColumn("frame", F.col("frame").cast("long"))
    return frame_of(structures.read_crd(spark, path))


def _ordered(frames: DataFrame) -> Iterator[tuple]:
    """Frames in order, a partition at a time: a binary file has one writer."""
    box = "box" in frames.columns
    for r in frames.orderBy("frame").toLocalIterator():
        yield r["x"], r["y"], r["z"], tuple(r["box"]) if box and r["box"] else None


def write_trajectory(frames: DataFrame, path: str) -> None:
    what = kind(path, TRAJECTORIES)
    if what == "parquet":
        frames.repartitionByRange("frame").sortWithinPartitions("frame").write.mode("overwrite").parquet(path)
    elif what == "dcd":
        first = frames.select(F.size("x").alias("n")).first()
        dcd.write(path, _ordered(frames.select("frame", *AXES)), first["n"] if first else 0)
    elif what == "xtc":
        xtc.write(path, _ordered(frames.select("frame", *AXES)))
    elif what == "xyz":
        structures.write_lines(xyz_text(frames).select(F.col("frame").alias("n"), F.col("text").alias("line")), path)
    else:
        raise ValueError(f"{path}: trajectories are written as dcd, xtc, xyz or parquet")


def write_structure(atoms: DataFrame, path: str) -> None:
    lines = structures.pdb_lines if kind(path, STRUCTURES) == "pdb" else structures.crd_lines
    structures.write_lines(lines(atoms), path)


def placed(atoms: DataFrame, frames: DataFrame, frame: int) -> DataFrame:
    """The structure's atoms at the coordinates of a frame."""
    at = frames.where(F.col("frame") == frame).select(F.posexplode(F.arrays_zip(*AXES)).alias("k", "p")).select((F.col("k") + 1).alias("atom_id"), "p.x", "p.y", "p.z")
    return atoms.drop(*AXES).join(F.broadcast(at), "atom_id")
