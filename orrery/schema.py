"""Canonical tables and the adapters that read them from the star-schema stand-ins.

frames : traj_id, frame (from 1), x, y, z (arrays of doubles, one element per atom)
points : traj_id, frame, atom_id, x, y, z            (the long form of frames)
atoms  : atom_id, chain_id, seg_id, res_seq, res_name, atom_name
series : traj_id, t (from 1), node
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_ATOMS = 21
AXES = ("x", "y", "z")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is a frame of 21 atoms; its label names the trajectory."""
    picks = [F.expr(f"transform(sequence(0, {N_ATOMS - 1}), k -> cast(embedding[3 * k + {a}] as double))").alias(axis) for a, axis in enumerate(AXES)]
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("traj_id"), (F.col("vec_id") + 1).alias("frame"), *picks)


def points(frames: DataFrame) -> DataFrame:
    keep = [c for c in ("traj_id", "frame") if c in frames.columns]
    return frames.select(*keep, F.posexplode(F.arrays_zip(*AXES)).alias("k", "p")).select(*keep, (F.col("k") + 1).alias("atom_id"), "p.x", "p.y", "p.z")


def reference(frames: DataFrame, frame: int = 1) -> dict[str, list[float]]:
    """Coordinates of one frame on the driver: the size of one structure, not of the trajectory."""
    row = frames.where(F.col("frame") == frame).select(*AXES).first()
    if row is None:
        raise ValueError(f"no frame {frame}")
    return {a: list(row[a]) for a in AXES}


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as chains, segments and residues; the market segment is the atom type."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    where = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("atom_id"),
        F.col("r_name").alias("chain_id"),
        F.col("n_name").alias("seg_id"),
        F.col("c_custkey").alias("res_seq"),
        F.col("c_mktsegment").alias("atom_name"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order; an event type's node is its rank by population, the largest first."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    ranks = events.groupBy("event_type").count().withColumn("node", F.row_number().over(Window.orderBy(F.desc("count"), "event_type")))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.join(F.broadcast(ranks), "event_type").select(F.col("user_id").alias("traj_id"), F.row_number().over(order).alias("t"), "node")
