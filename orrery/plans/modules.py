"""Further analysis modules: whole-trajectory blocks, and blocks over data that need no trajectory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import graph
from ..operators import areas, clusters, crossings, dense, kinetics, manipulate, networks, secondary, shapes, springs
from ..schema import points
from ..sources import structures
from .blocks import Block, BlockError, Context, dense_module, parse, whole

ALL = "/*/*/*/*"


def _chosen(block: Block, on: Context, name: str = "SELE") -> list[int]:
    return on.selection(block.one(name, ALL))


def _part(block: Block, on: Context) -> DataFrame:
    """The trajectory of the block's selection only."""
    return manipulate.project(on.frames, _chosen(block, on))


def _reference(on: Context, atoms: list[int]) -> dict[str, list[float]]:
    return {a: [on.reference[a][k - 1] for k in atoms] for a in "xyz"}


def _table(on: Context, matrix: np.ndarray, atoms: list[int], value: str) -> DataFrame:
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(atoms) for j, b in enumerate(atoms) if j < i]
    return on.frames.sparkSession.createDataFrame(rows, f"i int, j int, {value} double")


def _radii(block: Block, on: Context) -> list[float]:
    """Radii by atom: from a radius file, or the structure's B-factors."""
    if path := block.one("RADFILE"):
        table = structures.read_radii(on.frames.sparkSession, path)
        own = F.max(F.when((F.col("r.res_name") == "*") | (F.col("r.res_name") == F.col("a.res_name")), F.col("radius")))
        rows = on.atoms.alias("a").join(F.broadcast(table).alias("r"), F.col("a.atom_name") == F.col("r.atom_name"), "left").groupBy("a.atom_id").agg(own.alias("radius")).orderBy("atom_id").collect()
    else:
        rows = on.atoms.select("atom_id", F.col("b_factor").alias("radius")).orderBy("atom_id").collect()
    if any(r["radius"] is None for r in rows):
        raise BlockError("some atoms have no radius")
    return [float(r["radius"]) for r in rows]


@whole("msdf")
def _msdf(block: Block, on: Context) -> DataFrame:
    atoms = _chosen(block, on)
    mean, var, _ = dense.pair_moments(on.frames, atoms)
    value = np.sqrt(var) if block.flag("ROOT") else var
    rows = [(atoms[i], atoms[j], float(mean[k]), float(value[k])) for k, (i, j) in enumerate(zip(*np.tril_indices(len(atoms), -1)))]
    return on.frames.sparkSession.createDataFrame(rows, "i int, j int, mean double, msdf double")


@whole("corr")
def _corr(block: Block, on: Context) -> DataFrame:
    atoms, kind = _chosen(block, on), (block.one("TYPE", "DCC") or "DCC").upper()
    frames, reference = manipulate.project(on.frames, atoms), _reference(on, atoms)
    if kind == "DCC":
        return _table(on, dense.cross_correlation(frames, reference), atoms, "corr")
    if kind == "LMI":
        return _table(on, dense.mutual_information(frames, reference), atoms, "corr")
    if kind == "DCOR":
        n = len(atoms)
        found = dense.distance_correlations(frames, [(i + 1, j + 1) for i in range(n) for j in range(i)])
        names = F.array(*[F.lit(a) for a in atoms])
        return found.select(F.element_at(names, F.col("i").cast("int")).alias("i"), F.element_at(names, F.col("j").cast("int")).alias("j"), F.col("dcor").alias("corr"))
    if kind == "FLUCT":
        return dense.group_fluctuation(on.frames.withColumn("whole", F.lit(1)), "whole", atoms).select("i", "j", "mean", (F.sqrt("var") if block.flag("STDEV") else F.col("var")).alias("corr"))
    raise BlockError(f"no correlation {kind!r}")


@whole("entropy")
def _entropy(block: Block, on: Context) -> DataFrame:
    atoms = _chosen(block, on)
    weights = np.array([on.masses[k - 1] for k in atoms]) if on.masses else None
    cov, n = dense.covariance(manipulate.project(on.frames, atoms), _reference(on, atoms), superpose=True, weights=weights)
    found = dense.entropy(cov, float(block.one("TEMP", "300")))
    return on.frames.sparkSession.createDataFrame([(n, found["entropy"], found["energy"], found["heat_capacity"])], "n_frames int, entropy double, energy double, heat_capacity double")


@whole("cluster")
def _cluster(block: Block, on: Context) -> DataFrame:
    method = (block.one("METHOD", "leader") or "leader").lower()
    distance = {"rmsd": "in_place" if block.flag("NOSUPER") else "rmsd", "drms": "drms", "tani": "tanimoto"}[(block.one("DISTANCE", "rmsd") or "rmsd").lower()]
    cutoff = float(block.one("CUTOFF", "1.0"))
    frames = clusters.sampled(_part(block, on), int(block.one("STEP", "1")))
    if "traj_id" not in frames.columns:
        frames = frames.withColumn("traj_id", F.lit(1))
    if method in ("qt", "fastqtlike"):
        return clusters.quality_frames(frames, cutoff, distance)
    if method == "hiero":
        return clusters.hierarchical(frames, cutoff, distance)
    if method == "leader":
        mode = "first" if block.flag("MAXSPEED") else "nearest" if block.flag("LFULL") else "markov"
        return clusters.leader(frames, cutoff, distance, mode)
    if method == "tsne":
        rows = frames.orderBy("frame").select("frame", "x", "y", "z").limit(5001).collect()
        if len(rows) > 5000:
            raise BlockError("tsne takes 5000 frames at most: raise --STEP")
        flat = np.array([[*r["x"], *r["y"], *r["z"]] for r in rows])
        placed = clusters.embed(flat, float(block.one("PERPLEXITY", "30")), int(block.one("DIM", "2")), int(block.one("IMAX", "1000")), int(block.one("SEED", "1")))
        return on.frames.sparkSession.createDataFrame([(r["frame"], [float(v) for v in p]) for r, p in zip(rows, placed)], "frame long, place array<double>")
    raise BlockError(f"no clustering {method!r}")


@whole("cassign")
def _assign(block: Block, on: Context) -> DataFrame:
    frames = _part(block, on)
    centres = [int(k) for k in (block.one("CENTERS", "") or "").replace(",", " ").split()]
    if not centres:
        raise BlockError("cassign wants --CENTERS, frame numbers")
    return clusters.assign(frames, clusters.coordinates(frames, centres), float(block.one("CUTOFF", "1.0")), "in_place" if block.flag("NOSUPER") else "rmsd")


@whole("psn")
def _psn(block: Block, on: Context) -> DataFrame:
    """Interactions of residues; --REPORT averages | hubs | clusters | auto gives what is derived from them."""
    named = ["res_name"] if "res_name" in on.atoms.columns else []
    atoms = on.atoms.orderBy("atom_id").select("atom_id", "atom_name", "seg_id", "res_seq", *named).collect()
    keys: dict[tuple, int] = {}
    residue = tuple(keys.setdefault((a["seg_id"], a["res_seq"]), len(keys)) for a in atoms)
    # --NORM is one norm for all; else residues have theirs by name, and --PARAM NAME VALUE gives further ones
    given = {k.upper(): float(v) for k, v in (p.split()[:2] for p in block.all("PARAM"))}
    of = {keys[a["seg_id"], a["res_seq"]]: a["res_name"] if named else None for a in reversed(atoms)}
    one = block.one("NORM") or (None if named else "100")
    norm = (float(one),) * len(keys) if one else tuple(networks.norm_of(of[k], given) for k in range(len(keys)))
    net = networks.Network(residue, norm, tuple(k[1] for k in keys), tuple(k[0] for k in keys), float(block.one("DISTCUTOFF", "4.5")), int(block.one("PROXIMITY", "3")))
    report, least = block.one("REPORT", "interactions"), block.one("INTMIN", "0")
    if least.upper() == "AUTO" or report == "auto":
        return networks.critical_strength(on.frames, net)
    found = networks.interactions(on.frames, net)
    if report == "interactions":
        return found.where(F.col("strength") >= float(least))
    if report == "clusters":
        return networks.frame_components(found, float(least))
    frames = on.frames.count()
    if report == "hubs":
        return networks.hubs(found, float(least), frames, int(block.one("HUBCONTCUTOFF", "3")))
    return networks.averages(found.where(F.col("strength") >= float(least)), frames)


@dense_module("surf")
def _surface(block: Block, on: Context) -> DataFrame:
    title, radii, atoms = block.one("TITLE", "surf"), _radii(block, on), _chosen(block, on)
    solvent, divisions = float(block.one("RSOLV", "1.4")), int(block.one("NDIV", "3"))
    kind = (block.one("CALC", "ASURF") or "ASURF").upper()
    if (block.one("ALGO", "GEPOL") or "GEPOL").upper() == "ARVO":
        rows = shapes.analytic_surface(on.frames, radii, atoms, solvent)
    elif kind == "ESURF":
        rows = shapes.filled_surface(manipulate.project(on.frames, atoms), [radii[k - 1] for k in atoms], solvent, divisions, float(block.one("OFAC", "0.8")), float(block.one("RMIN", "0.5")))
    else:
        rows = shapes.dotted_surface(on.frames, radii, atoms, solvent, divisions, kind == "ASURF")
    return rows.withColumnRenamed("area", title)


@whole("surfcluster")
def _surface_clusters(block: Block, on: Context) -> DataFrame:
    rows = _surface(Block("surf", [*block.options, ("TITLE", "area")]), on)
    return areas.by_value(rows, "area", float(block.one("BIN", "1.0")))


@dense_module("tilt")
def _tilt(block: Block, on: Context) -> DataFrame:
    title, axis, segment = block.one("TITLE", "tilt"), _chosen(block, on, "SELEAXIS"), _chosen(block, on)
    if block.flag("DEC"):
        rows = shapes.tilt_components(on.frames, axis, _chosen(block, on, "SELEREF"), segment)
        return rows.select("frame", F.col("theta").alias(f"{title}_theta"), F.col("phi").alias(f"{title}_phi"))
    return shapes.tilt(on.frames, axis, segment, not block.flag("NOORIENT")).withColumnRenamed("tilt", title)


@dense_module("twist")
def _twist(block: Block, on: Context) -> DataFrame:
    sides = [[on.selection(s.strip()) for s in text.split(":")] for text in block.all("SELE")]
    if len(sides) != 2 or any(len(s) != 2 for s in sides):
        raise BlockError("twist wants two --SELE a : b")
    return shapes.twist(on.frames, _chosen(block, on, "SELEAXIS"), tuple(sides[0]), tuple(sides[1])).withColumnRenamed("twist", block.one("TITLE", "twist"))


@whole("hole")
def _hole(block: Block, on: Context) -> DataFrame:
    named = {r["atom_id"]: r["atom_name"] for r in on.atoms.select("atom_id", "atom_name").collect()}
    radii = [shapes.ELEMENT_RADII.get(named[k].lstrip("0123456789")[:1], shapes.OTHER_RADIUS) for k in sorted(named)]
    three = lambda name: [float(v) for v in block.one(name, "").replace(",", " ").split()]
    return shapes.pore(on.frames, radii, three("POINT"), three("VECT"), seed=int(block.one("SEED", "1989")))


@whole("flux")
def _flux(block: Block, on: Context) -> DataFrame:
    atoms = _chosen(block, on)
    rows = points(on.frames).where(F.col("atom_id").isin(atoms))
    return crossings.crossings(rows, "atom_id", "frame", "z", float(block.one("LOWER", "0")), float(block.one("UPPER", "0")), float(block.one("DELTA", "5")))


@dense_module("ssa")
def _ssa(block: Block, on: Context) -> DataFrame:
    atoms = on.atoms.where(F.col("atom_id").isin(_chosen(block, on))).orderBy("atom_id").collect()
    residues: dict[tuple, dict[str, int]] = {}
    for a in atoms:
        residues.setdefault((a["chain_id"], a["seg_id"], a["res_seq"]), {})[a["atom_name"]] = a["atom_id"]
    backbone = [(r.get("N"), r.get("H", r.get("HN")), r.get("CA"), r.get("C"), r.get("O")) for r in residues.values()]
    return secondary.secondary_structure(on.frames, backbone, block.flag("DCLIKE")).withColumnRenamed("ss", block.one("TITLE", "ss"))


@dense_module("project")
def _project(block: Block, on: Context) -> DataFrame:
    """Projection on a mode of the trajectory's own covariance."""
    atoms = _chosen(block, on)
    reference, frames = _reference(on, atoms), manipulate.project(on.frames, atoms)
    vector = dense.modes(dense.covariance(frames, reference)[0])[1][:, int(block.one("MODE", "1")) - 1]
    target = dense.matrix_of(reference)

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        return {"projection": (s - target).reshape(len(s), -1) @ vector}

    return dense.per_frame(frames, kernel, "projection double").withColumnRenamed("projection", block.one("TITLE", "proj"))


@whole("enm")
def _enm(block: Block, on: Context) -> DataFrame:
    law = springs.sixth_power(float(block.one("KCONST", "1"))) if (block.one("TYPE", "linear") or "").lower() == "kovacs" else springs.linear(float(block.one("CUTOFF", "15")))
    return springs.per_frame_modes(_part(block, on), law, int(block.one("MODES", "10")))


@whole("volume")
def _volume(block: Block, on: Context) -> DataFrame:
    named = {r["atom_id"]: r["atom_name"] for r in on.atoms.select("atom_id", "atom_name").collect()}
    radii = [shapes.ELEMENT_RADII.get(named[k].lstrip("0123456789")[:1], shapes.OTHER_RADIUS) for k in sorted(named)]
    return shapes.volumes(on.frames, radii, on.selection(block.one("LIGAND", ALL)), float(block.one("STEP", "0.5")))


# --- blocks over data -----------------------------------------------------------------------


@dataclass
class Data:
    """Options of a data block and where its tables come from."""

    spark: SparkSession
    block: Block
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def series(self) -> DataFrame:
        return self.tables["series"] if "series" in self.tables else structures.read_series(self.spark, self.path("CLUSFILE"))

    def links(self) -> kinetics.Links:
        if "links" in self.tables:
            rows = self.tables["links"]
        else:
            rows = structures.read_links(self.spark, self.path("LINKFILE")) if self.block.one("LINKFILE") else kinetics.transitions(self.series())
        found = kinetics.Links(rows)
        return found.symmetric() if self.block.flag("SYMM") else found

    def path(self, name: str) -> str:
        value = self.block.one(name)
        if not value:
            raise BlockError(f"{self.block.module} wants --{name}")
        return value

    def number(self, name: str, default: float | None = None) -> float:
        value = self.block.one(name)
        if value is None and default is None:
            raise BlockError(f"{self.block.module} wants --{name}")
        return float(value) if value is not None else default


def _profile(data: Data, values: np.ndarray, links: kinetics.Links, rising: bool) -> DataFrame:
    rows = kinetics.profile(links, values, links.out, data.number("TEMP", 300), rising)
    return data.spark.createDataFrame(rows, "node int, value double, za double, energy double")


def _first_passage(data: Data) -> DataFrame:
    links = data.links()
    return _profile(data, kinetics.first_passage(links, int(data.number("TARGET")), int(data.number("NIT", 50_000))), links, True)


def _committor(data: Data) -> DataFrame:
    links, other = data.links(), data.block.one("TARGET2")
    return _profile(data, kinetics.committor(links, int(data.number("TARGET")), int(other) if other else None, data.number("LAMBDA", 1e-4), int(data.number("NIT", 50_000))), links, False)


def _equilibrium(data: Data) -> DataFrame:
    links = data.links()
    p = kinetics.equilibrium(links)
    return data.spark.createDataFrame([(int(n), float(v), float(v * links.out.sum())) for n, v in zip(links.nodes, p)], "node int, p double, weight double")


def _strong(data: Data) -> DataFrame:
    return data.spark.createDataFrame([(int(a), int(b)) for a, b in kinetics.strong(data.links()).items()], "node int, component int")


def _rings(data: Data) -> DataFrame:
    edges = data.tables["edges"] if "edges" in data.tables else structures.read_graph(data.spark, data.path("GRAPHFILE"))
    return graph.rings(edges, int(data.number("DIM", 10)))


def _from_matrix(data: Data) -> DataFrame:
    return clusters.from_matrix(data.tables["dist"] if "dist" in data.tables else data.spark.read.parquet(data.path("INMATRIX")), data.number("CUTOFF"))


def _paths(data: Data) -> DataFrame:
    found = data.tables["interactions"] if "interactions" in data.tables else data.spark.read.parquet(data.path("PSNFILE"))
    return networks.paths(found, int(data.number("FROM")), int(data.number("TO")), data.number("IMIN", 0), int(data.number("WEIGHT", 0)))


def _mode_overlap(data: Data) -> DataFrame:
    """Overlaps of two eigenvector tables (mode, component, value)."""

    def matrix(name: str) -> np.ndarray:
        rows = (data.tables[name] if name in data.tables else data.spark.read.parquet(data.path(name.upper()))).toArrow()
        mode, component = (np.asarray(rows.column(c)) - 1 for c in ("mode", "component"))
        out = np.zeros((component.max() + 1, mode.max() + 1))
        out[component, mode] = np.asarray(rows.column("value"))
        return out

    o = springs.overlap(matrix("first"), matrix("second"))
    reach = springs.cumulative_overlap(o)
    return data.spark.createDataFrame([(i + 1, j + 1, float(o[i, j]), float(reach[i, j])) for i in range(o.shape[0]) for j in range(o.shape[1])], "mode1 int, mode2 int, overlap double, cumulative double")


DATA: dict[str, Callable[[Data], DataFrame]] = {
    "logbin": lambda d: kinetics.return_times(d.series(), int(d.number("TARGET")), int(d.number("BPD", 10))),
    "basin": lambda d: kinetics.commitment(d.series(), int(d.number("TARGET")), int(d.number("TCOMM"))),
    "ka": lambda d: kinetics.basins(d.series(), int(d.number("NNODES")), int(d.number("TCOMM"))),
    "mfpt": _first_passage,
    "mfptnet": _first_passage,
    "pfoldf": _committor,
    "pfoldfnet": _committor,
    "equil": _equilibrium,
    "elec": _strong,
    "ring": _rings,
    "cluster": _from_matrix,
    "psnpath": _paths,
    "psnparam": lambda d: networks.norm_factors(d.tables["counts"] if "counts" in d.tables else d.spark.read.parquet(d.path("COUNTS"))),
    "pcatools": _mode_overlap,
    "surfcorr": lambda d: areas.correlation(d.tables["areas"] if "areas" in d.tables else d.spark.read.parquet(d.path("AREAS")), "x", "y"),
}


def run_data(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Results of data blocks by name and number; all blocks of a text run."""
    out = {}
    for number, block in enumerate(parse(text), 1):
        if block.module not in DATA:
            raise BlockError(f"no data module {block.module!r}")
        out[f"{block.module}_{number}"] = DATA[block.module](Data(spark, block, tables or {}))
    return out
