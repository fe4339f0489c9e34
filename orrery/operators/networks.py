"""Structure networks: residues linked by contacts of their atoms, frame by frame.

Within a frame the work is one numpy kernel over that frame's atoms; across frames everything is an
aggregation by residue pair. So the frames stay where they are, and only pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components, shortest_paths
from ..schema import AXES
from .dense import stack

FORCED = 999.999
UNKNOWN_NORM = 99999.99999
FREQUENCIES = (10.0, 20.0, 25.0, 30.0, 33.3, 50.0, 60.0, 66.7, 70.0, 75.0, 80.0)

# Edge weights of the path search by number (fixed formulas); i is the strength, m the largest in the frame.
WEIGHTS: dict[int, Callable[[float, float], float]] = {
    0: lambda i, m: 1.0,
    1: lambda i, m: 100 - i,
    2: lambda i, m: (100 / i) ** 2,
    3: lambda i, m: 100 / i,
    4: lambda i, m: 1 / i,
    5: lambda i, m: 100 / np.log(i + 1),
    6: lambda i, m: 100 / np.log10(i + 1),
    7: lambda i, m: 1 - i / 100,
    8: lambda i, m: m - i,
    9: lambda i, m: m / i,
    10: lambda i, m: 100 * m / i,
    11: lambda i, m: 1 / np.log(i + 1),
    12: lambda i, m: 1 / np.log10(i + 1),
}


# Normalisation of a residue's contacts by residue name.
NORMS = {
    "ALA": 55.7551, "ARG": 93.7891, "ARGN": 93.7891, "ASN": 73.4097, "ASP": 75.1507, "ASPH": 75.1507, "CYS": 54.9528, "CYN": 54.9528,
    "GLN": 78.1301, "GLU": 78.8288, "GLUH": 78.8288, "GLY": 47.3129, "HIS": 83.7357, "HID": 83.7357, "HSD": 83.7357, "HSC": 83.7357,
    "HSP": 83.7357, "HSE": 83.7357, "ILE": 67.9452, "LEU": 72.2517, "LYS": 69.6096, "LYP": 69.6096, "LYSN": 69.6096, "MET": 69.2569,
    "PHE": 93.3082, "PRO": 51.331, "SER": 61.3946, "THR": 63.7075, "TRP": 106.703, "TYR": 100.719, "VAL": 62.3673, "RET": 170.1355,
    "GDP": 220.1921, "GTP": 274.7802, "GTA": 361.3333, "GDA": 293.0, "MGT": 22.0147, "MGD": 14.6585, "MGX": 19.2477, "MGA": 23.83333,
    "H2O": 27.0, "HOH": 27.0, "WAT": 27.0, "SOL": 27.0, "ZMA": 139.0, "LYR": 109.9498, "KRT": 262.5612, "MNG": 23.5,
}
UNKNOWN_NORM = 99999.99999


def norm_of(residue_name: str | None, given: dict[str, float] | None = None) -> float:
    """Norm of a residue by its name in any case; what is given comes before the fixed values, others don't interact."""
    name = (residue_name or "").strip().upper()
    return (given or {}).get(name, NORMS.get(name, UNKNOWN_NORM))


@dataclass(frozen=True)
class Network:
    """Residue of each atom (from 0), and of each residue: its norm, number and segment."""

    residue: tuple[int, ...]
    norm: tuple[float, ...]
    number: tuple[int, ...]
    segment: tuple[str, ...] | None = None
    cutoff: float = 4.5
    proximity: int = 3
    no_link: frozenset[tuple[int, int]] = frozenset()
    force_link: frozenset[tuple[int, int]] = frozenset()

    def pairs(self) -> list[tuple[int, int]]:
        """Residue pairs that may link: not near each other along one segment."""
        n = len(self.norm)
        seg = self.segment or ("",) * n
        return [(a, b) for a in range(n) for b in range(a + 1, n) if seg[a] != seg[b] or abs(self.number[a] - self.number[b]) >= self.proximity]

    def counts(self, xyz: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Atom pairs within the cutoff (F,) of every residue pair that may link."""
        of = np.array(self.residue)
        members = [np.nonzero(of == k)[0] for k in range(len(self.norm))]
        out = {}
        for a, b in self.pairs():
            if len(members[a]) and len(members[b]):
                d = ((xyz[:, members[a], None] - xyz[:, None, members[b]]) ** 2).sum(-1)
                out[a, b] = (d <= self.cutoff**2).sum((1, 2))
        return out


def interactions(frames: DataFrame, network: Network) -> DataFrame:
    """(frame, r1, r2, n_pairs, strength, hub1, hub2) of linked residues, r1 < r2, numbered from 1.

    strength = 100 n / sqrt(N1 N2); the hub strengths are 100 n / N of either end.
    """
    shared = frames.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.asarray(batch.column("frame"))
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for (a, b), n in net.counts(stack(batch)).items():
                forced = (a + 1, b + 1) in net.force_link
                if (a + 1, b + 1) in net.no_link:
                    continue
                at = np.arange(len(n)) if forced else np.nonzero(n)[0]
                m = n[at]
                strength = np.full(len(at), FORCED) if forced else 100 * m / np.sqrt(net.norm[a] * net.norm[b])
                for c, v in zip(columns, (ids[at], np.full(len(at), a + 1), np.full(len(at), b + 1), m, strength, 100 * m / net.norm[a], 100 * m / net.norm[b])):
                    c.append(v)
            yield pa.record_batch([pa.array(np.concatenate(c) if c else np.zeros(0)) for c in columns], ["frame", "r1", "r2", "n_pairs", "strength", "hub1", "hub2"])

    return frames.select("frame", *AXES).mapInArrow(run, "frame long, r1 long, r2 long, n_pairs long, strength double, hub1 double, hub2 double")


def frame_components(found: DataFrame, least: float) -> DataFrame:
    """(frame, residue, cluster): components of links of at least `least`, each named by its smallest residue."""
    from ..functions.graph import connected

    edges = found.where(F.col("strength") >= least).select("frame", F.col("r1").alias("a"), F.col("r2").alias("b"))
    return connected(edges, ["frame"]).select("frame", F.col("node").alias("residue"), F.col("component").alias("cluster"))


def averages(found: DataFrame, frames: int) -> DataFrame:
    """(r1, r2, mean_strength, frequency) over all frames; frames without the link count as zero."""
    return found.groupBy("r1", "r2").agg((F.sum("strength") / frames).alias("mean_strength"), (F.count(F.lit(1)) * 100.0 / frames).alias("frequency"))


def degrees(found: DataFrame, least: float) -> DataFrame:
    """(frame, residue, degree) over links of at least `least`."""
    kept = found.where(F.col("strength") >= least)
    return kept.select("frame", F.explode(F.array("r1", "r2")).alias("residue")).groupBy("frame", "residue").agg(F.count(F.lit(1)).alias("degree"))


def hubs(found: DataFrame, least: float, frames: int, more_than: int = 3) -> DataFrame:
    """(residue, frequency): share of frames in which a residue has more than so many links."""
    return degrees(found, least).where(F.col("degree") > more_than).groupBy("residue").agg((F.count(F.lit(1)) * 100.0 / frames).alias("frequency"))


def stable_degrees(found: DataFrame, least: float, frames: int, cutoffs: Sequence[float] = FREQUENCIES) -> DataFrame:
    """(residue, f10, f20 ...): number of links of a residue that are as frequent as each cutoff."""
    often = averages(found.where(F.col("strength") >= least), frames)
    ends = often.select("frequency", F.explode(F.array("r1", "r2")).alias("residue"))
    return ends.groupBy("residue").agg(*[F.sum(F.when(F.col("frequency") >= c, 1).otherwise(0)).alias(f"f{str(c).replace('.0', '').replace('.', '_')}") for c in cutoffs])


def hub_correlation(found: DataFrame, least: float, frames: int, more_than: int = 3) -> DataFrame:
    """(a, b, correlation): share of frames in which both are hubs or neither is; negative where neither prevails."""
    here = degrees(found, least).where(F.col("degree") > more_than).select("frame", "residue")
    alone = here.groupBy("residue").agg(F.count(F.lit(1)).alias("n"))
    both = here.select("frame", F.col("residue").alias("a")).join(here.select("frame", F.col("residue").alias("b")), "frame").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    rows = both.join(alone.select(F.col("residue").alias("a"), F.col("n").alias("na")), "a").join(alone.select(F.col("residue").alias("b"), F.col("n").alias("nb")), "b")
    neither = F.lit(frames) - F.col("na") - F.col("nb") + F.col("both")
    return rows.select("a", "b", (F.when(neither > F.col("both"), -1.0).otherwise(1.0) * (F.col("both") + neither) / frames).alias("correlation"))


def largest_component(found: DataFrame, least: float) -> DataFrame:
    """(frame, size) of each frame's largest component."""
    sizes = frame_components(found, least).groupBy("frame", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("frame").agg(F.max("n").alias("size"))


def critical_strength(frames: DataFrame, network: Network, digits: int = 3, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """(frame, imin): strength at which each frame's largest component falls to half of what it is at zero, by bisection."""
    shared = frames.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        n = len(net.norm)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            links = [(a, b, 100 * c / np.sqrt(net.norm[a] * net.norm[b])) for (a, b), c in net.counts(stack(batch)).items()]
            out = []
            for f in range(batch.num_rows):
                edges = [(a, b, s[f]) for a, b, s in links if s[f] > 0]

                def largest(least: float) -> int:
                    label = components(n, [(a, b) for a, b, s in edges if s >= least])
                    return int(np.bincount(label).max())

                target, a, b = largest(low) / 2, low, high
                while b - a > 10.0**-digits:
                    middle = (a + b) / 2
                    a, b = (middle, b) if largest(middle) > target else (a, middle)
                out.append(round((a + b) / 2, digits))
            yield pa.record_batch([batch.column("frame"), pa.array(out, pa.float64())], ["frame", "imin"])

    return frames.select("frame", *AXES).mapInArrow(run, "frame long, imin double")


def paths(found: DataFrame, source: int, target: int, least: float, weight: int = 0, correlated: frozenset[int] | None = None) -> DataFrame:
    """(frame, path, length, strength): all shortest paths between two residues in every frame.

    With `correlated` residues, only paths that pass one of them between their ends are kept.
    """
    kinds = "frame long, path string, length double, strength double"

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        most = max((r["strength"] for r in rows), default=1.0)
        edges: dict[int, list[tuple[int, float]]] = {}
        strength = {}
        for r in rows:
            w = float(WEIGHTS[weight](r["strength"], most))
            edges.setdefault(r["r1"], []).append((r["r2"], w))
            edges.setdefault(r["r2"], []).append((r["r1"], w))
            strength[r["r1"], r["r2"]] = strength[r["r2"], r["r1"]] = r["strength"]
        length, routes = shortest_paths(edges, source, target) if source in edges else (0.0, [])
        kept = [p for p in routes if correlated is None or set(p[1:-1]) & correlated]
        frame = key[0].as_py()
        return pa.table({"frame": pa.array([frame] * len(kept), pa.int64()), "path": pa.array(["-".join(map(str, p)) for p in kept], pa.string()), "length": pa.array([length] * len(kept), pa.float64()), "strength": pa.array([sum(strength[a, b] for a, b in zip(p, p[1:])) for p in kept], pa.float64())})

    return found.where(F.col("strength") >= least).select("frame", "r1", "r2", "strength").groupBy("frame").applyInArrow(solve, kinds)


def path_frequencies(found: DataFrame, frames: int) -> DataFrame:
    return found.groupBy("path").agg(F.countDistinct("frame").alias("n"), (F.countDistinct("frame") * 100.0 / frames).alias("frequency"), F.avg("length").alias("mean_length"))


def norm_factors(counts: DataFrame) -> DataFrame:
    """(res_name, largest, mean) of the contact counts (res_name, n) of residues over structures."""
    return counts.groupBy("res_name").agg(F.max("n").alias("largest"), F.avg("n").alias("mean"))


def merging_links(found: DataFrame, least: float) -> DataFrame:
    """(frame, r1, r2, strength): the strongest links under `least` that join a frame's clusters, one
    after another, until no link joins two of them. Residues outside of clusters take no part."""

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["strength"], r["r1"], r["r2"]))
        up: dict[int, int] = {}

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for r in rows:
            if r["strength"] >= least:
                a, b = (root(up.setdefault(r[c], r[c])) for c in ("r1", "r2"))
                up[max(a, b)] = min(a, b)
        used = []
        for r in rows:
            if r["strength"] < least and r["r1"] in up and r["r2"] in up and root(r["r1"]) != root(r["r2"]):
                up[root(r["r1"])] = root(r["r2"])
                used.append(r)
        frame = key[0].as_py()
        return pa.table({"frame": pa.array([frame] * len(used), pa.int64()), **{c: pa.array([r[c] for r in used], pa.int64()) for c in ("r1", "r2")}, "strength": pa.array([r["strength"] for r in used], pa.float64())})

    return found.select("frame", "r1", "r2", "strength").groupBy("frame").applyInArrow(solve, "frame long, r1 long, r2 long, strength double")


def contact_counts(frames: DataFrame, network: Network, names: Sequence[str]) -> DataFrame:
    """(frame, residue, res_name, n): atom contacts of every residue with others, for norm factors."""
    found = interactions(frames, network)
    ends = found.select("frame", "n_pairs", F.explode(F.array("r1", "r2")).alias("residue")).groupBy("frame", "residue").agg(F.sum("n_pairs").alias("n"))
    return ends.select("frame", "residue", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("residue").cast("int")).alias("res_name"), "n")
