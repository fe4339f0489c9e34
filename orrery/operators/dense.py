"""Dense per-frame and whole-trajectory operators: Arrow batches of frames as numpy stacks.

Per-frame ones are map-only. Whole-trajectory ones make one partial row per partition (sums of
products), which are added up by index, so that only matrices, never frames, are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.graph import cut
from ..schema import AXES


def stack(batch: pa.RecordBatch) -> np.ndarray:
    """Frames (F, N, 3) of a batch; all its frames must have one number of atoms."""
    sides = []
    for axis in AXES:
        column = batch.column(axis)
        sides.append(np.asarray(column.flatten()).reshape(batch.num_rows, -1))
    return np.stack(sides, axis=2)


def matrix_of(reference: dict[str, list[float]]) -> np.ndarray:
    return np.array([reference[a] for a in AXES]).T


def per_frame(frames: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Keys and what the kernel makes of each stack of frames. `schema` types the kernel's columns."""
    from pyspark.sql import types as T

    kinds = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = kernel(stack(batch))
            yield pa.record_batch([*[batch.column(k) for k in keys], *[pa.array(list(made[c]) if made[c].ndim > 1 else made[c]) for c in kinds.names]], [*keys, *kinds.names])

    out = T.StructType([frames.schema[k] for k in keys] + kinds.fields)
    return frames.select(*keys, *AXES).mapInArrow(run, out)


class Group(NamedTuple):
    """Frames that meet others together: their ids (F,) and coordinates (F, N, 3)."""

    ids: np.ndarray
    xyz: np.ndarray


BLOCK = 256  # frames that move together
GROUP_BYTES = 32 << 20  # of a group's coordinates


def meetings(frames: DataFrame, kernel: Callable[[int, Group, int, Group | None], Iterator[pa.RecordBatch]], schema: str, id_col: str = "frame", block: int = BLOCK, most: int = 1 << 20) -> DataFrame:
    """What the kernel makes of every two groups of frames, each unordered pair of groups once, and of every group with itself.

    Frames are dealt into a few groups by blocks, and each group moves once for every other, so that what
    is shuffled is the frames times the groups, not a copy for every pair of blocks. A task holds two
    groups. The kernel gets both groups with their numbers; of a group with itself the second is None.
    A group's frames keep one order in all its meetings; it has about `most` frames at most.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xyz, ids = stack(batch), np.asarray(batch.column("frame"))
            for at in range(0, batch.num_rows, block):
                part = xyz[at : at + block]
                number += 1
                yield pa.record_batch([pa.array([number]), pa.array([ids[at : at + block].tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary()), pa.array([part.shape[1]])], ["block", "ids", "body", "atoms"])

    blocks = cut(frames.select(F.col(id_col).cast("long").alias("frame"), *AXES).mapInArrow(packed, "block long, ids binary, body binary, atoms long"))
    spark = frames.sparkSession
    numbers = blocks.select("block", F.length("body").alias("size"), (F.length("ids") / 8).cast("long").alias("n")).orderBy("block").toArrow()
    size, count = (sum(numbers.column(c).to_pylist()) for c in ("size", "n"))
    wanted = max(math.isqrt(12 * spark.sparkContext.defaultParallelism) + 1, -(-size // GROUP_BYTES), -(-count // most))
    n = max(1, min(wanted, numbers.num_rows))
    dealt = spark.createDataFrame([(k, i % n) for i, k in enumerate(numbers.column("block").to_pylist())], "block long, g int")
    each = blocks.join(F.broadcast(dealt), "block").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = each.withColumn("cell", F.least("g", "o") * n + F.greatest("g", "o")).drop("o")

    def meet(rows: pa.Table) -> pa.Table:
        found = rows.sort_by("block")
        p, q = divmod(found.column("cell")[0].as_py(), n)
        mine = np.asarray(found.column("g"))

        def group(g: int) -> Group:
            part = found.filter(pa.array(mine == g))
            atoms = part.column("atoms")[0].as_py()
            ids = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in part.column("ids")])
            return Group(ids, np.concatenate([np.frombuffer(v.as_buffer()).reshape(-1, atoms, 3) for v in part.column("body")]))

        made = list(kernel(p, group(p), q, None if p == q else group(q)))
        return pa.Table.from_batches(made, empty if not made else None)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema))
    return placed.repartitionByRange(n * (n + 1) // 2, "cell").groupBy("cell").applyInArrow(meet, schema)


def rmsd(frames: DataFrame, reference: dict[str, list[float]], fit: Sequence[int] | None = None, atoms: Sequence[int] | None = None) -> DataFrame:
    """RMSD after superposition on the `fit` atoms (numbered from 1; all by default)."""
    target = matrix_of(reference)
    on = None if fit is None else np.array(fit) - 1
    of = None if atoms is None else np.array(atoms) - 1
    return per_frame(frames, lambda s: {"rmsd": linalg.rmsd(s, target, on, of)}, "rmsd double")


def drms(frames: DataFrame, reference: dict[str, list[float]], atoms: Sequence[int], radii: Sequence[float | None] = (None,)) -> DataFrame:
    """(frame, d0, d1 ...): root mean square difference of pair distances from the reference, one column for each radius.

    With a radius r, smooth contacts r^6 / (r^6 + d^6) stand for the distances. One frame's pairs are
    held at a time, so memory does not grow with the frames.
    """
    on = np.array(atoms) - 1

    def read(d: np.ndarray, radius: float | None) -> np.ndarray:
        return d if radius is None else radius**6 / (radius**6 + d**6)

    still = [read(linalg.distances(matrix_of(reference)[None, on])[0], radius) for radius in radii]

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        out = np.empty((len(radii), len(s)))
        for k, f in enumerate(s):
            d = linalg.distances(f[None, on])[0]
            out[:, k] = [linalg.drms(read(d, radius), fixed) for radius, fixed in zip(radii, still)]
        return {f"d{i}": column for i, column in enumerate(out)}

    return per_frame(frames, kernel, ", ".join(f"d{i} double" for i in range(len(radii))))


def aligned(frames: DataFrame, reference: dict[str, list[float]], fit: Sequence[int] | None = None) -> DataFrame:
    """The trajectory superposed on the reference."""
    target = matrix_of(reference)
    on = None if fit is None else np.array(fit) - 1

    def kernel(s: np.ndarray) -> dict[str, np.ndarray]:
        moved = linalg.superposed(s, target, on)
        return {a: moved[:, :, k] for k, a in enumerate(AXES)}

    keys = [c for c in ("traj_id", "frame") if c in frames.columns]
    return per_frame(frames, kernel, "x array<double>, y array<double>, z array<double>", keys)


def summed(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over all frames of a kernel that makes one array (of fixed shape) of a stack of frames.

    Every partition yields one partial array; partial arrays are added up by element.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            if batch.num_rows:
                made = kernel(stack(batch)).ravel()
                part = made if part is None else part + made
        if part is not None:
            yield pa.record_batch([pa.array(np.arange(len(part))), pa.array(part)], ["k", "v"])

    rows = frames.select(*AXES).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    if rows.num_rows == 0:
        return None
    out = np.zeros(rows.num_rows)
    out[np.asarray(rows.column("k"))] = np.asarray(rows.column("v"))
    return out


MAX_COMPONENTS = 6000  # a dense matrix of more components is refused


def covariance(frames: DataFrame, reference: dict[str, list[float]], atoms: Sequence[int] | None = None, superpose: bool = False, weights: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Covariance (3N, 3N) of coordinates about the reference, divided by the number of frames, and that number."""
    target = matrix_of(reference)
    of = np.arange(len(target)) if atoms is None else np.array(atoms) - 1
    n = 3 * len(of)
    if n > MAX_COMPONENTS:
        raise ValueError(f"{n} components: select fewer than {MAX_COMPONENTS // 3} atoms")
    root = np.ones(n) if weights is None else np.sqrt(np.repeat(weights[of], 3))

    def kernel(s: np.ndarray) -> np.ndarray:
        moved = linalg.superposed(s, target, of) if superpose else s
        d = (moved[:, of] - target[of]).reshape(len(s), -1) * root
        return np.append((d.T @ d).ravel(), len(s))

    sums = summed(frames, kernel)
    if sums is None:
        return np.zeros((n, n)), 0
    return sums[:-1].reshape(n, n) / sums[-1], int(sums[-1])


def modes(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (largest first), eigenvectors as columns, and the share of variance of each."""
    values, vectors = linalg.eigh_desc(cov)
    return values, vectors, values / values.sum()


def pair_moments(frames: DataFrame, atoms: Sequence[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population variance of every pair distance (i > j, row by row), and the number of frames.

    Sums are taken about each partition's own mean and merged, so one pass keeps its digits.
    """
    of = np.array(atoms) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            d = linalg.distances(stack(batch)[:, of])
            k, mu = len(d), d.mean(0)
            s = ((d - mu) ** 2).sum(0)
            if mean is None:
                n, mean, m2 = k, mu, s
            else:
                gap = mu - mean
                mean, m2, n = mean + gap * k / (n + k), m2 + s + gap * gap * n * k / (n + k), n + k
        if mean is not None:
            yield pa.record_batch([pa.array(np.arange(len(mean))), pa.array(np.full(len(mean), n)), pa.array(mean), pa.array(m2)], ["k", "n", "mean", "m2"])

    parts = frames.select(*AXES).mapInArrow(run, "k long, n long, mean double, m2 double")
    middle = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum("n") * middle * middle
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), middle.alias("mean"), (spread / F.sum("n")).alias("var")).orderBy("k").toArrow()
    if rows.num_rows == 0:
        size = len(of) * (len(of) - 1) // 2
        return np.zeros(size), np.zeros(size), 0
    return np.asarray(rows.column("mean")), np.maximum(np.asarray(rows.column("var")), 0), int(rows.column("n")[0].as_py())


def cross_correlation(frames: DataFrame, reference: dict[str, list[float]]) -> np.ndarray:
    """Dynamic cross correlation of displacements from the reference, atoms by atoms."""
    target = matrix_of(reference)

    def kernel(s: np.ndarray) -> np.ndarray:
        d = s - target
        return np.einsum("fid,fjd->ij", d, d)

    sums = summed(frames, kernel)
    n = len(target)
    c = np.zeros((n, n)) if sums is None else sums.reshape(n, n)
    own = np.sqrt(np.diag(c))
    with np.errstate(invalid="ignore", divide="ignore"):
        return c / own[:, None] / own[None]


def mutual_information(frames: DataFrame, reference: dict[str, list[float]], scale: float = 0.1) -> np.ndarray:
    """Linear mutual information as a correlation, sqrt(1 - exp(-2 I / 3)), from Gaussian entropies."""
    target = matrix_of(reference)
    n = len(target)

    def kernel(s: np.ndarray) -> np.ndarray:
        d = ((s - target) * scale).reshape(len(s), -1)
        return np.concatenate([(d.T @ d).ravel(), d.sum(0), [len(s)]])

    sums = summed(frames, kernel)
    out = np.eye(n)
    if sums is None:
        return out
    m = 3 * n
    mean = sums[m * m : m * m + m] / sums[-1]
    cov = sums[: m * m].reshape(m, m) / sums[-1] - np.outer(mean, mean)

    def entropy(rows: np.ndarray) -> float:
        sign, logdet = np.linalg.slogdet(cov[np.ix_(rows, rows)])
        return 0.5 * (len(rows) * (1 + np.log(2 * np.pi)) + logdet) if sign > 0 else -np.inf

    own = [entropy(np.arange(3 * i, 3 * i + 3)) for i in range(n)]
    for i in range(n):
        for j in range(i):
            joint = entropy(np.r_[3 * i : 3 * i + 3, 3 * j : 3 * j + 3])
            info = own[i] + own[j] - joint
            value = np.sqrt(1 - np.exp(-2 * info / 3)) if np.isfinite(info) and info > 0 else (1.0 if info == np.inf else 0.0)
            out[i, j] = out[j, i] = value
    return out


def distance_correlation(series: np.ndarray, other: np.ndarray) -> float:
    """Distance correlation of two paths (F, d) by double centring of their frame-by-frame distances."""

    def centred(x: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
        np.fill_diagonal(d, 0)
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(series), centred(other)
    cov, va, vb = (a * b).mean(), (a * a).mean(), (b * b).mean()
    return float(np.sqrt(max(cov, 0) / np.sqrt(va * vb))) if va > 0 and vb > 0 else 0.0


def entropy(cov: np.ndarray, temperature: float = 300.0, skip: int = 6) -> dict[str, float]:
    """Quasi-harmonic entropy, energy and heat capacity (J/K/mol, kJ/mol) of a mass-weighted covariance
    in Angstrom^2 g/mol; the `skip` smallest eigenvalues are left out."""
    gas, planck, avogadro = 8.314462618, 1.054571817e-34, 6.02214076e23
    values = np.linalg.eigvalsh(cov)[skip:]
    values = values[values > 1e-12]
    omega = np.sqrt(gas * temperature * 1e23 / values)
    b = planck * avogadro * omega / (gas * temperature)
    grown = np.expm1(b)
    s = gas * (b / grown - np.log1p(-np.exp(-b)))
    energy = gas * temperature * (b / 2 + b / grown) / 1000
    heat = gas * b * b * np.exp(b) / grown**2
    return {"entropy": float(s.sum()), "energy": float(energy.sum()), "heat_capacity": float(heat.sum())}


def frame_distances(a: np.ndarray, b: np.ndarray, out: np.ndarray, work: np.ndarray) -> np.ndarray:
    """Distances (N, A, B) of every atom between frames of two stacks (3, N, A) and (3, N, B), in `out`."""
    for axis in range(3):
        into = work if axis else out
        np.subtract(a[axis][:, :, None], b[axis][:, None], out=into)
        np.multiply(into, into, out=into)
        if axis:
            np.add(out, work, out=out)
    return np.sqrt(out, out=out)


def distance_sums(a: np.ndarray, b: np.ndarray | None, tall: int = 16, wide: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums over all ordered pairs of frames of two stacks (3, N, F), or of one with itself: products of two atoms'
    distances (N, N), and distances of every frame of the first (N, A) and of the second (N, B).

    Tiles of tall x wide frames bound what is held.
    """
    n, alone = a.shape[1], b is None
    other = a if alone else b
    gram, first, second = np.zeros((n, n)), np.zeros(a.shape[1:]), np.zeros(other.shape[1:])
    room = np.empty((2, n * tall * wide))
    for y in range(0, other.shape[2], wide):
        right = np.ascontiguousarray(other[:, :, y : y + wide])
        for x in range(0, y + right.shape[2] if alone else a.shape[2], tall):
            left = np.ascontiguousarray(a[:, :, x : x + tall])
            size = n * left.shape[2] * right.shape[2]
            out, work = (r[:size].reshape(n, left.shape[2], right.shape[2]) for r in room)
            d = frame_distances(left, right, out, work)
            if alone and x + left.shape[2] > y:  # across the diagonal: each pair once
                d *= np.arange(x, x + left.shape[2])[:, None] < np.arange(y, y + right.shape[2])
            flat = d.reshape(n, -1)
            gram += flat @ flat.T
            first[:, x : x + tall] += d.sum(2)
            second[:, y : y + wide] += d.sum(1)
    return 2 * gram, first + second if alone else first, None if alone else second


def distance_correlations(frames: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(i, j, dcor) of atom pairs, by distances of all frames with all frames, of which tiles are held at a time.

    Double centring needs the mean product of two atoms' distances, each frame's mean distance and the
    mean of all: groups of frames meet for their sums, and no matrix of frames by frames is made.
    """
    spark = frames.sparkSession
    atoms = sorted({int(k) for pair in pairs for k in pair})
    of = np.array(atoms, int) - 1
    # shared by the two kernels: arrays travel as bytes, "own" being the group that the sums belong to
    kind = "own long, n long, gram binary, sums binary"

    def meet(p: int, a: Group, q: int, b: Group | None) -> Iterator[pa.RecordBatch]:
        first, second = (None if g is None else np.ascontiguousarray(g.xyz[:, of].transpose(2, 1, 0)) for g in (a, b))
        gram, x, y = distance_sums(first, second)
        rows = [(p, x.shape[1], gram.tobytes(), x.tobytes())] + ([] if y is None else [(q, y.shape[1], None, y.tobytes())])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["own", "n", "gram", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        n, gram, sums = rows.column("n")[0].as_py(), np.zeros((len(of), len(of))), 0.0
        for r in rows.select(["gram", "sums"]).to_batches(1):
            gram += 0 if r.column(0)[0].as_py() is None else np.frombuffer(r.column(0)[0].as_py()).reshape(gram.shape)
            sums = sums + np.frombuffer(r.column(1)[0].as_py()).reshape(len(of), -1)
        return pa.table({"n": [n], "gram": [gram.tobytes()], "cross": [(sums @ sums.T).tobytes()], "total": [sums.sum(1).tobytes()]})

    parts = meetings(frames, meet, kind).groupBy("own").applyInArrow(add, "n long, gram binary, cross binary, total binary").collect()
    if not parts or not atoms:
        return spark.createDataFrame([], "i long, j long, dcor double")
    n = sum(r["n"] for r in parts)
    gram, cross = (sum(np.frombuffer(r[c]).reshape(len(of), len(of)) for r in parts) for c in ("gram", "cross"))
    total = sum(np.frombuffer(r["total"]) for r in parts)
    cov = gram / n**2 - 2 * cross / n**3 + np.outer(total, total) / n**4
    at = {k: i for i, k in enumerate(atoms)}

    def value(i: int, j: int) -> float:
        own = cov[i, i] * cov[j, j] if min(cov[i, i], cov[j, j]) > 0 else 0.0
        return float(np.sqrt(max(cov[i, j], 0) / np.sqrt(own))) if own > 0 else 0.0

    return spark.createDataFrame([(int(i), int(j), value(at[i], at[j])) for i, j in pairs], "i long, j long, dcor double")


def group_fluctuation(frames: DataFrame, group: str, atoms: Sequence[int]) -> DataFrame:
    """(group, i, j, mean, var): mean and variance of pair distances within every group of frames.

    Each partition adds up its own frames by group; only sums about each part's mean are shuffled.
    """
    of = np.array(atoms) - 1
    i, j = np.tril_indices(len(of), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            d = linalg.distances(stack(batch)[:, of])
            names, back = np.unique(np.asarray(batch.column("g")), return_inverse=True)
            for k, name in enumerate(names):
                mine = d[back == k]
                mean = mine.mean(0)
                n = len(mean)
                yield pa.record_batch([pa.array([name] * n), pa.array(np.arange(n)), pa.array(np.full(n, len(mine))), pa.array(mean), pa.array(((mine - mean) ** 2).sum(0))], ["g", "k", "n", "mean", "m2"])

    kind = frames.schema[group].dataType.simpleString()
    parts = frames.select(F.col(group).alias("g"), *AXES).mapInArrow(run, f"g {kind}, k long, n long, mean double, m2 double")
    middle = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    var = (F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean"))) / F.sum("n") - middle * middle
    sums = parts.groupBy("g", "k").agg(middle.alias("mean"), F.greatest(var, F.lit(0.0)).alias("var"))
    names = frames.sparkSession.createDataFrame([(k, int(atoms[a]), int(atoms[b])) for k, (a, b) in enumerate(zip(i, j))], "k long, i long, j long")
    return sums.join(F.broadcast(names), "k").select(F.col("g").alias(group), "i", "j", "mean", "var")
