"""Kinetics of symbolic series: transitions, first passage, commitment, equilibrium.

A series is (traj_id, t, node); node 0 breaks a run. Everything that touches the series itself is a
window or an aggregation by trajectory. The fix-point solvers work on the links between nodes,
whose number is checked: up to `MAX_LINKS` they are solved in memory, beyond it by joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import cut, strong_components

MAX_LINKS = 5_000_000
ROOM = -0.002


def _by(descending: bool = False):
    return Window.partitionBy("traj_id", "run").orderBy(F.desc("t") if descending else "t")


def runs(series: DataFrame) -> DataFrame:
    """The series without breaks; each run between breaks has its own number."""
    before = Window.partitionBy("traj_id").orderBy("t")
    numbered = series.withColumn("run", F.sum(F.when(F.col("node") == 0, 1).otherwise(0)).over(before))
    return numbered.where("node <> 0")


def transitions(series: DataFrame) -> DataFrame:
    """(src, dst, w): number of steps from one node to the next within a run."""
    step = runs(series).withColumn("dst", F.lead("node").over(_by())).where("dst is not null")
    return step.groupBy(F.col("node").alias("src"), "dst").agg(F.count(F.lit(1)).alias("w"))


def weights(series: DataFrame) -> DataFrame:
    """(node, w): a visit counts 1, at either end of a run one half."""
    at_end = F.lag("t").over(_by()).isNull() | F.lead("t").over(_by()).isNull()
    return runs(series).withColumn("v", F.when(at_end, 0.5).otherwise(1.0)).groupBy("node").agg(F.sum("v").alias("w"))


def return_times(series: DataFrame, target: int, per_decade: int) -> DataFrame:
    """(bin, time, n, minus_log_share): steps since the last visit of the target, in logarithmic bins."""
    seen = F.last(F.when(F.col("node") == target, F.col("t")), True).over(_by().rowsBetween(Window.unboundedPreceding, -1))
    gaps = runs(series).withColumn("gap", F.col("t") - seen).where("gap is not null")
    bins = gaps.groupBy(F.floor(F.log10("gap") * per_decade).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = bins.agg(F.sum("n").alias("total"))
    return bins.join(F.broadcast(total)).select("bin", F.pow(F.lit(10.0), F.col("bin") / per_decade).alias("time"), "n", (-F.log(F.col("n") / F.col("total"))).alias("minus_log_share"))


def commitment(series: DataFrame, target: int, within: int) -> DataFrame:
    """(node, visits, hits, p): share of a node's visits that are followed by the target within so many steps."""
    ahead = F.first(F.when(F.col("node") == target, F.col("t")), True).over(_by().rowsBetween(1, Window.unboundedFollowing))
    judged = runs(series).withColumn("delay", ahead - F.col("t"))
    hit = F.when(F.col("delay") + 1 <= within, 1).otherwise(0)
    return judged.groupBy("node").agg(F.count(F.lit(1)).alias("visits"), F.sum(hit).alias("hits")).withColumn("p", F.col("hits") / F.col("visits"))


def basins(series: DataFrame, nodes: int, within: int, least_visits: int = 100) -> DataFrame:
    """(node, basin): nodes 1..nodes linked where one commits to the other in half of its visits or
    more; a basin is a component of links, named by its smallest node. Other nodes join the basin
    that their next step belongs to in half of their visits or more."""
    from ..functions.graph import connected

    named = [F.first(F.when(F.col("node") == k, F.col("t")), True).over(_by().rowsBetween(1, Window.unboundedFollowing)).alias(f"n{k}") for k in range(1, nodes + 1)]
    rows = runs(series).select("node", "t", *named).where(F.col("node") <= nodes)
    hits = rows.groupBy("node").agg(F.count(F.lit(1)).alias("visits"), *[F.sum(F.when(F.col(f"n{k}") - F.col("t") + 1 <= within, 1).otherwise(0)).alias(f"h{k}") for k in range(1, nodes + 1)])
    pairs = hits.select("node", "visits", F.posexplode(F.array(*[F.col(f"h{k}") for k in range(1, nodes + 1)])).alias("k", "h"))
    links = pairs.where((F.col("k") + 1 != F.col("node")) & (F.col("visits") >= least_visits) & (F.col("h") / F.col("visits") >= 0.5)).select(F.col("node").alias("a"), (F.col("k") + 1).alias("b"))
    own = hits.select("node", F.col("node").alias("basin"))
    found = connected(links).select("node", F.col("component").alias("c"))
    ranked = own.join(found, "node", "left").select("node", F.coalesce("c", "basin").cast("int").alias("basin"))
    follow = runs(series).withColumn("next", F.lead("node").over(_by())).where(F.col("node") > nodes)
    voted = follow.join(ranked.withColumnRenamed("node", "next"), "next", "left").groupBy("node", "basin").agg(F.count(F.lit(1)).alias("n"))
    share = voted.withColumn("total", F.sum("n").over(Window.partitionBy("node"))).where((F.col("basin").isNotNull()) & (F.col("n") / F.col("total") >= 0.5))
    best = share.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "basin"))).where("r = 1")
    return ranked.unionByName(best.select("node", "basin"))


class Links:
    """Normalised links in memory: sources, targets and probabilities by node number."""

    def __init__(self, links: DataFrame) -> None:
        rows = links.select("src", "dst", "w").limit(MAX_LINKS + 1).toArrow()
        if rows.num_rows > MAX_LINKS:
            raise ValueError(f"more than {MAX_LINKS} links: use the join form (solve_by_joins)")
        src, dst, w = (np.asarray(rows.column(c)) for c in ("src", "dst", "w"))
        self.nodes = np.unique(np.concatenate([src, dst]))
        self.src, self.dst, self.w = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst), w.astype(float)
        self.out = np.bincount(self.src, self.w, len(self.nodes))
        self.p = self.w / self.out[self.src]

    def at(self, node: int) -> int:
        k = int(np.searchsorted(self.nodes, node))
        if k == len(self.nodes) or self.nodes[k] != node:
            raise ValueError(f"no node {node}")
        return k

    def symmetric(self) -> Links:
        """Both directions with the mean of their weights."""
        both: dict[tuple[int, int], float] = {}
        for a, b, w in zip(self.src.tolist(), self.dst.tolist(), self.w.tolist()):
            for key in ((a, b), (b, a)):
                both[key] = both.get(key, 0.0) + w / 2
        out = object.__new__(Links)
        out.nodes = self.nodes
        out.src, out.dst = (np.array([k[i] for k in both], int) for i in range(2))
        out.w = np.array(list(both.values()))
        out.out = np.bincount(out.src, out.w, len(out.nodes))
        out.p = out.w / out.out[out.src]
        return out

    def _mean(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.src, self.p * values[self.dst], len(self.nodes))


def first_passage(links: Links, target: int, rounds: int = 50_000) -> np.ndarray:
    """Mean steps to the target of every node: m = 1 + sum p m, by repeated substitution until nothing moves."""
    to = links.at(target)
    m = np.zeros(len(links.nodes))
    for _ in range(rounds):
        new = 1 + links._mean(m)
        new[to] = 0
        if np.max(new - m, initial=0) <= 0:
            break
        m = new
    return m


def committor(links: Links, target: int, other: int | None = None, leak: float = 1e-4, rounds: int = 50_000) -> np.ndarray:
    """Probability to reach the target before the other node; without one, before leaking into a
    virtual node that every node enters with the given weight."""
    to = links.at(target)
    back = None if other is None else links.at(other)
    leak = 0.0 if back is not None else leak
    q = np.zeros(len(links.nodes))
    q[to] = 1
    for _ in range(rounds):
        new = links._mean(q) / (1 + leak)
        new[to] = 1
        if back is not None:
            new[back] = 0
        if np.max(np.abs(new - q), initial=0) <= 0:
            break
        q = new
    return q


def equilibrium(links: Links, rounds: int = 100_000) -> np.ndarray:
    """Stationary probabilities by power iteration from the links' weights."""
    p = links.out / links.out.sum()
    for _ in range(rounds):
        new = np.bincount(links.dst, links.p * p[links.src], len(p))
        new /= new.sum()
        if np.max(np.abs(new - p)) <= 0:
            break
        p = new
    return p


def profile(links: Links, values: np.ndarray, node_weights: np.ndarray, temperature: float = 300.0, downhill: bool = True) -> list[tuple[int, float, float, float]]:
    """Cut-based free energy profile: (node, value, share of weight before it, energy of the cut at its value)."""
    total = node_weights.sum()
    out = []
    for k in np.argsort(values if downhill else -values, kind="stable"):
        before = values < values[k] if downhill else values > values[k]
        crossing = 0.5 * links.w[before[links.src] != before[links.dst]].sum()
        energy = ROOM * temperature * np.log(crossing / total) if crossing > 0 else np.inf
        out.append((int(links.nodes[k]), float(values[k]), float(node_weights[before].sum() / total), float(energy)))
    return out


def strong(links: Links) -> dict[int, int]:
    """Smallest node of each node's strongly connected component."""
    names = links.nodes.tolist()
    return strong_components(names, [(names[a], names[b]) for a, b in zip(links.src, links.dst)])


def solve_by_joins(links: DataFrame, target: int, rounds: int) -> DataFrame:
    """(node, m): first-passage times after so many rounds, for links that don't fit in memory."""
    out = links.groupBy("src").agg(F.sum("w").alias("total"))
    p = cut(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = p.select(F.col("src").alias("node")).union(p.select("dst")).distinct()
    m = cut(nodes.withColumn("m", F.lit(0.0)))
    for _ in range(rounds):
        mean = p.join(m.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("p") * F.col("m")).alias("s"))
        m = cut(nodes.join(mean, "node", "left").select("node", F.when(F.col("node") == target, 0.0).otherwise(1 + F.coalesce("s", F.lit(0.0))).alias("m")))
    return m
