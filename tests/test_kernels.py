"""Numeric kernels against identities and plain loops."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.functions import graph, linalg
from orrery.operators import clusters, dense, kinetics, networks, secondary, shapes, springs


def turned(xyz, rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    return xyz @ q + rng.normal(size=3)


def test_superposition():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 3))
    stack = np.array([turned(a, rng) for _ in range(5)])
    assert linalg.rmsd(stack, a).max() < 1e-9
    assert np.abs(linalg.distances(stack) - linalg.distances(a[None])).max() < 1e-9
    mirror = a * [1, 1, -1]
    assert linalg.rmsd(mirror[None], a)[0] > 0.1
    b = stack + rng.normal(0, 0.2, stack.shape)
    assert np.allclose(clusters.pair_distances(b, a[None], "rmsd")[:, 0], linalg.rmsd(b, a))
    assert np.allclose(clusters.pair_distances(b, b, "drms")[0, 1], linalg.drms(linalg.distances(b[:1]), linalg.distances(b[1:2])))


def test_surfaces_agree():
    rng = np.random.default_rng(2)
    dots = shapes.sphere(5)
    assert shapes.sphere(1).shape == (60, 3)
    assert np.abs(np.linalg.norm(dots, axis=1) - 1).max() < 1e-12
    for n in (1, 2, 4, 9):
        xyz, r = rng.normal(0, 2, (n, 3)), rng.uniform(1, 2, n)
        exact = [shapes.arc_area(xyz, r, i) for i in range(n)]
        assert np.abs(np.array(exact) - shapes._exposed(xyz, r, np.arange(n), dots)).max() < 0.1
    two = np.array([[0.0, 0, 0], [1.5, 0, 0]])
    assert shapes.arc_area(two, np.array([1.0, 1.0]), 0) == pytest.approx(4 * np.pi - 2 * np.pi * 0.25)


def test_volume_of_a_sphere():
    low, step = np.full(3, -2.0), 0.05
    got = shapes.filled_voxels(np.zeros((1, 3)), np.array([1.0]), low, step, (80, 80, 80)).sum() * step**3
    assert got == pytest.approx(4 / 3 * np.pi, rel=0.01)


def test_inertia_axis_of_a_rod():
    rod = np.zeros((1, 10, 3))
    rod[0, :, 1] = np.arange(10)
    assert abs(shapes.inertia_axis(rod)[0] @ [0, 1, 0]) == pytest.approx(1)


def test_spring_network():
    rng = np.random.default_rng(3)
    xyz = rng.normal(0, 3, (10, 3))
    h = springs.hessian(xyz, springs.linear(100.0))
    assert np.allclose(h, h.T)
    values = np.linalg.eigvalsh(h)
    assert np.abs(values[:6]).max() < 1e-8 < values[6]
    w, v = springs.modes(h)
    blocks = springs.rigid_blocks(xyz, [[k] for k in range(1, 11)][:0] or [list(range(1, 6)), list(range(6, 11))])
    assert np.allclose(blocks.T @ blocks, np.eye(12))
    bw, bv = springs.block_modes(h, blocks)
    assert len(bw) == 6 and bw.min() >= w[0] - 1e-8
    assert np.allclose(springs.cumulative_overlap(springs.overlap(v, v[:, 0]))[-1], 1)
    assert springs.inner_product(v, v, 5) == pytest.approx(1)
    assert (springs.b_factors(w, v) > 0).all()
    assert np.allclose(np.diag(springs.correlation(w, v)), 1)
    assert springs.effective(h, [1, 2, 3]).shape == (9, 9)
    # stiffening an atom's springs raises frequencies as the network's own derivative says
    k = springs.linear(100.0)
    gain = springs.perturbation(xyz, k, v, w, 1e-6)[0]

    def stiff(d):
        out = k(d)
        out[0] *= 1 + 1e-6
        out[:, 0] *= 1 + 1e-6
        return out

    moved = np.sqrt(np.linalg.eigvalsh(springs.hessian(xyz, stiff))[6:]) - np.sqrt(w)
    assert np.allclose(gain, moved, atol=1e-9)


def test_entropy_falls_with_stiffness():
    loose, tight = np.diag(np.linspace(1, 3, 12)), np.diag(np.linspace(0.1, 0.3, 12))
    assert dense.entropy(loose)["entropy"] > dense.entropy(tight)["entropy"] > 0


def test_distance_correlation():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    assert dense.distance_correlation(x, x) == pytest.approx(1)
    assert dense.distance_correlation(x, rng.normal(size=(200, 3))) < 0.35
    assert dense.distance_correlation(x, x**2) > 0.3


def naive_quality(n, pairs):
    near = {k: {k} for k in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    left, out = set(range(n)), []
    while left:
        best = max(sorted(left), key=lambda k: len(near[k] & left))
        mine = near[best] & left
        if len(mine) < 2:
            break
        out.append((best, sorted(mine)))
        left -= mine
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 12).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda p: p[0] < p[1]), max_size=30))))
def test_graph_kernels(case):
    n, pairs = case
    got = [(c[0], sorted(c)) for c in graph.quality_clusters(n, pairs)]
    assert got == naive_quality(n, pairs)
    reach = np.eye(n, dtype=bool)
    for a, b in pairs:
        reach[a, b] = True
    for k in range(n):
        reach |= np.outer(reach[:, k], reach[k])
    both = reach & reach.T
    strong = graph.strong_components(range(n), pairs)
    assert [strong[k] for k in range(n)] == [int(np.argmax(both[k])) for k in range(n)]
    weak = graph.components(n, pairs)
    for a, b in pairs:
        assert weak[a] == weak[b]


def test_shortest_paths_keep_ties():
    edges = {}
    for a, b, w in [(1, 2, 1), (2, 4, 1), (1, 3, 1), (3, 4, 1), (1, 4, 3)]:
        edges.setdefault(a, []).append((b, w))
        edges.setdefault(b, []).append((a, w))
    assert graph.shortest_paths(edges, 1, 4) == (2, [(1, 2, 4), (1, 3, 4)])
    assert graph.shortest_paths(edges, 1, 9) == (float("inf"), [])
    assert all(np.isfinite(f(50.0, 100.0)) for f in networks.WEIGHTS.values())


def test_linkage_is_complete():
    d = np.abs(np.subtract.outer([0.0, 1, 2, 10, 11], [0.0, 1, 2, 10, 11]))
    label = clusters.linkage(d, 2.5)
    assert len(set(label[:3])) == 1 and label[3] == label[4] != label[0]
    assert len(set(clusters.linkage(d, 1.5)[:3])) == 2


def test_embedding_keeps_groups_apart():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.1, (25, 5)), rng.normal(5, 0.1, (25, 5))])
    y = clusters.embed(x, perplexity=10, rounds=400)
    within = np.linalg.norm(y[:25] - y[:25].mean(0), axis=1).mean()
    assert np.linalg.norm(y[:25].mean(0) - y[25:].mean(0)) > 2 * within
    with pytest.raises(ValueError):
        clusters.embed(x, perplexity=30)


def chain_links(spark, rows):
    return kinetics.Links(spark.createDataFrame(rows, "src int, dst int, w double"))


def test_kinetics_of_two_states(spark):
    links = chain_links(spark, [(1, 1, 9.0), (1, 2, 1.0), (2, 1, 2.0), (2, 2, 8.0)])
    assert kinetics.first_passage(links, 1)[1] == pytest.approx(5, rel=1e-6)
    assert kinetics.equilibrium(links) == pytest.approx([2 / 3, 1 / 3])
    assert kinetics.committor(links, 1, 2).tolist() == [1, 0]
    walk = chain_links(spark, [(a, b, 1.0) for a in range(1, 6) for b in (a - 1, a + 1) if 1 <= b <= 5])
    assert kinetics.committor(walk, 5, 1) == pytest.approx([0, 0.25, 0.5, 0.75, 1], abs=1e-9)
    joins = kinetics.solve_by_joins(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src int, dst int, w double"), 1, 5)
    assert {r["node"]: r["m"] for r in joins.collect()} == {1: 0.0, 2: 1.0}
    assert walk.symmetric().w.sum() == walk.w.sum()


def test_breaks_cut_series(spark):
    rows = [("a", k + 1, n) for k, n in enumerate([1, 2, 0, 1, 1, 2, 3])]
    found = kinetics.transitions(spark.createDataFrame(rows, "traj_id string, t int, node int"))
    assert {(r["src"], r["dst"]): r["w"] for r in found.collect()} == {(1, 2): 2, (1, 1): 1, (2, 3): 1}


def helix(residues):
    """An ideal alpha helix as rows of N, H, CA, C, O."""
    out = np.full((residues, 5, 3), np.nan)
    radius = {0: 1.55, 2: 2.29, 3: 1.67, 4: 1.99}
    turn = {0: -27.3, 2: 0.0, 3: 26.1, 4: 18.0}
    rise = {0: -0.88, 2: 0.0, 3: 1.13, 4: 2.33}
    for k in range(residues):
        for a in radius:
            t = np.radians(100 * k + turn[a])
            out[k, a] = [radius[a] * np.cos(t), radius[a] * np.sin(t), 1.5 * k + rise[a]]
    for k in range(1, residues):
        back = out[k - 1, 3] - out[k - 1, 4]
        out[k, 1] = out[k, 0] + back / np.linalg.norm(back)
    return out


def test_secondary_structure():
    letters = secondary.assign(helix(16))
    assert letters[5:10] == "HHHHH"
    assert secondary.assign(helix(16), continuous=True)[6] == "H"
    straight = np.full((6, 5, 3), np.nan)
    straight[:, 2] = np.arange(6)[:, None] * [3.8, 0, 0]
    assert secondary.assign(straight) == "LLLLLL"


def test_all_rings_of_two_squares(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (3, 5), (5, 6), (6, 4)], "a long, b long")
    found = {tuple(sorted(r["ring"])) for r in graph.rings(edges, 6).collect()}
    assert found == {(1, 2, 3, 4), (3, 4, 5, 6), (1, 2, 3, 4, 5, 6)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([("g", k, k + 1) for k in range(1, 60)] + [("h", 5, 9)], "g string, a long, b long")
    got = {(r["g"], r["node"]): r["component"] for r in graph.connected(edges, ["g"]).collect()}
    assert set(got.values()) == {1, 5} and got["h", 9] == 5 and got["g", 60] == 1


def test_hub_pairs(spark):
    rows = [(f, 1, k, 1, 50.0, 50.0, 50.0) for f in (1, 2) for k in (2, 3)] + [(f, 2, 4, 1, 50.0, 50.0, 50.0) for f in (1, 2)]
    found = spark.createDataFrame(rows, "frame long, r1 long, r2 long, n_pairs long, strength double, hub1 double, hub2 double")
    assert {(r["a"], r["b"]): r["correlation"] for r in networks.hub_correlation(found, 10, 2, 1).collect()} == {(1, 2): 1.0}
    assert {r["residue"]: r["f50"] for r in networks.stable_degrees(found, 10, 2).collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    for pairs in itertools.islice(networks.Network((0, 1), (1.0, 1.0), (1, 9)).pairs(), 1):
        assert pairs == (0, 1)
