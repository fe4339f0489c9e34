"""Operators on small frames, the block planner, and the streaming counter."""

import numpy as np
import pytest

from orrery.functions import geometry as G
from orrery.operators import clusters, crossings, dense, manipulate, neighbours, shapes
from orrery.plans import blocks
from orrery.schema import frames as adapted
from orrery.schema import points, reference


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return adapted(spark, sf_dir).where("frame <= 40")


def stack_of(frames):
    return np.array([[r["x"], r["y"], r["z"]] for r in frames.orderBy("frame").collect()]).transpose(0, 2, 1)


def test_dense_sums_do_not_depend_on_partitions(small):
    ref = reference(small)
    xyz = stack_of(small)
    d = (xyz - xyz[0]).reshape(len(xyz), -1)
    for parts in (1, 7):
        cov, n = dense.covariance(small.repartition(parts), ref)
        assert n == len(xyz) and np.allclose(cov, d.T @ d / n)
        mean, var, _ = dense.pair_moments(small.repartition(parts), range(1, 22))
        i, j = np.tril_indices(21, -1)
        pair = np.linalg.norm(xyz[:, i] - xyz[:, j], axis=-1)
        assert np.allclose(mean, pair.mean(0)) and np.allclose(var, pair.var(0))


def test_aligned_has_the_superposed_deviation(small):
    ref = reference(small)
    moved = stack_of(dense.aligned(small, ref))
    target = np.array([ref[a] for a in "xyz"]).T
    direct = {r["frame"]: r["rmsd"] for r in dense.rmsd(small, ref).collect()}
    assert np.allclose(np.sqrt(((moved - target) ** 2).sum((1, 2)) / 21), [direct[k] for k in sorted(direct)])


def test_near_pairs_meet_once(spark):
    rng = np.random.default_rng(3)
    xyz = rng.uniform(-3, 3, (60, 3))
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "atom_id long, x double, y double, z double")
    got = {(r["i"], r["j"]) for r in neighbours.near_pairs(rows, 1.2).collect()}
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=-1)
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 1.2}


def test_clusters(small):
    xyz = stack_of(small)
    d = clusters.pair_distances(xyz, xyz, "rmsd")
    cutoff = float(np.quantile(d, 0.2))
    pairs = clusters.near_frames(small, cutoff, "rmsd", block=7)
    got = {(r["i"], r["j"]) for r in pairs.collect()}
    assert got == {(i + 1, j + 1) for i in range(40) for j in range(i + 1, 40) if d[i, j] < cutoff}
    from test_kernels import naive_quality

    expected = {frozenset(k + 1 for k in m): c + 1 for c, m in naive_quality(40, [(i - 1, j - 1) for i, j in got])}
    found = {}
    for r in clusters.quality_threshold(pairs).collect():
        found.setdefault((r["cluster"], r["center"]), set()).add(r["frame"])
    assert {frozenset(v): k[1] for k, v in found.items()} == expected
    assert [len(found[k]) for k in sorted(found)] == sorted(map(len, expected), reverse=True)


@pytest.mark.parametrize("listed", [1, 60, 10**6])
def test_quality_clusters_in_rounds(spark, listed):
    """However few lists are gathered at once; links that repeat count once and links of a node to itself not at all."""
    from orrery.functions.graph import quality_clusters

    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))] + [(70, 70), (71, 72), (72, 71)]
    pairs = spark.createDataFrame([(10**10 - a, 10**10 - b) for a, b in links * 2], "i long, j long")
    made = quality_clusters(73, [(72 - a, 72 - b) for a, b in links if a != b])
    expected = {(10**10 - 72 + k, n + 1, 10**10 - 72 + c[0]) for n, c in enumerate(made) for k in c}
    rows = clusters._quality(clusters._pair_sheets(pairs), listed).collect()
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)
    assert sorted(map(tuple, clusters.quality_threshold(pairs).collect())) == sorted(expected)


def test_quality_clusters_of_frames(small):
    """Straight from frames as from their near pairs, several trajectories and groups of frames included."""
    from pyspark.sql import functions as F

    many = small.crossJoin(small.sparkSession.range(30)).withColumn("frame", F.col("frame") * 100 + F.col("id"))
    for method, cutoff in (("in_place", 0.27), ("drms", 0.1)):
        expected = clusters.quality_threshold(clusters.near_frames(many, cutoff, method)).collect()
        assert sorted(clusters.quality_frames(many.repartition(9), cutoff, method).collect()) == sorted(expected)
    assert clusters.quality_frames(small.where("frame < 0"), 1.0).count() == 0


@pytest.mark.parametrize("mode", ["markov", "first", "nearest"])
def test_leader(small, mode):
    from pyspark.sql import functions as F

    one = small.withColumn("traj_id", F.lit(1))
    rows = sorted(clusters.leader(one, 0.3, "in_place", mode).collect(), key=lambda r: r["frame"])
    assert rows[0]["distance"] is None and rows[0]["center"] == 1
    assert all((r["distance"] is None) == (r["frame"] == r["center"]) for r in rows)
    assert all(r["distance"] is None or r["distance"] < 0.3 for r in rows)


def test_distance_correlations_of_many_frames(spark):
    """Repeating every frame alike changes no distance correlation, so 20,100 frames must give what 300 give."""
    xyz = np.random.default_rng(8).normal(size=(300, 3, 3))
    xyz[:, 1] += xyz[:, 0] ** 2
    xyz[:, 2] = 0.5
    rows = [(k + 1, *[f[:, a].tolist() for a in range(3)]) for k, f in enumerate(xyz)]
    few = spark.createDataFrame(rows, "frame long, x array<double>, y array<double>, z array<double>").coalesce(1)
    many = few.crossJoin(spark.range(67)).drop("id")
    for frames in (few, many):
        found = {(r["i"], r["j"]): r["dcor"] for r in dense.distance_correlations(frames, [(2, 1), (3, 1)]).collect()}
        assert found == {(2, 1): pytest.approx(dense.distance_correlation(xyz[:, 1], xyz[:, 0]), abs=1e-9), (3, 1): 0}
    assert dense.distance_correlations(few.where("frame < 0"), [(2, 1)]).count() == 0


@pytest.mark.parametrize("method", ["in_place", "rmsd", "drms"])
def test_hierarchical_merges_the_nearest_first(small, method):
    from pyspark.sql import functions as F

    xyz = stack_of(small)
    d = clusters.pair_distances(xyz, xyz, method)
    d = np.triu(d, 1) + np.triu(d, 1).T
    cutoff = float(np.quantile(d, 0.6))
    groups = [[k] for k in range(len(d))]
    while True:
        apart = [(d[np.ix_(a, b)].max(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        if not apart or min(apart)[0] >= cutoff:
            break
        _, i, j = min(apart)
        groups[i] += groups.pop(j)
    found = {}
    for r in clusters.hierarchical(small.withColumn("traj_id", F.lit(1)), cutoff, method).collect():
        found.setdefault(r["cluster"], set()).add(r["frame"] - 1)
    assert [found[k] for k in sorted(found)] == sorted(map(set, groups), key=lambda g: (-len(g), min(g)))
    assert 1 < len(found) < len(d)


def test_hierarchical_of_many_frames(spark):
    """12,000 frames on a line: neighbours merge in pairs from the first on, without a matrix of frames by frames."""
    frames = spark.range(12_000).selectExpr("1 as traj_id", "id + 1 as frame", "array(double(id)) as x", "array(0D) as y", "array(0D) as z")
    rows = clusters.hierarchical(frames, 1.5, "in_place").collect()
    assert sorted((r["frame"], r["cluster"]) for r in rows) == [(k + 1, k // 2 + 1) for k in range(12_000)]


def test_empty_frames(small):
    none = small.where("frame < 0")
    ref = reference(small)
    assert dense.covariance(none, ref)[1] == 0
    assert dense.rmsd(none, ref).count() == 0
    assert clusters.near_frames(none, 1.0).count() == 0
    assert manipulate.average(points(none)).count() == 0


def test_one_letter_and_contacts(spark):
    rows = spark.createDataFrame([("ala",), ("TRP",), ("HOH",)], "n string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(G.one_letter(F.col("n"))).collect()] == ["A", "W", "X"]
    assert spark.range(1).select(G.sigmoid_contact(F.lit(2.0), 2.0)).first()[0] == 0.5


def test_pore_of_a_tube(spark):
    ring = [(2.0 * np.cos(t), 2.0 * np.sin(t), z) for z in np.arange(-1, 1.01, 0.25) for t in np.linspace(0, 2 * np.pi, 24, endpoint=False)]
    x, y, z = (list(map(float, v)) for v in zip(*ring))
    frames = spark.createDataFrame([(1, x, y, z)], "frame long, x array<double>, y array<double>, z array<double>")
    found = {round(r["at"], 1): r["radius"] for r in shapes.pore(frames, [0.5] * len(x), [0.3, 0, 0], [0, 0, 1], step=0.5, widest=3.0, trials=300).collect()}
    assert found[0.0] == pytest.approx(1.5, abs=0.1)
    assert max(found.values()) > 3.0


def test_blocks(small, spark):
    atoms = spark.range(1, 22).selectExpr("cast(id as int) as atom_id", "'A' as chain_id", "'S' as seg_id", "cast(id as int) as res_seq", "'C' as atom_name")
    text = """
    begin distance
      --TITLE d
      --SELE /*/*/1/* : /*/*/5/*
    END
    BEGIN contacts
      --TITLE c
      --SELE /*/*/1/* : /*/*/5/* : 0.2
    END
    BEGIN rmsd
      --SELE /*/*/1-10/*
    END
    BEGIN rmsf
    END
    """
    made = blocks.run(text, blocks.context(small, atoms))
    assert made["frames"].columns == ["frame", "d", "c", "rmsd"] and made["frames"].count() == 40
    assert made["rmsf_4"].count() == 21
    for bad in ("BEGIN x\nEND", "BEGIN rgyr", "END", "BEGIN rgyr\n--SELE /Q\nEND"):
        with pytest.raises(blocks.BlockError):
            blocks.run(bad, blocks.context(small, atoms))


def naive_crossings(values, lower, upper, delta):
    status, n = 3, 0
    for z in values:
        new = 3 if z >= upper + delta or z <= lower - delta else 1 if z >= upper else 0 if z <= lower else status
        n += new != 3 and status != 3 and new != status
        status = new
    return n


def test_crossings_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(6)
    values = {k: rng.uniform(-12, 12, 50).tolist() for k in range(4)}
    rows = [(k, t, v) for k, vs in values.items() for t, v in enumerate(vs)]
    expected = {k: naive_crossings(vs, -3, 3, 5) for k, vs in values.items()}
    table = spark.createDataFrame(rows, "atom long, frame long, z double")
    assert {r["atom"]: r["n"] for r in crossings.crossings(table, "atom", "frame", "z", -3.0, 3.0).collect()} == expected

    from orrery.streaming import crossings as streaming

    for part in range(5):
        table.where(f"frame >= {part * 10} and frame < {part * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = streaming.crossings(stream, "atom", "frame", "z", -3.0, 3.0)
    query = counted.writeStream.outputMode("update").format("memory").queryName("crossed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {}
    for r in spark.table("crossed").collect():
        if r["late"] == 0:
            got[r["key"]] = max(got.get(r["key"], 0), r["n"])
    assert got == expected


def test_merging_links_and_counts(spark, small):
    from orrery.operators import networks

    rows = [(1, 1, 2, 9.0), (1, 3, 4, 8.0), (1, 2, 3, 2.0), (1, 1, 4, 1.0), (1, 4, 5, 3.0)]
    found = spark.createDataFrame(rows, "frame long, r1 long, r2 long, strength double")
    assert [tuple(r) for r in networks.merging_links(found, 5.0).collect()] == [(1, 2, 3, 2.0)]
    net = networks.Network(tuple(k // 3 for k in range(21)), (3.0,) * 7, tuple(range(1, 8)), cutoff=0.2, proximity=1)
    counts = networks.contact_counts(small, net, ["A", "B", "A", "B", "A", "B", "A"])
    each = counts.groupBy("res_name").sum("n").collect()
    pairs = networks.interactions(small, net).groupBy().sum("n_pairs").first()[0]
    assert sum(r[1] for r in each) == 2 * pairs


def test_series_text(spark, tmp_path):
    from orrery.sources import structures

    rows = spark.createDataFrame([(2, 1.5, "HH"), (1, 2.25, "LL")], "frame int, dist double, ss string")
    structures.write_lines(structures.series_lines(rows), str(tmp_path / "t"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert text == ["#   nFr       dist         ss", "      1      2.250         LL", "      2      1.500         HH"]


def _two_trajectories(spark, shift=0.0):
    rows = [(t, f, [float(f * (t + 1)) + shift, 0.0, 1.0], [0.0, float(t), 0.0], [0.0, 1.0, float(f)]) for t in (0, 1) for f in (1, 2, 3)]
    return spark.createDataFrame(rows, "traj_id long, frame long, x array<double>, y array<double>, z array<double>")


def test_trajectories_are_told_apart(spark):
    """Frame numbers repeat between trajectories: previous frames, sums and pairs stay within their own."""
    import pytest
    from pyspark.sql import functions as F

    from orrery.operators import clusters, manipulate

    whole = _two_trajectories(spark)
    got = {(r["traj_id"], r["frame"]): r["rmsd"] for r in manipulate.progressive_rmsd(whole).collect()}
    assert got == {(t, f): pytest.approx((((t + 1) ** 2 + 1) / 3) ** 0.5) for t in (0, 1) for f in (2, 3)}
    zero = {a: [0.0] * 3 for a in "xyz"}
    total = {(r["traj_id"], r["frame"]): r["x"] for r in manipulate.add_up([whole, whole], zero, [1, 2, 3]).collect()}
    assert len(total) == 6 and total[1, 3] == [12.0, 0.0, 2.0]
    wide = {(r["traj_id"], r["frame"]): len(r["x"]) for r in manipulate.side_by_side(whole, whole).collect()}
    assert wide == {(t, f): 6 for t in (0, 1) for f in (1, 2, 3)}
    with pytest.raises(Exception, match="different frames"):
        manipulate.side_by_side(whole, whole.where("frame < 3")).collect()
    numbered = whole.withColumn("id", F.col("traj_id") * 10 + F.col("frame"))
    pairs = {(r["i"], r["j"]) for r in clusters.near_frames(numbered, 100.0, "in_place", block=2, id_col="id").collect()}
    ids = [1, 2, 3, 11, 12, 13]
    assert pairs == {(a, b) for a in ids for b in ids if a < b}
    assert clusters.near_frames(whole, 100.0, "in_place", block=2).count() == 15


def test_context_takes_the_structure_as_reference(spark):
    import pytest

    from orrery.plans import blocks

    whole = _two_trajectories(spark).where("traj_id = 0").drop("traj_id")
    structure = spark.createDataFrame([(k, "A", "A", k, "C", float(k), 0.0, 0.0, float(k)) for k in (1, 2, 3)], "atom_id long, chain_id string, seg_id string, res_seq long, atom_name string, x double, y double, z double, b_factor double")
    on = blocks.context(whole, structure)
    assert on.reference["x"] == [1.0, 2.0, 3.0] and on.masses == [1.0, 2.0, 3.0]
    text = "BEGIN rgyr\n--TITLE g\n--SELE /*/*/*/*\n--MASS\nEND\n"
    heavy = {r["frame"]: r["g"] for r in blocks.run(text, on)["frames"].collect()}
    plain = {r["frame"]: r["g"] for r in blocks.run(text.replace("--MASS\n", ""), on)["frames"].collect()}
    assert all(abs(heavy[f] - plain[f]) > 1e-3 for f in heavy)
    with pytest.raises(blocks.BlockError):
        blocks.run(text, blocks.context(whole, structure.drop("b_factor")))
