"""Every module by its block, over a small structure and over small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.plans import blocks, modules


@pytest.fixture(scope="module")
def on(spark):
    rng = np.random.default_rng(1)
    base = np.cumsum(rng.normal(0, 1.5, (15, 3)), axis=0)
    rows = []
    for k in range(24):
        xyz = base + rng.normal(0, 0.3, base.shape)
        rows.append((1, k + 1, *[[float(v) for v in xyz[:, a]] for a in range(3)]))
    frames = spark.createDataFrame(rows, "traj_id int, frame long, x array<double>, y array<double>, z array<double>")
    names = ["N", "H", "CA", "C", "O"] * 3
    atoms = spark.createDataFrame([(k + 1, "A", "S", k // 5 + 1, "ALA", names[k], 1.5) for k in range(15)], "atom_id int, chain_id string, seg_id string, res_seq int, res_name string, atom_name string, b_factor double")
    return blocks.context(frames, atoms, masses=[12.0] * 15)


CASES = {
    "msdf": ("--SELE /CA", 3),
    "corr dcc": ("--SELE /CA", 3),
    "corr lmi": ("--TYPE LMI\n--SELE /CA", 3),
    "corr dcor": ("--TYPE DCOR\n--SELE /CA", 3),
    "corr fluct": ("--TYPE FLUCT\n--SELE /CA", 3),
    "entropy": ("", 1),
    "cluster leader": ("--CUTOFF 0.5", 24),
    "cluster hiero": ("--METHOD hiero\n--CUTOFF 0.5", 24),
    "cluster qt": ("--METHOD qt\n--CUTOFF 5.0", 24),
    "cluster tsne": ("--METHOD tsne\n--PERPLEXITY 5\n--IMAX 50", 24),
    "cassign": ("--CENTERS 1,5\n--CUTOFF 9", 24),
    "psn": ("--PROXIMITY 1", None),
    "psn hubs": ("--PROXIMITY 1\n--REPORT hubs\n--HUBCONTCUTOFF 1", None),
    "psn auto": ("--PROXIMITY 1\n--INTMIN AUTO", 24),
    "surf": ("--NDIV 1", 24),
    "surf arvo": ("--ALGO ARVO", 24),
    "surf esurf": ("--CALC ESURF\n--NDIV 1", 24),
    "surfcluster": ("--NDIV 1\n--BIN 5", 24),
    "tilt": ("--SELEAXIS /*/*/1/*\n--SELE /*/*/2/*", 24),
    "tilt dec": ("--DEC\n--SELEAXIS /*/*/1/*\n--SELEREF /*/*/3/*\n--SELE /*/*/2/*", 24),
    "twist": ("--SELEAXIS /*/*/*/*\n--SELE /*/*/1/N : /*/*/1/C\n--SELE /*/*/2/N : /*/*/2/C", 24),
    "flux": ("--LOWER -1\n--UPPER 1", 15),
    "ssa": ("", 24),
    "project": ("--SELE /CA", 24),
    "enm": ("--CUTOFF 30", 24),
    "volume": ("--LIGAND /*/*/1/*", 24),
}


@pytest.mark.parametrize("case", CASES)
def test_module(on, case):
    options, rows = CASES[case]
    made = blocks.run(f"BEGIN {case.split()[0]}\n{options}\nEND", on)
    (result,) = made.values()
    found = result.count()
    assert rows is None or found == rows


def test_surfaces_of_one_block_agree(on):
    text = "BEGIN surf\n--TITLE dots\n--NDIV 4\nEND\nBEGIN surf\n--TITLE arcs\n--ALGO ARVO\nEND"
    rows = blocks.run(text, on)["frames"].collect()
    assert all(abs(r["dots"] - r["arcs"]) < 0.02 * r["arcs"] for r in rows)


def test_data_blocks(spark):
    rng = np.random.default_rng(2)
    nodes = [int(v) for v in rng.integers(1, 4, 300)]
    series = spark.createDataFrame([("a", k + 1, n) for k, n in enumerate(nodes)], "traj_id string, t int, node int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 1)], "a long, b long")
    dist = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.2), (1, 3, 0.9), (4, 5, 0.1)], "i long, j long, d double")
    vectors = spark.createDataFrame([(m, c, float(m == c)) for m in (1, 2, 3) for c in (1, 2, 3)], "mode int, component int, value double")
    counts = spark.createDataFrame([("ALA", 3), ("ALA", 5), ("GLY", 1)], "res_name string, n int")
    values = spark.range(1, 50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    links = spark.createDataFrame([(1, 1, 2, 4, 50.0), (1, 2, 3, 4, 50.0)], "frame long, r1 long, r2 long, n_pairs long, strength double")
    tables = {"series": series, "edges": edges, "dist": dist, "first": vectors, "second": vectors, "counts": counts, "areas": values, "interactions": links}
    text = "\n".join(
        f"BEGIN {name}\n{options}\nEND"
        for name, options in [
            ("logbin", "--TARGET 1"), ("basin", "--TARGET 1\n--TCOMM 5"), ("ka", "--NNODES 3\n--TCOMM 5"), ("mfpt", "--TARGET 1"), ("pfoldf", "--TARGET 1\n--TARGET2 2"), ("pfoldfnet", "--TARGET 1\n--LAMBDA 0.01"),
            ("equil", ""), ("elec", ""), ("ring", "--DIM 5"), ("cluster", "--CUTOFF 0.5"), ("psnpath", "--FROM 1\n--TO 3"), ("psnparam", ""), ("pcatools", ""), ("surfcorr", ""), ("mfptnet", "--TARGET 2\n--SYMM"),
        ]
    )
    made = {k.rsplit("_", 1)[0]: v.collect() for k, v in modules.run_data(spark, text, tables).items()}
    assert [r["size"] for r in made["ring"]] == [5]
    assert {r["frame"]: r["center"] for r in made["cluster"]} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 4}
    assert made["psnpath"][0]["path"] == "1-2-3"
    assert {r["res_name"]: r["largest"] for r in made["psnparam"]} == {"ALA": 5, "GLY": 1}
    assert made["surfcorr"][0]["linear"] == pytest.approx(1)
    assert {r["overlap"] for r in made["pcatools"]} == {0.0, 1.0}
    assert sum(r["p"] for r in made["equil"]) == pytest.approx(1)
    assert {r["node"]: r["value"] for r in made["pfoldf"]}[1] == 1.0
    with pytest.raises(blocks.BlockError):
        modules.run_data(spark, "BEGIN nothing\nEND")
    with pytest.raises(blocks.BlockError):
        modules.run_data(spark, "BEGIN mfpt\nEND", {"series": series})


def test_residue_norms_by_name():
    from orrery.operators import networks

    assert networks.norm_of("ala") == 55.7551 and networks.norm_of("HOH") == networks.norm_of("WAT") == 27.0
    assert networks.norm_of("XXX") == networks.norm_of(None) == networks.UNKNOWN_NORM
    assert networks.norm_of("XXX", {"XXX": 12.0}) == 12.0
