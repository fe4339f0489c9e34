import numpy as np
import pytest

from orrery.sources import dcd, structures

PDB = """CRYST1   50.000   60.000   70.000  90.00  90.00  90.00 P 1           1
ATOM      1  N   SER A   1      83.880   5.268 -17.184  0.00  1.50      A
ATOM      2  CA ASER A   1      84.880   5.268 -17.184  1.00  2.50      A    C
ATOM      3  CA BSER A   1      84.990   5.268 -17.184  1.00  2.50      A    C
HETATM    4  O   HOH B   2       1.000   2.000   3.000  1.00  0.00
ENDMDL
ATOM      1  N   SER A   1      93.880   5.268 -17.184  0.00  0.00      A
ENDMDL
"""


def test_pdb(spark, tmp_path):
    path = tmp_path / "a.pdb"
    path.write_text(PDB)
    rows = structures.read_pdb(spark, str(path)).orderBy("atom_id").collect()
    assert [(r["atom_id"], r["atom_name"], r["chain_id"], r["seg_id"], r["res_seq"], r["pres_seq"], r["hetatm"]) for r in rows] == [(1, "N", "A", "A", 1, 1, False), (2, "CA", "A", "A", 1, 1, False), (3, "O", "B", "B", 2, 2, True)]
    assert rows[0]["x"] == 83.88 and rows[1]["b_factor"] == 2.5
    box = structures.read_box(spark, str(path)).first()
    assert (box["a"], box["c"]) == (50.0, 70.0) and abs(box["ang1"]) < 1e-9
    out = tmp_path / "out"
    structures.write_lines(structures.pdb_lines(structures.read_pdb(spark, str(path))), str(out))
    again = structures.read_pdb(spark, str(out)).orderBy("atom_id").collect()
    assert [r["x"] for r in again] == [r["x"] for r in rows] and [r["atom_name"] for r in again] == ["N", "CA", "O"]
    crd = tmp_path / "crd"
    structures.write_lines(structures.crd_lines(structures.read_pdb(spark, str(path))), str(crd))
    back = structures.read_crd(spark, str(crd)).orderBy("atom_id").collect()
    assert [(r["atom_name"], r["res_name"], r["x"]) for r in back] == [("N", "SER", 83.88), ("CA", "SER", 84.88), ("O", "HOH", 1.0)]


def test_models_and_xyz(spark, tmp_path):
    path = tmp_path / "m.pdb"
    path.write_text("".join(f"ATOM      {k}  C   ALA A   1    {8.0 + m:8.3f}   1.000   2.000\n" if k == 1 else f"ATOM      {k}  N   ALA A   1    {9.0 + m:8.3f}   1.000   2.000\n" for m in range(2) for k in (1, 2)).replace("9.000   1.000   2.000\nATOM      1", "9.000   1.000   2.000\nENDMDL\nATOM      1"))
    assert [r["x"] for r in structures.read_pdb_models(spark, str(path)).orderBy("frame").collect()] == [[8.0, 9.0], [9.0, 10.0]]
    xyz = tmp_path / "x.xyz"
    xyz.write_text("XYZ 2\n   1.000   2.000   3.000\n   4.000   5.000   6.000\nXYZ 2\n   7.000   8.000   9.000\n   1.000   1.000   1.000\n")
    assert [r["z"] for r in structures.read_xyz(spark, str(xyz)).orderBy("frame").collect()] == [[3.0, 6.0], [9.0, 1.0]]


def test_lists(spark, tmp_path):
    path = tmp_path / "l"
    path.write_text("# frames\n5\n\n3 # again\n5\n")
    assert [r["frame"] for r in structures.read_frame_list(spark, str(path)).orderBy("ord").collect()] == [5, 3, 5]
    path.write_text("1 2 0.5\n2 1 1.5\n")
    assert structures.read_links(spark, str(path)).count() == 2
    path.write_text("CA ALA 1.7\nN 1.5\n")
    assert [r["res_name"] for r in structures.read_radii(spark, str(path)).collect()] == ["ALA", "*"]


@pytest.mark.parametrize("boxed", [False, True])
def test_dcd(spark, tmp_path, boxed):
    rng = np.random.default_rng(1)
    xyz = rng.normal(size=(23, 3, 7)).astype("f4")
    path = str(tmp_path / "t.dcd")
    box = (10.0, 0.0, 20.0, 0.0, 0.0, 30.0)
    assert dcd.write(path, ((*f, box if boxed else None) for f in xyz), 7, boxed) == 23
    spark.dataSource.register(dcd.DcdSource)
    rows = spark.read.format("dcd").option("framesperpartition", "5").load(path)
    assert rows.rdd.getNumPartitions() == 5
    got = rows.orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(1, 24))
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], xyz)
    assert (got[0]["box"]["c"] == 30.0) if boxed else got[0]["box"] is None
    assert dcd.read_header(path).frames == 23


@pytest.mark.parametrize("atoms", [5, 40, 300])
def test_xtc(spark, tmp_path, atoms):
    from orrery.sources import xtc

    rng = np.random.default_rng(2)
    walk = np.cumsum(rng.normal(0, 0.6, (7, atoms, 3)) + (rng.random((7, atoms, 1)) < 0.1) * 20, axis=1)
    path = str(tmp_path / "t.xtc")
    assert xtc.write(path, ((*f.T, (50.0, 60.0, 70.0)) for f in walk)) == 7
    spark.dataSource.register(xtc.XtcSource)
    got = spark.read.format("xtc").option("framesperpartition", "3").load(path).orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(1, 8))
    assert np.allclose(np.array([[r["x"], r["y"], r["z"]] for r in got]).transpose(0, 2, 1), walk, atol=0.0051)
    assert got[0]["box"]["b"] == pytest.approx(60.0)


def test_packed_runs_and_wide_ranges():
    from orrery.sources import xtc

    rng = np.random.default_rng(3)
    for scale in (3, 200, 30_000_000):
        points = np.cumsum(rng.integers(-scale, scale + 1, (200, 3)), axis=0)
        body, low, high, small = xtc.pack(points)
        assert (xtc.unpack(body, 200, low, high, small) == points).all()
    assert len(xtc.pack(np.cumsum(rng.integers(-3, 4, (200, 3)), axis=0))[0]) < 200 * 4
