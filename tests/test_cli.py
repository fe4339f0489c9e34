import numpy as np
import pytest

from orrery import cli
from orrery.sources import dcd, files, structures


@pytest.fixture(scope="module")
def here(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("cli")
    lines = [f"ATOM  {k:5d}  {'CA ' if k % 2 else 'CB '} ALA A{(k + 1) // 2:4d}    {k:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00      A" for k in range(1, 7)]
    (folder / "a.pdb").write_text("\n".join(lines) + "\n")
    rng = np.random.default_rng(1)
    xyz = rng.normal(0, 5, (8, 3, 6)).astype("f4")
    dcd.write(str(folder / "a.dcd"), ((*f, None) for f in xyz), 6)
    (folder / "list.txt").write_text(f"{folder}/a.dcd\n{folder}/a.dcd\n")
    return folder, xyz.astype(float)


def read(spark, path):
    rows = files.read_trajectory(spark, str(path)).orderBy("frame").collect()
    return np.array([[r["x"], r["y"], r["z"]] for r in rows])


def test_trajectories(spark, here, capsys):
    folder, xyz = here
    go = lambda *argv: cli.run(spark, [str(a) for a in argv])
    go("merge", folder / "list.txt", folder / "m.dcd")
    assert np.allclose(read(spark, folder / "m.dcd"), np.concatenate([xyz, xyz]))
    go("append", folder / "a.dcd", folder / "m.dcd", folder / "ap.xtc")
    assert np.allclose(read(spark, folder / "ap.xtc"), np.concatenate([xyz] * 3), atol=0.0051)
    go("extract", folder / "a.dcd", "3-4|1", folder / "e.dcd", "--structure", folder / "a.pdb", "--select", "/CA")
    assert np.allclose(read(spark, folder / "e.dcd"), xyz[[2, 3, 0]][:, :, [0, 2, 4]])
    go("combine", folder / "list.txt", folder / "c.parquet")
    assert np.allclose(read(spark, folder / "c.parquet"), np.concatenate([xyz, xyz], axis=2))
    go("add-structure", folder / "a.dcd", folder / "a.pdb", folder / "s.dcd")
    assert read(spark, folder / "s.dcd")[-1, 0].tolist() == [1, 2, 3, 4, 5, 6]
    go("sum", folder / "list.txt", folder / "a.pdb", "/*/*/*/*", folder / "sum.parquet")
    base = np.array([np.arange(1, 7), np.zeros(6), np.zeros(6)])
    assert np.allclose(read(spark, folder / "sum.parquet"), 2 * xyz - base)
    go("mono", folder / "a.pdb", folder / "one.dcd")
    assert read(spark, folder / "one.dcd").shape == (1, 3, 6)
    go("header", folder / "a.dcd")
    assert "|8 " in capsys.readouterr().out


def test_structures(spark, here, capsys):
    folder, xyz = here
    go = lambda *argv: cli.run(spark, [str(a) for a in argv])
    go("convert", folder / "a.pdb", folder / "ca.crd", "--select", "/CA")
    assert structures.read_crd(spark, str(folder / "ca.crd")).count() == 3
    go("average", folder / "a.dcd", folder / "a.pdb", folder / "mean.pdb", "--begin", "2", "--skip", "3")
    got = files.read_structure(spark, str(folder / "mean.pdb")).orderBy("atom_id").collect()
    assert np.allclose([r["x"] for r in got], xyz[1::3, 0].mean(0), atol=0.0006)
    go("check-selection", folder / "a.pdb", "/CB")
    go("info", folder / "a.pdb")
    out = capsys.readouterr().out
    assert out.count("CB") == 3 and "n_residues" in out
    go("pairs", folder / "a.pdb", folder / "pairs")
    assert spark.read.csv(str(folder / "pairs"), sep="\t").count() == 6
    (folder / "in.txt").write_text("BEGIN rgyr\n--TITLE g\n--SELE /CA\nEND\nBEGIN avg\nEND\n")
    go("analyse", folder / "in.txt", folder / "a.pdb", folder / "a.dcd", folder / "result")
    assert spark.read.parquet(str(folder / "result/frames")).columns == ["frame", "g"]
    (folder / "nodes.dat").write_text("1\n2\n1\n1\n2\n1\n")
    go("kinetics", folder / "nodes.dat", "1")
    assert "first_passage" in capsys.readouterr().out
    with pytest.raises(ValueError):
        files.kind("a.gro", files.TRAJECTORIES)
