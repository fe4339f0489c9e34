"""Structure and trajectory readers and writers for fixed-column text formats.

Readers return atom tables or frames; each is a projection of spark.read.text, so a file's lines
are cut into columns where they lie. Writers return a frame of ordered lines for the text sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed columns (from, to), from 0, end excluded.
PDB = {
    "serial": (6, 11), "atom_name": (12, 16), "alt_loc": (16, 17), "res_name": (17, 20), "chain_id": (21, 22), "res_seq": (22, 26), "icode": (26, 27),
    "x": (30, 38), "y": (38, 46), "z": (46, 54), "occupancy": (54, 60), "b_factor": (60, 66), "seg_id": (72, 76), "element": (76, 78), "charge": (78, 80),
}
CRYST1 = {"a": (6, 15), "b": (15, 24), "c": (24, 33), "ang1": (33, 40), "ang2": (40, 47), "ang3": (47, 54), "space_group": (55, 66), "z": (66, 70)}
CRD = {"serial": (0, 5), "res_seq": (5, 10), "res_name": (11, 15), "atom_name": (16, 20), "x": (20, 30), "y": (30, 40), "z": (40, 50), "seg_id": (51, 55), "res_id": (56, 60), "weight": (60, 70)}
CRD_EXT = {"serial": (0, 10), "res_seq": (10, 20), "res_name": (22, 30), "atom_name": (32, 40), "x": (40, 60), "y": (60, 80), "z": (80, 100), "seg_id": (102, 110), "res_id": (112, 120), "weight": (120, 140)}
_NUMBERS = {"x", "y", "z", "occupancy", "b_factor", "weight", "a", "b", "c", "ang1", "ang2", "ang3"}
_WHOLE = {"serial", "res_seq"}


def cut(line: Column, columns: dict[str, tuple[int, int]]) -> list[Column]:
    out = []
    for name, (a, b) in columns.items():
        text = F.trim(F.substring(line, a + 1, b - a))
        text = F.when(text != "", text)
        out.append((text.cast("double") if name in _NUMBERS else text.cast("int") if name in _WHOLE else F.coalesce(text, F.lit(""))).alias(name))
    return out


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line): a file's lines in order. One structure file is one partition, so numbering needs no shuffle."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def read_pdb(spark: SparkSession, path: str, mol_id: str = "") -> DataFrame:
    """The atoms of the first model, in order; alternative locations other than the first are left out."""
    rows = lines(spark, path).withColumn("kind", F.substring("line", 1, 6))
    ended = F.coalesce(F.sum(F.when(F.col("kind").startswith("ENDMDL"), 1)).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    atoms = rows.withColumn("model", ended).where((F.col("model") == 0) & F.col("kind").isin("ATOM  ", "HETATM"))
    atoms = atoms.select("n", (F.col("kind") == "HETATM").alias("hetatm"), *cut(F.col("line"), PDB))
    return _numbered(atoms.where(F.col("alt_loc").isin("", "A", "1")), mol_id)


def read_pdb_models(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a file with models: one row (frame, x, y, z) per model."""
    rows = lines(spark, path).withColumn("kind", F.substring("line", 1, 6))
    model = F.coalesce(F.sum(F.when(F.col("kind").startswith("ENDMDL"), 1)).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    atoms = rows.withColumn("frame", model).where(F.col("kind").isin("ATOM  ", "HETATM")).select("n", "frame", *cut(F.col("line"), PDB))
    ordered = F.sort_array(F.collect_list(F.struct("n", "x", "y", "z")))
    return atoms.groupBy("frame").agg(ordered.alias("p")).select("frame", "p.x", "p.y", "p.z")


def read_box(spark: SparkSession, path: str) -> DataFrame:
    """The crystal cell; angles are given as cosines."""
    row = lines(spark, path).where(F.col("line").startswith("CRYST1")).select(*cut(F.col("line"), CRYST1))
    return row.withColumns({f"ang{k}": F.cos(F.radians(f"ang{k}")) for k in (1, 2, 3)})


def read_crd(spark: SparkSession, path: str, mol_id: str = "") -> DataFrame:
    """Card coordinates, normal or extended, told apart by the header line."""
    rows = lines(spark, path).where(~F.col("line").startswith("*") & (F.trim("line") != ""))
    first = rows.orderBy("n").first()
    columns = CRD_EXT if first is not None and "EXT" in first["line"] else CRD
    start = first["n"] if first is not None else -1
    atoms = rows.where(F.col("n") > start).select("n", F.lit(False).alias("hetatm"), *cut(F.col("line"), columns))
    return _numbered(atoms.withColumns({"chain_id": F.lit(""), "icode": F.lit(""), "alt_loc": F.lit("")}), mol_id)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Frames of the plain text form: a line `XYZ n`, then n lines of three numbers."""
    rows = lines(spark, path).where(F.trim("line") != "")
    rows = rows.withColumn("frame", F.sum(F.when(F.col("line").startswith("XYZ"), 1).otherwise(0)).over(Window.orderBy("n")))
    points = rows.where(~F.col("line").startswith("XYZ")).select("n", "frame", F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double")).alias("v")).where(F.size("v") == 3)
    return points.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("n", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("v")[2].alias("z")))).alias("p")).select("frame", "p.x", "p.y", "p.z")


def _numbered(atoms: DataFrame, mol_id: str) -> DataFrame:
    """Ordinals, progressive residue numbers, and segments named after chains where they have no name."""
    order = Window.orderBy("n")
    segment = F.coalesce(F.when(F.col("seg_id") != "", F.col("seg_id")), F.when(F.col("chain_id") != "", F.col("chain_id")), F.lit("A"))
    rows = atoms.withColumns({"atom_id": F.row_number().over(order), "seg_id": segment, "mol_id": F.lit(mol_id)})
    key = F.struct("chain_id", "seg_id", "res_seq", "icode")
    moved = F.when(F.lag(key).over(order).eqNullSafe(key), 0).otherwise(1)
    return rows.withColumn("moved", moved).withColumn("pres_seq", F.sum("moved").over(order)).drop("moved", "n")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the entries of a list file, one a line, without comments (#) and blanks."""
    rows = lines(spark, path).select("n", F.trim(F.regexp_replace("line", "#.*$", "")).alias("value")).where("value <> ''")
    return rows.select((F.row_number().over(Window.orderBy("n")) - 1).alias("ord"), "value")


def read_frame_list(spark: SparkSession, path: str) -> DataFrame:
    return read_list(spark, path).select("ord", F.col("value").cast("long").alias("frame"))


def read_radii(spark: SparkSession, path: str) -> DataFrame:
    """(atom_name, res_name, radius) of a radius table; a missing residue stands for any (*)."""
    parts = F.split("value", r"\s+")
    return read_list(spark, path).select(parts[0].alias("atom_name"), F.when(F.size(parts) > 2, parts[1]).otherwise(F.lit("*")).alias("res_name"), F.element_at(parts, -1).cast("double").alias("radius"))


def read_series(spark: SparkSession, path: str, traj_id: str = "") -> DataFrame:
    """One node a line; 0 is a break."""
    return read_list(spark, path).select(F.lit(traj_id).alias("traj_id"), (F.col("ord") + 1).alias("t"), F.col("value").cast("int").alias("node"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", r"\s+")
    return read_list(spark, path).select(parts[0].cast("int").alias("src"), parts[1].cast("int").alias("dst"), parts[2].cast("double").alias("w"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Undirected edges; a third column is ignored."""
    parts = F.split("value", r"\s+")
    return read_list(spark, path).select(parts[0].cast("long").alias("a"), parts[1].cast("long").alias("b"))


# --- writers: frames of (n, line) -----------------------------------------------------------


def pdb_lines(atoms: DataFrame) -> DataFrame:
    name = F.when(F.length("atom_name") >= 4, F.rpad("atom_name", 4, " ")).otherwise(F.concat(F.lit(" "), F.rpad("atom_name", 3, " ")))
    line = F.format_string(
        "%s%5d %s%1s%-3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f      %-4s%2s",
        F.when(F.col("hetatm"), "HETATM").otherwise("ATOM  "), F.col("atom_id"), name, F.coalesce("alt_loc", F.lit("")), F.col("res_name"), F.col("chain_id"), F.col("res_seq"), F.coalesce("icode", F.lit("")),
        F.col("x"), F.col("y"), F.col("z"), F.coalesce("occupancy", F.lit(0.0)), F.coalesce("b_factor", F.lit(0.0)), F.col("seg_id"), F.coalesce("element", F.lit("")),
    )
    return atoms.select(F.col("atom_id").alias("n"), line.alias("line"))


def crd_lines(atoms: DataFrame) -> DataFrame:
    line = F.format_string("%5d%5d %-4s %-4s%10.5f%10.5f%10.5f %-4s %-4s%10.5f", "atom_id", "pres_seq", "res_name", "atom_name", "x", "y", "z", "seg_id", F.col("res_seq").cast("string"), F.coalesce("weight", F.lit(0.0)) if "weight" in atoms.columns else F.lit(0.0))
    count = atoms.agg(F.format_string("%5d", F.count(F.lit(1))).alias("line")).select(F.lit(0).alias("n"), "line")
    return count.unionByName(atoms.select(F.col("atom_id").alias("n"), line.alias("line")))


def write_lines(rows: DataFrame, path: str) -> None:
    """One ordered text file: a range sort first, so that the single writer only concatenates."""
    rows.orderBy("n").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def series_lines(rows: DataFrame) -> DataFrame:
    """A result by frame as text: a header of titles, then one line of fixed-width cells per frame."""
    titles = [c for c in rows.columns if c != "frame"]
    cells = [F.format_string("%10.3f", c) if rows.schema[c].dataType.simpleString() in ("double", "float") else F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), 10, " ") for c in titles]
    header = rows.sparkSession.createDataFrame([(-1, "#   nFr " + " ".join(f"{t:>10}" for t in titles))], "n long, line string")
    body = rows.select(F.col("frame").cast("long").alias("n"), F.concat(F.format_string("%7d ", F.col("frame").cast("int")), F.concat_ws(" ", *cells)).alias("line"))
    return header.unionByName(body)
