"""Command line: python -m orrery.cli COMMAND ...; see --help."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.selection import select
from .operators import kinetics, manipulate
from .plans import blocks, modules
from .schema import points, reference
from .sources import files, structures


def _show(rows: DataFrame) -> None:
    """All rows between bars; a few at a time reach the driver."""
    print("|" + "|".join(f"{c} " for c in rows.columns) + "|")
    for row in rows.toLocalIterator():
        print("|" + "|".join(f"{v} " for v in row) + "|")


def _frames(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = files.read_trajectory(spark, args.trajectory)
    if getattr(args, "frames", None):
        if args.frames == "all":
            return rows
        try:
            wanted = structures.read_frame_list(spark, args.frames) if "." in args.frames else None
        except ValueError:
            wanted = None
        from .functions.selection import range_list

        picked = manipulate.pick(rows, wanted if wanted is not None else range_list(args.frames))
        # frames are numbered anew, in the order of the list
        from pyspark.sql import Window

        return picked.withColumn("frame", F.row_number().over(Window.orderBy("ord")).cast("long")).drop("ord")
    return manipulate.sample(rows, args.begin, args.end, args.skip) if hasattr(args, "begin") else rows


def _chosen(spark: SparkSession, args: argparse.Namespace) -> list[int]:
    return sorted(r["atom_id"] for r in select(files.read_structure(spark, args.structure), args.select).select("atom_id").collect())


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="orrery")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *arguments: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        for a in arguments:
            p.add_argument(a)
        return p

    command("merge", "trajectories of a list, one after another", "list", "out")
    command("append", "frames of the second after the first", "first", "second", "out")
    command("add-structure", "a structure as one more frame", "trajectory", "structure", "out")
    command("sum", "reference plus all deviations on a selection", "list", "structure", "select", "out")
    command("combine", "atoms of trajectories side by side", "list", "out")
    command("mono", "a structure as a trajectory", "structure", "out")
    p = command("convert", "structure to structure, or trajectory to trajectory", "source", "out")
    p.add_argument("--select", default="/*/*/*/*")
    p = command("extract", "frames (list file, ranges or all), and atoms of a selection", "trajectory", "frames", "out")
    p.add_argument("--structure")
    p.add_argument("--select")
    p = command("average", "mean structure", "trajectory", "structure", "out")
    for name, default in (("begin", 1), ("end", None), ("skip", 1)):
        p.add_argument(f"--{name}", type=int, default=default)
    command("header", "about a trajectory", "trajectory")
    command("info", "about a structure", "structure")
    command("check-selection", "atoms of a selection", "structure", "select")
    command("pairs", "all ordered pairs of residues", "structure", "out")
    p = command("analyse", "blocks of an input file over a trajectory", "input", "structure", "trajectory", "out")
    p.add_argument("--box", type=float, nargs=3)
    command("data", "blocks of an input file over series, links, graphs and matrices", "input", "out")
    p = command("kinetics", "first passage and equilibrium of a node series file", "series", "target")
    p.add_argument("--within", type=int, default=5)
    return out


def run(spark: SparkSession, argv: list[str]) -> None:
    args = parser().parse_args(argv)
    c = args.command
    if c == "merge":
        files.write_trajectory(files.read_trajectory(spark, args.list), args.out)
    elif c == "append":
        files.write_trajectory(manipulate.merge([files.read_trajectory(spark, p) for p in (args.first, args.second)]), args.out)
    elif c == "add-structure":
        extra = reference(files.frame_of(files.read_structure(spark, args.structure)))
        files.write_trajectory(manipulate.append_structure(files.read_trajectory(spark, args.trajectory), extra), args.out)
    elif c in ("sum", "combine"):
        parts = [files.read_trajectory(spark, r["value"]) for r in structures.read_list(spark, args.list).orderBy("ord").collect()]
        if c == "combine":
            whole = parts[0]
            for part in parts[1:]:
                whole = manipulate.side_by_side(whole, part)
        else:
            whole = manipulate.add_up(parts, reference(files.frame_of(files.read_structure(spark, args.structure))), _chosen(spark, args))
        files.write_trajectory(whole, args.out)
    elif c == "mono":
        files.write_trajectory(files.frame_of(files.read_structure(spark, args.structure)), args.out)
    elif c == "convert":
        if args.out.lower().endswith(("pdb", "crd", "cor")):
            files.write_structure(select(files.read_structure(spark, args.source), args.select), args.out)
        else:
            files.write_trajectory(files.read_trajectory(spark, args.source), args.out)
    elif c == "extract":
        rows = _frames(spark, args)
        rows = manipulate.project(rows, _chosen(spark, args)) if args.select else rows
        files.write_trajectory(rows, args.out)
    elif c == "average":
        mean = manipulate.average(points(_frames(spark, args)))
        files.write_structure(files.read_structure(spark, args.structure).drop("x", "y", "z").join(mean, "atom_id"), args.out)
    elif c == "header":
        _show(manipulate.header(files.read_trajectory(spark, args.trajectory)))
    elif c == "info":
        _show(manipulate.structure_info(files.read_structure(spark, args.structure)))
    elif c == "check-selection":
        _show(select(files.read_structure(spark, args.structure), args.select).select("atom_id", "chain_id", "seg_id", "res_seq", "atom_name").orderBy("atom_id"))
    elif c == "pairs":
        residues = files.read_structure(spark, args.structure).select(F.concat_ws(":", "seg_id", F.concat("res_name", F.col("res_seq").cast("string"))).alias("residue")).distinct()
        manipulate.residue_pairs(residues).write.mode("overwrite").csv(args.out, sep="\t")
    elif c == "analyse":
        with open(args.input) as f:
            text = f.read()
        on = blocks.context(files.read_trajectory(spark, args.trajectory), files.read_structure(spark, args.structure), box=tuple(args.box) if args.box else None)
        for name, rows in blocks.run(text, on).items():
            rows.write.mode("overwrite").parquet(f"{args.out}/{name}")
    elif c == "data":
        with open(args.input) as f:
            text = f.read()
        for name, rows in modules.run_data(spark, text).items():
            rows.write.mode("overwrite").parquet(f"{args.out}/{name}")
    else:
        links = kinetics.Links(kinetics.transitions(structures.read_series(spark, args.series)))
        rows = zip(links.nodes.tolist(), kinetics.first_passage(links, int(args.target)).tolist(), kinetics.equilibrium(links).tolist())
        _show(spark.createDataFrame(list(rows), "node int, first_passage double, weight double"))


def main() -> None:
    import sys

    run(SparkSession.builder.appName("orrery").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
