"""Registered queries of the engine's own operators, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions.graph import connected, rings
from .functions.selection import select
from .operators import areas, clusters, crossings, dense, kinetics, manipulate, measures, neighbours, networks, shapes, springs
from .plans import blocks
from .schema import N_ATOMS, atoms, frames, points, reference, series, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ALL = list(range(1, N_ATOMS + 1))
MASSES = [float(k) for k in ALL]
BOX = (0.5, 0.6, 0.7)
PAIRS = [([1], [5]), ([2], [6]), ([3], [7]), ([4], [8]), ([1, 2, 3], [10, 11, 12])]

# Long form of the frames, in SQL.
POINTS = """fl as (
  select vec_id + 1 as frame, label as traj_id, k as atom_id, cast(embedding[3 * k - 2] as double) as x,
    cast(embedding[3 * k - 1] as double) as y, cast(embedding[3 * k] as double) as z
  from embeddings, (select unnest(range(1, 22)) as k) t
)"""
SERIES = """ranked as (
  select event_type, row_number() over (order by count(*) desc, event_type) as node from events group by event_type
), se as (
  select user_id as traj_id, cast(row_number() over (partition by user_id order by ts, event_id) as integer) as t, node, ts, value
  from events join ranked using (event_type)
)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r(column, digits: int = 4):
    return F.round(column, digits)


def d2(a: str, b: str) -> str:
    return f"(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"


def wide(*ks: int) -> str:
    """SQL of one row per frame with the named atoms' coordinates as xk, yk, zk."""
    picks = ", ".join(f"max(case when atom_id = {k} then {a} end) as {a}{k}" for k in ks for a in "xyz")
    return f"w as (select frame, {picks} from fl group by frame)"


def dist(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f"(x_{a} - x_{b}) * (x_{a} - x_{b})".replace("x_", f"{c}") for c in "xyz") + ")"


def angle_sql(i: int, j: int, k: int) -> str:
    ab, bc, ac = dist(i, j), dist(j, k), dist(i, k)
    c = f"(({ab} * {ab} + {bc} * {bc} - {ac} * {ac}) / (2 * {ab} * {bc}))"
    return f"case when abs({c}) < 1 then degrees(acos({c})) else 0.0 end"


# --- manipulation ---------------------------------------------------------------------------


@query(
    """select c_custkey as atom_id, r_name as chain_id, n_name as seg_id from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name in ('ASIA', 'EUROPE') and n_name like '%A%' and (c_custkey between 1 and 900 or c_custkey = 1000) and not (c_mktsegment like 'B%')"""
)
def select_glob(spark, sf_dir):
    return select(atoms(spark, sf_dir), "/@(ASIA|EUROPE)/*A*/@(1-900|1000)/!(B*)").select("atom_id", "chain_id", "seg_id")


@query(
    """with a as (select c_custkey as atom_id, r_name, n_name, c_mktsegment as t from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select r_name as chain_id, count(*) as n, min(atom_id) as first_atom, max(atom_id) as last_atom from a
where (((r_name = 'AFRICA' and t = 'BUILDING') or (n_name like '_R%')) and not atom_id between 100 and 200) or (n_name in ('JAPAN', 'CHINA') and t like 'MACH%') group by r_name"""
)
def select_add_del(spark, sf_dir):
    chosen = select(atoms(spark, sf_dir), "/AFRICA/*/*/BUILDING ; add /*/?R*/*/* ; del /*/*/100-200/* ; add /*/@(JAPAN|CHINA)/*/MACH*")
    return chosen.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.min("atom_id").alias("first_atom"), F.max("atom_id").alias("last_atom"))


@query("select a.n_name as residue, b.n_name as other from nation a join nation b on a.n_name <> b.n_name")
def residue_pairs(spark, sf_dir):
    return manipulate.residue_pairs(table(spark, sf_dir, "nation").select(F.col("n_name").alias("residue")))


@query(
    """with a as (select c_custkey, r_name, n_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select count(*) as n_atoms, count(distinct r_name) as n_chains, count(distinct (r_name, n_name)) as n_segments, count(distinct (r_name, n_name, c_custkey)) as n_residues from a"""
)
def structure_info(spark, sf_dir):
    return manipulate.structure_info(atoms(spark, sf_dir))


@query(f"with {POINTS} select count(distinct frame) as n_frames, min(frame) as first_frame, max(frame) as last_frame, cast(max(atom_id) as integer) as n_atoms from fl")
def header_print(spark, sf_dir):
    return manipulate.header(frames(spark, sf_dir))


@query("select vec_id + 1 as frame, round(cast(embedding[1] as double), 6) as x1 from embeddings where vec_id + 1 between 10 and 300 and (vec_id + 1 - 10) % 7 = 0")
def extract_range(spark, sf_dir):
    return manipulate.sample(frames(spark, sf_dir), 10, 300, 7).select("frame", r(F.col("x")[0], 6).alias("x1"))


@query(
    f"""with {POINTS}, l as (select * from (values (0, 5), (1, 3), (2, 99), (3, 5)) t(ord, frame))
select cast(ord as bigint) as ord, l.frame as frame, count(*) as n_atoms, round(sum(x), 4) as sx from l join fl on l.frame = fl.frame where atom_id in (2, 3, 5, 8, 13) group by ord, l.frame"""
)
def extract_list(spark, sf_dir):
    chosen = manipulate.project(manipulate.pick(frames(spark, sf_dir), [5, 3, 99, 5]), [2, 3, 5, 8, 13])
    sx = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return chosen.select("ord", F.col("frame").cast("int").alias("frame"), F.size("x").cast("long").alias("n_atoms"), r(sx).alias("sx"))


@query(f"with {POINTS} select atom_id, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from fl group by atom_id")
def average_structure(spark, sf_dir):
    return manipulate.average(points(frames(spark, sf_dir))).select(F.col("atom_id").cast("long").alias("atom_id"), *[r(F.col(a), 6).alias(a) for a in "xyz"])


@query(
    f"""with {POINTS}, m as (
  select frame, atom_id, x from fl union all
  select frame + (select max(frame) from fl), atom_id, x from fl where frame between 5 and 50 and (frame - 5) % 3 = 0 union all
  select (select 50 + max(frame) from fl) + 1, atom_id, x from fl where frame = 1
) select count(distinct frame) as n_frames, max(frame) as last_frame, round(sum(frame * x) / 1000, 3) as checksum from m"""
)
def merge_append(spark, sf_dir):
    whole = frames(spark, sf_dir)
    merged = manipulate.merge([whole, manipulate.sample(whole, 5, 50, 3)])
    out = manipulate.append_structure(merged, reference(whole)).withColumn("s", F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    return out.agg(F.countDistinct("frame").alias("n_frames"), F.max("frame").alias("last_frame"), r(F.sum(F.col("frame") * F.col("s")) / 1000, 3).alias("checksum"))


@query(
    f"""with {POINTS}, rf as (select atom_id, x, y, z from fl where frame = 1)
select a.frame, round(sum(case when a.atom_id in (1, 2, 3) then a.x + b.x - rf.x else rf.x end), 4) as sx
from fl a join fl b on a.frame = b.frame and a.atom_id = b.atom_id join rf on rf.atom_id = a.atom_id group by a.frame"""
)
def sum_trajectories(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return manipulate.add_up([whole, whole], reference(whole), [1, 2, 3]).select("frame", r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("sx"))


@query(f"with {POINTS} select frame, cast(2 * count(*) as integer) as n_atoms, round(2 * sum(y), 4) as sy from fl group by frame")
def combine_atoms(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return manipulate.side_by_side(whole, whole).select("frame", F.size("y").alias("n_atoms"), r(F.aggregate("y", F.lit(0.0), lambda a, v: a + v)).alias("sy"))


@query(f"with {POINTS} select frame, 'XYZ 21' || chr(10) || string_agg(printf('%8.3f%8.3f%8.3f', x, y, z), chr(10) order by atom_id) as text from fl group by frame")
def xyz_text(spark, sf_dir):
    return manipulate.xyz_text(frames(spark, sf_dir))


# --- per-frame measures ---------------------------------------------------------------------


@query(
    f"""with {POINTS}, {wide(1, 2, 3, 4, 5, 6, 7, 8)}, c as (
  select frame, avg(x) filter (atom_id <= 3) as ax, avg(y) filter (atom_id <= 3) as ay, avg(z) filter (atom_id <= 3) as az,
    avg(x) filter (atom_id between 10 and 12) as bx, avg(y) filter (atom_id between 10 and 12) as by_, avg(z) filter (atom_id between 10 and 12) as bz,
    sum(atom_id * x) filter (atom_id <= 3) / 6 as mx, sum(atom_id * y) filter (atom_id <= 3) / 6 as my, sum(atom_id * z) filter (atom_id <= 3) / 6 as mz,
    sum(atom_id * x) filter (atom_id between 10 and 12) / 33 as nx, sum(atom_id * y) filter (atom_id between 10 and 12) / 33 as ny, sum(atom_id * z) filter (atom_id between 10 and 12) / 33 as nz
  from fl group by frame)
select w.frame, round({dist(1, 5)}, 4) as dist1, round(sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2), 4) as dist2,
  round(sqrt((mx - nx) ** 2 + (my - ny) ** 2 + (mz - nz) ** 2), 4) as dist3,
  (case when {dist(1, 5)} < 0.2 then 1 else 0 end + case when {dist(2, 6)} < 0.2 then 1 else 0 end + case when {dist(3, 7)} < 0.2 then 1 else 0 end
   + case when {dist(4, 8)} < 0.2 then 1 else 0 end + case when sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2) < 0.2 then 1 else 0 end) as contacts
from w join c on w.frame = c.frame"""
)
def distances_and_contacts(spark, sf_dir):
    return frames(spark, sf_dir).select(
        "frame",
        r(measures.pair_distance(PAIRS[0])).alias("dist1"),
        r(measures.pair_distance(PAIRS[4])).alias("dist2"),
        r(measures.pair_distance(PAIRS[4], MASSES)).alias("dist3"),
        measures.contacts(PAIRS, 0.2).alias("contacts"),
    )


@query(
    f"""with {POINTS}, {wide(1, 2, 3, 4)}, v as (select frame, {', '.join(f'{a}{k + 1} - {a}{k} as {a}_{k}' for k in (1, 2, 3) for a in 'xyz')}, * exclude (frame) from w),
p as (select *, y_1 * z_2 - z_1 * y_2 as px, z_1 * x_2 - x_1 * z_2 as py, x_1 * y_2 - y_1 * x_2 as pz, y_2 * z_3 - z_2 * y_3 as qx, z_2 * x_3 - x_2 * z_3 as qy, x_2 * y_3 - y_2 * x_3 as qz from v)
select frame, round({angle_sql(1, 2, 3)}, 4) as angle1,
  round(case when x_1 * qx + y_1 * qy + z_1 * qz <= 1e-9 then -1.0 else 1.0 end * degrees(acos((px * qx + py * qy + pz * qz) / (sqrt(px * px + py * py + pz * pz) * sqrt(qx * qx + qy * qy + qz * qz)))), 4) as dihe1
from p"""
)
def angle_and_dihedral(spark, sf_dir):
    return frames(spark, sf_dir).select("frame", r(measures.bond_angle(1, 2, 3)).alias("angle1"), r(measures.torsion(1, 2, 3, 4)).alias("dihe1"))


@query(
    f"""with {POINTS}, m as (select frame, sum(atom_id * x) / 231 as mx, sum(atom_id * y) / 231 as my, sum(atom_id * z) / 231 as mz from fl group by frame)
select fl.frame, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 5) as rgyr,
  round(sqrt(sum(atom_id * ((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) / 231), 5) as rgyr_mass from fl join m on fl.frame = m.frame group by fl.frame"""
)
def radius_of_gyration(spark, sf_dir):
    return frames(spark, sf_dir).select("frame", r(measures.gyration(ALL), 5).alias("rgyr"), r(measures.gyration(ALL, MASSES), 5).alias("rgyr_mass"))


@query(
    f"""with {POINTS}, {wide(*range(1, 10))} select frame, {' + '.join(f"case when {dist(a, a + 2)} < 0.25 and {angle_sql(a, a + 1, a + 2)} > 60 then 1 else 0 end" for a in (1, 4, 7))} as hb1 from w"""
)
def hydrogen_bonds(spark, sf_dir):
    return frames(spark, sf_dir).select("frame", measures.hydrogen_bonds([(1, 2, 3), (4, 5, 6), (7, 8, 9)], 0.25, 60.0).alias("hb1"))


@query(
    f"""with {POINTS}, u as (select a.frame, b.x - a.x as x, b.y - a.y as y, b.z - a.z as z, sqrt({d2('a', 'b')}) as n from fl a join fl b on a.frame = b.frame and b.atom_id = a.atom_id + 1 where a.atom_id in (1, 3, 5, 7, 9, 11)),
v as (select frame, x / n as x, y / n as y, z / n as z from u),
m as (select frame, avg((3 * x * x - 1) / 2) as xx, avg((3 * y * y - 1) / 2) as yy, avg((3 * z * z - 1) / 2) as zz, avg(3 * x * y / 2) as xy, avg(3 * x * z / 2) as xz, avg(3 * y * z / 2) as yz from v group by frame),
q as (select *, (xx + yy + zz) / 3 as q from m),
p as (select *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) as p from q),
h as (select *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) as h from p)
select frame, round(q + 2 * p * cos(acos(greatest(-1.0, least(1.0, h))) / 3), 4) as p2 from h"""
)
def orientational_order(spark, sf_dir):
    return frames(spark, sf_dir).select("frame", r(measures.order_parameter([(k, k + 1) for k in (1, 3, 5, 7, 9, 11)])).alias("p2"))


@query(
    f"""with {POINTS}, n as (select a.frame, a.atom_id, max(case when sqrt({d2('a', 'b')}) <= 0.25 then 1 else 0 end) as near from fl a join fl b on a.frame = b.frame and b.atom_id in (1, 4) group by a.frame, a.atom_id),
g as (select frame, (atom_id - 1) // 3 as res, max(near) as near, sum(near) as atoms from n group by 1, 2)
select frame, cast(sum(atoms) as integer) as atoms, cast(sum(near) as integer) as residues from g group by frame"""
)
def within_selection(spark, sf_dir):
    return frames(spark, sf_dir).select("frame", measures.around([1, 4], 0.25, N_ATOMS).alias("atoms"), measures.around([1, 4], 0.25, N_ATOMS, 3).alias("residues"))


@query(
    f"""with {POINTS}, c as (select frame, avg(x) as x1, sum(atom_id * y) / 231 as y2,
  (atan2(-sum(sin(x * 2 * pi() / 0.5)), -sum(cos(x * 2 * pi() / 0.5))) + pi()) * 0.5 / (2 * pi()) as x3,
  (atan2(-sum(atom_id * sin(z * 2 * pi() / 0.7)), -sum(atom_id * cos(z * 2 * pi() / 0.7))) + pi()) * 0.7 / (2 * pi()) as z4 from fl group by frame)
select frame, round(x1, 5) as x1, round(y2, 5) as y2, round(x3, 5) as x3, round(z4, 5) as z4 from c"""
)
def centres_of_mass(spark, sf_dir):
    plain, heavy, periodic, both = measures.com(ALL), measures.com(ALL, MASSES), measures.com(ALL, None, BOX), measures.com(ALL, MASSES, BOX)
    return frames(spark, sf_dir).select("frame", r(plain[0], 5).alias("x1"), r(heavy[1], 5).alias("y2"), r(periodic[0], 5).alias("x3"), r(both[2], 5).alias("z4"))


@query(
    f"""with {POINTS}, {wide(1, 5)} select frame, round(sqrt({' + '.join(f"(({a}1 - {a}5) - {s} * round_even(({a}1 - {a}5) / {s}, 0)) ** 2" for a, s in zip('xyz', (0.2, 0.24, 0.28)))}), 5) as d,
  round(x5 + ((x1 - x5) - 0.2 * round_even((x1 - x5) / 0.2, 0)), 5) as image_x from w"""
)
def periodic_distance(spark, sf_dir):
    box = (0.2, 0.24, 0.28)
    return frames(spark, sf_dir).select("frame", r(measures.pair_distance(([1], [5]), None, box), 5).alias("d"), r(G.nearest_image(G.atom(1), G.atom(5), box)[0], 5).alias("image_x"))


@query(f"with {POINTS}, rf as (select * from fl where frame = 1) select fl.frame, round(sqrt(sum({d2('fl', 'rf')}) / 21), 5) as rmsd from fl join rf using (atom_id) group by fl.frame")
def rmsd_in_place(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return whole.select("frame", r(measures.rmsd_in_place(ALL, reference(whole)), 5).alias("rmsd"))


@query(
    f"""with {POINTS}, n as (select *, dense_rank() over (partition by traj_id order by frame) as f from fl)
select b.traj_id, cast(b.f as bigint) as frame, round(sqrt(sum({d2('a', 'b')}) / 21), 5) as rmsd from n a join n b on b.traj_id = a.traj_id and b.f = a.f + 1 and a.atom_id = b.atom_id group by b.traj_id, b.f"""
)
def rmsd_progressive(spark, sf_dir):
    """Frames numbered from 1 in each of several trajectories."""
    whole = frames(spark, sf_dir)
    own = whole.withColumn("frame", F.row_number().over(Window.partitionBy("traj_id").orderBy("frame")).cast("long"))
    return manipulate.progressive_rmsd(own).select("traj_id", "frame", r(F.col("rmsd"), 5).alias("rmsd"))


@query(
    f"""with {POINTS}, p as (select a.frame, a.atom_id as i, b.atom_id as j, sqrt({d2('a', 'b')}) as d from fl a join fl b on a.frame = b.frame and a.atom_id > b.atom_id),
q as (select p.frame, p.d, o.d as e from p join p o on o.frame = 1 and o.i = p.i and o.j = p.j)
select frame, round(sqrt(avg((d - e) ** 2)), 5) as drms, round(sqrt(avg((0.000064 / (0.000064 + d ** 6) - 0.000064 / (0.000064 + e ** 6)) ** 2)), 4) as cmapd from q group by frame"""
)
def drms(spark, sf_dir):
    whole = frames(spark, sf_dir)
    ref = reference(whole)
    found = dense.drms(whole, ref, ALL, (None, 0.2))
    return found.select("frame", r(F.col("d0"), 5).alias("drms"), r(F.col("d1"), 4).alias("cmapd"))


def _superposed_sql() -> str:
    """Least deviation by the singular values of the 3 by 3 product of centred frames, their squares in closed form."""
    m = {(i, j): f"sum(a{i} * b{j})" for i in "xyz" for j in "xyz"}
    products = ", ".join(f"{v} as m{i}{j}" for (i, j), v in m.items())
    squares = ", ".join(f"{' + '.join(f'm{k}{i} * m{k}{j}' for k in 'xyz')} as s{i}{j}" for i, j in ("xx", "yy", "zz", "xy", "xz", "yz"))
    return f"""with {POINTS}, c as (select frame, atom_id, x - avg(x) over w as x, y - avg(y) over w as y, z - avg(z) over w as z from fl window w as (partition by frame)),
j as (select c.frame, c.x as ax, c.y as ay, c.z as az, o.x as bx, o.y as by_, o.z as bz from c join c o on o.frame = 1 and o.atom_id = c.atom_id),
m as (select frame, sum(ax * ax + ay * ay + az * az + bx * bx + by_ * by_ + bz * bz) as e, {products.replace('by)', 'by_)')} from j group by frame),
s as (select *, {squares}, mxx * (myy * mzz - myz * mzy) - mxy * (myx * mzz - myz * mzx) + mxz * (myx * mzy - myy * mzx) as det from m),
q as (select *, (sxx + syy + szz) / 3 as q from s), p as (select *, sqrt(((sxx - q) ** 2 + (syy - q) ** 2 + (szz - q) ** 2 + 2 * (sxy ** 2 + sxz ** 2 + syz ** 2)) / 6) as p from q),
h as (select *, acos(greatest(-1.0, least(1.0, ((sxx - q) * ((syy - q) * (szz - q) - syz ** 2) - sxy * (sxy * (szz - q) - syz * sxz) + sxz * (sxy * syz - (syy - q) * sxz)) / (2 * p * p * p)))) / 3 as h from p),
e as (select *, q + 2 * p * cos(h) as e1, q + 2 * p * cos(h + 2 * pi() / 3) as e3 from h)
select frame, round(sqrt(greatest(0.0, e - 2 * (sqrt(e1) + sqrt(greatest(0.0, 3 * q - e1 - e3)) + sign(det) * sqrt(greatest(0.0, e3)))) / 21), 4) as rmsd from e"""


@query(_superposed_sql())
def rmsd_superposed(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return dense.rmsd(whole, reference(whole)).select("frame", r(F.col("rmsd")).alias("rmsd"))


# --- whole-trajectory aggregates ------------------------------------------------------------


@query(f"with {POINTS}, rf as (select * from fl where frame = 1) select atom_id, round(sqrt(avg({d2('fl', 'rf')})), 5) as rmsf from fl join rf using (atom_id) group by atom_id")
def rmsf(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return manipulate.fluctuation(points(whole), reference(whole)).select(F.col("atom_id").cast("long").alias("atom_id"), r(F.col("rmsf"), 5).alias("rmsf"))


def _pairs(spark, *columns: np.ndarray) -> DataFrame:
    """Lower triangle (i > j, from 1) with one column for each array."""
    i, j = np.tril_indices(N_ATOMS, -1)
    rows = [(int(a) + 1, int(b) + 1, *[float(c[k]) for c in columns]) for k, (a, b) in enumerate(zip(i, j))]
    return spark.createDataFrame(rows, "i long, j long, " + ", ".join(f"v{k} double" for k in range(len(columns))))


@query(
    f"with {POINTS}, p as (select a.atom_id as i, b.atom_id as j, sqrt({d2('a', 'b')}) as d from fl a join fl b on a.frame = b.frame and a.atom_id > b.atom_id) select i, j, round(avg(d), 5) as mean, round(var_pop(d), 5) as msdf from p group by i, j"
)
def distance_fluctuation(spark, sf_dir):
    mean, var, _ = dense.pair_moments(frames(spark, sf_dir), ALL)
    return _pairs(spark, mean, var).select("i", "j", r(F.col("v0"), 5).alias("mean"), r(F.col("v1"), 5).alias("msdf"))


@query(
    f"""with {POINTS}, rf as (select * from fl where frame = 1), c as (
  select fl.frame, 3 * (fl.atom_id - 1) + a as k, case a when 0 then fl.x - rf.x when 1 then fl.y - rf.y else fl.z - rf.z end as d from fl join rf using (atom_id), (select unnest(range(0, 3)) as a) t)
select p.k as i, q.k as j, round(avg(p.d * q.d), 6) as covariance from c p join c q on p.frame = q.frame and p.k >= q.k group by p.k, q.k"""
)
def pca_covariance(spark, sf_dir):
    whole = frames(spark, sf_dir)
    cov, _ = dense.covariance(whole, reference(whole))
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i + 1)]
    return spark.createDataFrame(rows, "i long, j long, c double").select("i", "j", r(F.col("c"), 6).alias("covariance"))


@query(
    f"""with {POINTS}, rf as (select * from fl where frame = 1), t as (select sum({d2('fl', 'rf')}) / count(distinct fl.frame) as trace from fl join rf using (atom_id))
select 63 as modes, round(trace, 4) as total_variance, true as orthonormal from t"""
)
def pca_modes(spark, sf_dir):
    whole = frames(spark, sf_dir)
    values, vectors, _ = dense.modes(dense.covariance(whole, reference(whole))[0])
    good = bool(np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-8 and (np.diff(values) <= 1e-12).all())
    return spark.createDataFrame([(len(values), float(values.sum()), good)], "modes int, v double, orthonormal boolean").select("modes", r(F.col("v")).alias("total_variance"), "orthonormal")


@query(
    f"""with {POINTS}, rf as (select * from fl where frame = 1) select fl.frame, round(sum((fl.x - rf.x) + (fl.y - rf.y) * 2 + (fl.z - rf.z) * 3) / sqrt(21 * 14), 5) as projection
from fl join rf using (atom_id) group by fl.frame"""
)
def project_mode(spark, sf_dir):
    whole = frames(spark, sf_dir)
    ref = reference(whole)
    size = (21 * 14) ** 0.5
    parts = [F.aggregate(F.zip_with(F.col(a), F.lit([float(v) for v in ref[a]]), lambda p, q: p - q), F.lit(0.0), lambda s, v: s + v) * (w / size) for a, w in zip("xyz", (1.0, 2.0, 3.0))]
    return whole.select("frame", r(parts[0] + parts[1] + parts[2], 5).alias("projection"))


@query(
    f"""with {POINTS}, rf as (select * from fl where frame = 1), d as (select frame, atom_id, fl.x - rf.x as x, fl.y - rf.y as y, fl.z - rf.z as z from fl join rf using (atom_id)) select a.atom_id as i, b.atom_id as j,
round(sum(a.x * b.x + a.y * b.y + a.z * b.z) / sqrt(sum(a.x * a.x + a.y * a.y + a.z * a.z) * sum(b.x * b.x + b.y * b.y + b.z * b.z)), 5) as corr from d a join d b on a.frame = b.frame and a.atom_id > b.atom_id group by a.atom_id, b.atom_id""".replace("select frame, atom_id, fl.x", "select fl.frame, atom_id, fl.x")
)
def cross_correlation(spark, sf_dir):
    whole = frames(spark, sf_dir)
    c = dense.cross_correlation(whole, reference(whole))
    return _pairs(spark, c[np.tril_indices(N_ATOMS, -1)]).select("i", "j", r(F.col("v0"), 5).alias("corr"))


@query()
def mutual_information(spark, sf_dir):
    whole = frames(spark, sf_dir)
    c = dense.mutual_information(whole, reference(whole))
    return _pairs(spark, c[np.tril_indices(N_ATOMS, -1)]).select("i", "j", r(F.col("v0"), 5).alias("corr"))


@query(
    f"""with {POINTS}, p as (select a.traj_id, a.atom_id as i, b.atom_id as j, sqrt({d2('a', 'b')}) as d from fl a join fl b on a.frame = b.frame and a.atom_id > b.atom_id)
select traj_id, i, j, round(avg(d), 5) as mean, round(var_pop(d), 5) as var from p group by traj_id, i, j"""
)
def group_fluctuation(spark, sf_dir):
    found = dense.group_fluctuation(frames(spark, sf_dir), "traj_id", ALL)
    return found.select("traj_id", "i", "j", r(F.col("mean"), 5).alias("mean"), r(F.col("var"), 5).alias("var"))


@query(
    f"""with {POINTS}, f as (select frame, atom_id, x, y, z from fl), d as (select a.atom_id, a.frame as s, b.frame as t, sqrt({d2('a', 'b')}) as d from f a join f b on a.atom_id = b.atom_id),
m as (select atom_id, s, avg(d) as m from d group by atom_id, s), g as (select atom_id, avg(d) as g from d group by atom_id),
c as (select d.atom_id, d.s, d.t, d.d - u.m - v.m + g.g as c from d join m u on u.atom_id = d.atom_id and u.s = d.s join m v on v.atom_id = d.atom_id and v.s = d.t join g on g.atom_id = d.atom_id),
v as (select a.atom_id as i, b.atom_id as j, avg(a.c * b.c) as v from c a join c b on a.s = b.s and a.t = b.t group by 1, 2)
select p.i, p.j, round(sqrt(greatest(p.v, 0) / sqrt(q.v * r.v)), 4) as dcor from v p join v q on q.i = p.i and q.j = p.i join v r on r.i = p.j and r.j = p.j where p.i > p.j"""
)
def distance_correlation(spark, sf_dir):
    found = dense.distance_correlations(frames(spark, sf_dir), [(a, b) for a in ALL for b in range(1, a)])
    return found.select("i", "j", r(F.col("dcor")).alias("dcor"))


@query()
def entropy(spark, sf_dir):
    whole = frames(spark, sf_dir)
    cov, n = dense.covariance(whole, reference(whole), superpose=True, weights=np.array(MASSES))
    found = dense.entropy(cov * 100)
    return spark.createDataFrame([(n, *[found[k] for k in ("entropy", "energy", "heat_capacity")])], "n_frames long, entropy double, energy double, heat_capacity double")


@query(
    """select round(min(o_totalprice), 4) as min_x, round(max(o_totalprice), 4) as max_x, round(avg(o_totalprice), 4) as mean_x, round(stddev_pop(o_totalprice), 4) as sd_x, round(corr(o_totalprice, (o_custkey + 1)) ** 2, 8) as linear,
round(corr(ln(o_totalprice), (o_custkey + 1)) ** 2, 8) as logarithmic, round(corr(o_totalprice, ln((o_custkey + 1))) ** 2, 8) as exponential, round(corr(ln(o_totalprice), ln((o_custkey + 1))) ** 2, 8) as power from orders"""
)
def area_correlation(spark, sf_dir):
    found = areas.correlation(table(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_custkey") + 1).cast("double").alias("c")), "o_totalprice", "c")
    return found.select(*[r(F.col(c)).alias(c) for c in ("min_x", "max_x", "mean_x", "sd_x")], *[r(F.col(c), 8).alias(c) for c in ("linear", "logarithmic", "exponential", "power")])


@query(
    """with s as (select min(value) as low, greatest(floor((max(value) - min(value)) / 25 + 0.5), 1) as bins from events), b as (select case when floor((value - low) / 25) < bins then cast(floor((value - low) / 25) as bigint) end as bin, value from events, s)
select coalesce(bin, -1) as bin, count(*) as n, round(avg(value), 4) as mean from b group by 1"""
)
def area_clusters(spark, sf_dir):
    return areas.bin_sizes(table(spark, sf_dir, "events"), "value", 25.0).select(F.coalesce("bin", F.lit(-1)).alias("bin"), "n", r(F.col("mean")).alias("mean"))


# --- state ----------------------------------------------------------------------------------

FLUX = f"""with {SERIES}, d as (select traj_id, t, case when value >= 460 or value <= -380 then 3 when value >= 60 then 1 when value <= 20 then 0 end as s from se),
h as (select traj_id, t, coalesce(last_value(s ignore nulls) over (partition by traj_id order by t rows unbounded preceding), 3) as s from d),
c as (select traj_id, t, s, coalesce(lag(s) over (partition by traj_id order by t), 3) as b from h)
select traj_id as user_id, cast(sum(case when s <> 3 and b <> 3 and s <> b then 1 else 0 end) as bigint) as n from c group by traj_id"""


@query(FLUX)
def slab_crossings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return crossings.crossings(rows, "user_id", "at", "value", 20.0, 60.0, 400.0)


# --- kinetics -------------------------------------------------------------------------------


@query(f"with {SERIES}, n as (select node, lead(node) over (partition by traj_id order by t) as dst from se) select cast(node as integer) as src, cast(dst as integer) as dst, count(*) as w from n where dst is not null group by node, dst")
def transitions(spark, sf_dir):
    return kinetics.transitions(series(spark, sf_dir))


@query(
    f"""with {SERIES}, g as (select t - max(case when node = 1 then t end) over (partition by traj_id order by t rows between unbounded preceding and 1 preceding) as gap from se),
b as (select cast(floor(log10(gap) * 5) as bigint) as bin, count(*) as n from g where gap is not null group by 1)
select bin, round(10 ** (bin / 5.0), 4) as time, n, round(-ln(n / (select sum(n) from b)), 5) as minus_log_share from b"""
)
def return_times(spark, sf_dir):
    return kinetics.return_times(series(spark, sf_dir), 1, 5).select("bin", r(F.col("time")).alias("time"), "n", r(F.col("minus_log_share"), 5).alias("minus_log_share"))


@query(
    f"""with {SERIES}, a as (select node, min(case when node = 1 then t end) over (partition by traj_id order by t rows between 1 following and unbounded following) - t as delay from se)
select cast(node as integer) as node, count(*) as visits, cast(sum(case when delay + 1 <= 5 then 1 else 0 end) as bigint) as hits, round(sum(case when delay + 1 <= 5 then 1 else 0 end) / count(*), 6) as p from a group by node"""
)
def commitment(spark, sf_dir):
    return kinetics.commitment(series(spark, sf_dir), 1, 5).select("node", "visits", "hits", r(F.col("p"), 6).alias("p"))


def _basins_sql(nodes: int, within: int) -> str:
    ahead = ", ".join(f"min(case when node = {k} then t end) over (partition by traj_id order by t rows between 1 following and unbounded following) - t + 1 as d{k}" for k in range(1, nodes + 1))
    each = " union all ".join(f"select node as a, {k} as b, count(*) as visits, sum(case when d{k} <= {within} then 1 else 0 end) as hits from nx group by node" for k in range(1, nodes + 1))
    return f"""with recursive {SERIES}, nx as (select node, {ahead} from se), h as ({each}), e as (select a, b from h where a <> b and visits >= 100 and hits / visits >= 0.5),
u as (select a, b from e union select b, a from e), g as (select node as a, node as c from (select distinct node from se) union select u.b, g.c from g join u on u.a = g.a)
select cast(a as integer) as node, cast(min(c) as integer) as basin from g group by a"""


@query(_basins_sql(5, 4))
def kinetic_basins(spark, sf_dir):
    return kinetics.basins(series(spark, sf_dir), 5, 4)


LINKS = f"""{SERIES}, n as (select node, lead(node) over (partition by traj_id order by t) as dst from se),
l as (select node as src, dst, count(*) as w from n where dst is not null group by node, dst), pr as (select src, dst, w / sum(w) over (partition by src) as p from l)"""


def _solved(spark, nodes, **columns) -> DataFrame:
    rows = [(int(n), *[float(c[k]) for c in columns.values()]) for k, n in enumerate(nodes)]
    return spark.createDataFrame(rows, "node int, " + ", ".join(f"{c} double" for c in columns))


def _unrolled(step: str, start: str, rounds: int) -> str:
    """SQL of a fixed number of substitutions over the five nodes, one table expression each."""
    out = [f"i0 as ({start})"]
    for k in range(1, rounds + 1):
        out.append(f"i{k} as materialized ({step.format(prev=f'i{k - 1}')})")
    return ", ".join(out)


@query(
    f"""with {LINKS}, {_unrolled("select src as node, case when src = 1 then 0.0 else 1 + sum(p * v) end as v from pr join {prev} on dst = node group by src", "select distinct src as node, 0.0::double as v from pr", 120)}
select cast(node as integer) as node, round(v, 4) as mfpt from i120"""
)
def first_passage(spark, sf_dir):
    links = kinetics.Links(kinetics.transitions(series(spark, sf_dir)))
    return _solved(spark, links.nodes, mfpt=kinetics.first_passage(links, 1)).select("node", r(F.col("mfpt")).alias("mfpt"))


@query(
    f"""with {LINKS}, {_unrolled("select src as node, case when src = 1 then 1.0 when src = 2 then 0.0 else sum(p * v) end as v from pr join {prev} on dst = node group by src", "select distinct src as node, case when src = 1 then 1.0 else 0.0 end::double as v from pr", 60)}
select cast(node as integer) as node, round(v, 5) as committor from i60"""
)
def committor(spark, sf_dir):
    links = kinetics.Links(kinetics.transitions(series(spark, sf_dir)))
    return _solved(spark, links.nodes, committor=kinetics.committor(links, 1, 2)).select("node", r(F.col("committor"), 5).alias("committor"))


@query(
    f"""with {LINKS}, {_unrolled("select dst as node, sum(p * v) as v from pr join {prev} on src = node group by dst", "select src as node, sum(w) / (select sum(w) from l) as v from l group by src", 60)}
select cast(node as integer) as node, round(v, 6) as weight from i60"""
)
def equilibrium(spark, sf_dir):
    links = kinetics.Links(kinetics.transitions(series(spark, sf_dir)))
    return _solved(spark, links.nodes, weight=kinetics.equilibrium(links)).select("node", r(F.col("weight"), 6).alias("weight"))


@query()
def free_energy_profile(spark, sf_dir):
    links = kinetics.Links(kinetics.transitions(series(spark, sf_dir)))
    rows = kinetics.profile(links, kinetics.first_passage(links, 1), links.out)
    return spark.createDataFrame([(n, round(v, 6), round(z, 6), round(e, 6)) for n, v, z, e in rows], "node int, mfpt double, za double, energy double")


@query(
    """with recursive e as (select n_nationkey::bigint as a, n_nationkey::bigint * 2 % 25 as b from nation union select n_nationkey, n_nationkey::bigint * 5 % 25 from nation), n as (select a from e union select b from e),
g as (select a, a as b from n union select g.a, e.b from g join e on e.a = g.b)
select cast(x.a as integer) as node, cast(min(x.b) as integer) as component from g x join g y on x.a = y.b and x.b = y.a group by x.a"""
)
def strong_components(spark, sf_dir):
    """Doubling modulo 25 has three cycles, of which multiples of five are reached from the others but don't lead back."""
    key = F.col("n_nationkey").cast("int")
    links = table(spark, sf_dir, "nation").select(key.alias("src"), F.explode(F.array(key * 2 % 25, key * 5 % 25)).alias("dst"), F.lit(1.0).alias("w")).distinct()
    found = kinetics.strong(kinetics.Links(links))
    return spark.createDataFrame([(int(k), int(v)) for k, v in found.items()], "node int, component int")


# --- networks -------------------------------------------------------------------------------


def _nation_edges(spark, sf_dir) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    nation = table(spark, sf_dir, "nation")
    return nation.select(key.alias("a"), ((key + 1) % 25).alias("b")).union(nation.select(key, (key + 7) % 25))


@query(
    """with recursive e as (select n_nationkey::bigint as a, (n_nationkey::bigint + 1) % 25 as b from nation union select n_nationkey, (n_nationkey::bigint + 7) % 25 from nation), u as (select a, b from e union select b, a from e),
p as (select [a, b] as p from u where a < b union all select list_append(p, b) from p join u on u.a = p[-1] where b > p[1] and not list_contains(p, b) and len(p) < 6)
select array_to_string(p, '-') as ring, cast(len(p) as integer) as size from p join u on u.a = p[-1] and u.b = p[1] where len(p) >= 3 and p[2] < p[-1]"""
)
def ring_perception(spark, sf_dir):
    return rings(_nation_edges(spark, sf_dir), 6).select(F.array_join("ring", "-").alias("ring"), "size")


@query(
    f"""with {POINTS}, n as (select a.frame, a.atom_id as i, b.atom_id as j, sqrt({d2('a', 'b')}) as d from fl a join fl b on a.frame = b.frame and a.atom_id < b.atom_id)
select frame, count(*) as pairs, round(sum(d), 4) as total from n where d <= 0.15 group by frame"""
)
def near_pairs(spark, sf_dir):
    met = neighbours.near_pairs(points(frames(spark, sf_dir)), 0.15, ["frame"])
    return met.groupBy("frame").agg(F.count(F.lit(1)).alias("pairs"), r(F.sum("d")).alias("total"))


@query(
    f"""with recursive {POINTS}, e as (select distinct a.frame, a.atom_id as a, b.atom_id as b from fl a join fl b on a.frame = b.frame and a.atom_id <> b.atom_id where sqrt({d2('a', 'b')}) <= 0.15),
g as (select frame, a, a as c from e union select e.frame, e.b, g.c from g join e on e.frame = g.frame and e.a = g.a where g.c < e.b)
select frame, a as atom_id, min(c) as component from g group by frame, a"""
)
def contact_components(spark, sf_dir):
    met = neighbours.near_pairs(points(frames(spark, sf_dir)), 0.15, ["frame"])
    return connected(met.select("frame", F.col("i").alias("a"), F.col("j").alias("b")), ["frame"]).select("frame", F.col("node").cast("long").alias("atom_id"), F.col("component").cast("long").alias("component"))


# --- clustering -----------------------------------------------------------------------------

NEAR = f"""p as (select a.frame as i, b.frame as j, sqrt(sum({d2('a', 'b')}) / 21) as d from fl a join fl b on a.atom_id = b.atom_id and a.frame < b.frame group by a.frame, b.frame)"""


@query(f"with {POINTS}, {NEAR} select i, j, round(d, 5) as d from p where d < 0.26")
def near_frames(spark, sf_dir):
    return clusters.near_frames(frames(spark, sf_dir), 0.26, "in_place").select("i", "j", r(F.col("d"), 5).alias("d"))


@query(
    f"""with {POINTS}, s as (select a.frame as i, b.frame as j, sum(a.x * b.x) as ab, sum(a.x * a.x) as aa, sum(b.x * b.x) as bb from fl a join fl b on a.atom_id = b.atom_id and a.frame < b.frame group by a.frame, b.frame)
select i, j, round(1 - ab / (aa + bb - ab), 5) as d from s where 1 - ab / (aa + bb - ab) < 0.6"""
)
def near_frames_tanimoto(spark, sf_dir):
    return clusters.near_frames(frames(spark, sf_dir), 0.6, "tanimoto").select("i", "j", r(F.col("d"), 5).alias("d"))


@query()
def quality_threshold(spark, sf_dir):
    return clusters.quality_frames(frames(spark, sf_dir), 0.26, "in_place")


@query()
def leader(spark, sf_dir):
    return clusters.leader(clusters.sampled(frames(spark, sf_dir), 1), 0.24, "in_place")


@query()
def hierarchical(spark, sf_dir):
    return clusters.hierarchical(frames(spark, sf_dir), 0.28, "in_place")


@query(
    f"""with {POINTS}, p as (select a.frame, b.frame as c, sqrt(sum({d2('a', 'b')}) / 21) as d from fl a join fl b on a.atom_id = b.atom_id and b.frame <= 8 group by a.frame, b.frame)
select frame, case when min(d) < 0.25 then arg_min(c, d) else 0 end as cluster, case when min(d) < 0.25 then round(min(d), 5) else -1.0 end as distance from p group by frame"""
)
def assign_to_centres(spark, sf_dir):
    whole = frames(spark, sf_dir)
    found = clusters.assign(whole, clusters.coordinates(whole, range(1, 9)), 0.25, "in_place")
    return found.select("frame", F.coalesce("cluster", F.lit(0)).alias("cluster"), F.coalesce(r(F.col("distance"), 5), F.lit(-1.0)).alias("distance"))


@query(
    f"""with {POINTS}, {NEAR}, m as (select vec_id + 1 as frame, label from embeddings), s as (
  select m.label, m.frame, sum(p.d) as s from m join (select i, j, d from p union all select j, i, d from p) p on p.i = m.frame join m o on o.frame = p.j and o.label = m.label group by m.label, m.frame)
select cast(label as integer) as cluster, arg_min(frame, s) as center from s group by label"""
)
def cluster_centres(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return clusters.centres(clusters.near_frames(whole, 10.0, "in_place"), whole.select("frame", F.col("traj_id").alias("cluster")))


# --- structure networks ---------------------------------------------------------------------

NET = networks.Network(residue=tuple(k // 3 for k in range(N_ATOMS)), norm=(3.0,) * 7, number=tuple(range(1, 8)), cutoff=0.2, proximity=1)
LINKED = f"""{POINTS}, n as (select a.frame, (a.atom_id - 1) // 3 + 1 as r1, (b.atom_id - 1) // 3 + 1 as r2, count(*) as n_pairs from fl a join fl b on a.frame = b.frame
  where (a.atom_id - 1) // 3 < (b.atom_id - 1) // 3 and sqrt({d2('a', 'b')}) <= 0.2 group by all), li as (select *, 100.0 * n_pairs / 3 as strength from n)"""


@query(f"with {LINKED} select frame, r1, r2, n_pairs, round(strength, 4) as strength from li")
def interactions(spark, sf_dir):
    return networks.interactions(frames(spark, sf_dir), NET).select("frame", "r1", "r2", "n_pairs", r(F.col("strength")).alias("strength"))


@query(
    f"with {LINKED} select r1, r2, round(sum(strength) / (select count(*) from embeddings), 4) as mean_strength, round(count(*) * 100.0 / (select count(*) from embeddings), 4) as frequency from li group by r1, r2"
)
def interaction_averages(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return networks.averages(networks.interactions(whole, NET), whole.count()).select("r1", "r2", r(F.col("mean_strength")).alias("mean_strength"), r(F.col("frequency")).alias("frequency"))


@query(
    f"""with {LINKED}, e as (select frame, r1 as residue from li where strength >= 60 union all select frame, r2 from li where strength >= 60), d as (select frame, residue, count(*) as degree from e group by all)
select residue, round(count(*) * 100.0 / (select count(*) from embeddings), 4) as frequency from d where degree > 2 group by residue"""
)
def hubs(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return networks.hubs(networks.interactions(whole, NET), 60.0, whole.count(), 2).select("residue", r(F.col("frequency")).alias("frequency"))


@query(
    f"""with recursive {LINKED}, e as (select frame, r1 as a, r2 as b from li where strength >= 60 union select frame, r2, r1 from li where strength >= 60),
g as (select frame, a, a as c from e union select e.frame, e.b, g.c from g join e on e.frame = g.frame and e.a = g.a where g.c < e.b), k as (select frame, a, min(c) as c from g group by frame, a),
s as (select frame, c, count(*) as n from k group by frame, c) select frame, max(n) as size from s group by frame"""
)
def largest_component(spark, sf_dir):
    return networks.largest_component(networks.interactions(frames(spark, sf_dir), NET), 60.0)


@query()
def critical_strength(spark, sf_dir):
    return networks.critical_strength(frames(spark, sf_dir), NET, 2, 0.0, 300.0)


@query(
    f"""with recursive {LINKED}, e as (select frame, r1 as a, r2 as b from li where strength >= 60 union select frame, r2, r1 from li where strength >= 60),
p as (select frame, [1::bigint] as p from (select distinct frame from li where strength >= 60) union all select p.frame, list_append(p, b) from p join e on e.frame = p.frame and e.a = p[-1] where not list_contains(p, b) and p[-1] <> 7 and len(p) < 7),
f as (select frame, p, len(p) - 1 as length from p where p[-1] = 7), s as (select frame, min(length) as m from f group by frame)
select f.frame, array_to_string(p, '-') as path, cast(length as double) as length from f join s on s.frame = f.frame and s.m = f.length"""
)
def shortest_paths(spark, sf_dir):
    return networks.paths(networks.interactions(frames(spark, sf_dir), NET), 1, 7, 60.0).select("frame", "path", "length")


# --- shapes and springs ---------------------------------------------------------------------

RADII = [0.12] * N_ATOMS


@query()
def tilt(spark, sf_dir):
    return shapes.tilt(frames(spark, sf_dir), range(1, 11), range(11, 22)).select("frame", r(F.col("tilt")).alias("tilt"))


@query()
def twist(spark, sf_dir):
    return shapes.twist(frames(spark, sf_dir), ALL, ([1, 2, 3], [4, 5, 6]), ([10, 11], [12, 13])).select("frame", r(F.col("twist")).alias("twist"))


def _dots_sql() -> str:
    dots = ", ".join(f"({x!r}, {y!r}, {z!r})" for x, y, z in shapes.sphere(1).tolist())
    return f"""with {POINTS}, u as (select * from (values {dots}) t(ux, uy, uz)), d as (select frame, atom_id, x + 0.17 * ux as x, y + 0.17 * uy as y, z + 0.17 * uz as z from fl, u),
n as (select d.frame, d.atom_id, d.x, d.y, d.z, bool_and({d2('d', 'o')} >= 0.17 * 0.17) as free from d join fl o on o.frame = d.frame and o.atom_id <> d.atom_id group by all)
select frame, round(count(*) filter (free) * 4 * pi() * 0.17 * 0.17 / 60, 4) as area from n group by frame"""


@query(_dots_sql())
def dotted_surface(spark, sf_dir):
    return shapes.dotted_surface(frames(spark, sf_dir), RADII, None, 0.05, 1).select("frame", r(F.col("area")).alias("area"))


@query()
def analytic_surface(spark, sf_dir):
    return shapes.analytic_surface(frames(spark, sf_dir), RADII, [1, 2, 3], 0.05).select("frame", r(F.col("area")).alias("area"))


@query(
    f"""with {POINTS}, o as (select unnest(range(-4, 4)) as o), v as (select distinct frame, atom_id <= 5 as lig, floor(x / 0.05) + a.o as i, floor(y / 0.05) + b.o as j, floor(z / 0.05) + c.o as k
  from fl, o a, o b, o c where ((floor(x / 0.05) + a.o + 0.5) * 0.05 - x) ** 2 + ((floor(y / 0.05) + b.o + 0.5) * 0.05 - y) ** 2 + ((floor(z / 0.05) + c.o + 0.5) * 0.05 - z) ** 2 <= 0.12 * 0.12),
u as (select frame, i, j, k, bool_or(lig) as l, bool_or(not lig) as r from v group by all)
select frame, round(count(*) * 0.05 ** 3, 4) as volume, round(count(*) filter (l) * 0.05 ** 3, 4) as ligand, round(count(*) filter (l and r) * 0.05 ** 3, 4) as overlap from u group by frame"""
)
def volumes(spark, sf_dir):
    found = shapes.volumes(frames(spark, sf_dir), RADII, [1, 2, 3, 4, 5], 0.05, 0.1)
    return found.select("frame", *[r(F.col(c)).alias(c) for c in ("volume", "ligand", "overlap")])


@query(
    f"""with {POINTS} select a.frame, round(2 * sum(case when b.atom_id = a.atom_id + 1 then 10.0 when sqrt({d2('a', 'b')}) < 0.3 then 1.0 else 0.0 end), 4) as trace
from fl a join fl b on a.frame = b.frame and a.atom_id < b.atom_id group by a.frame"""
)
def spring_modes(spark, sf_dir):
    return springs.per_frame_modes(frames(spark, sf_dir), springs.linear(0.3)).select("frame", r(F.col("trace")).alias("trace"))


@query(
    f"""with {POINTS}, m as (select frame, sum(atom_id * x) / 231 as mx, sum(atom_id * y) / 231 as my, sum(atom_id * z) / 231 as mz, avg(x) as cx from fl group by frame), rf as (select * from fl where frame = 1)
select fl.frame, round(sqrt(var_pop(fl.x) + var_pop(fl.y) + var_pop(fl.z)), 5) as rg, round(any_value(cx), 5) as com_x, round(sqrt(sum({d2('fl', 'rf')}) / 21), 5) as dev from fl join m on fl.frame = m.frame join rf on rf.atom_id = fl.atom_id group by fl.frame"""
)
def analysis_blocks(spark, sf_dir):
    whole = frames(spark, sf_dir)
    structure = spark.range(1, N_ATOMS + 1).select(F.col("id").alias("atom_id"), F.lit("A").alias("chain_id"), F.lit("S").alias("seg_id"), F.floor((F.col("id") - 1) / 3).alias("res_seq"), F.lit("C").alias("atom_name"))
    text = """
    BEGIN rgyr
      --TITLE rg
      --SELE /A/*/*/*
    END
    BEGIN com          # the centre, of which one column is kept
      --TITLE com
      --SELE /*/S/*/*
    END
    BEGIN rmsd
      --TITLE dev
      --SELE /*/*/*/C
      --NOSUPER
    END
    """
    rows = blocks.run(text, blocks.context(whole, structure))["frames"]
    return rows.select("frame", *[r(F.col(c), 5).alias(c) for c in ("rg", "com_x", "dev")])


@query(
    f"""with {POINTS}, a as (select * from fl where frame = 1), s as (select * from a where atom_id between 1 and 3),
near as (select distinct a.atom_id from a join s on sqrt({d2('a', 's')}) <= 0.3), far as (select distinct a.atom_id from a join s on sqrt({d2('a', 's')}) >= 0.45)
select 'near' as kind, atom_id from near where atom_id <> 5 union all select 'far', atom_id from far"""
)
def select_by_distance(spark, sf_dir):
    structure = points(frames(spark, sf_dir)).where("frame = 1").select(F.col("atom_id").cast("long").alias("atom_id"), F.lit("A").alias("chain_id"), F.lit("S").alias("seg_id"), F.col("atom_id").alias("res_seq"), F.lit("C").alias("atom_name"), "x", "y", "z")
    near, far = select(structure, "/*/*/1-3/*[0.3] ; del /*/*/5/*"), select(structure, "/*/*/1-3/*[-0.45]")
    return near.select(F.lit("near").alias("kind"), "atom_id").union(far.select(F.lit("far"), "atom_id"))


@query(
    f"""with {LINKED}, f as (select r1, r2, count(*) * 100.0 / (select count(*) from embeddings) as f from li where strength >= 30 group by r1, r2), e as (select r1 as residue, f from f union all select r2, f from f)
select residue, cast(sum(case when f >= 10 then 1 else 0 end) as bigint) as f10, cast(sum(case when f >= 33.3 then 1 else 0 end) as bigint) as f33_3, cast(sum(case when f >= 50 then 1 else 0 end) as bigint) as f50 from e group by residue"""
)
def stable_degrees(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return networks.stable_degrees(networks.interactions(whole, NET), 30.0, whole.count()).select("residue", "f10", "f33_3", "f50")


@query(
    f"""with {LINKED}, e as (select frame, r1 as residue from li where strength >= 60 union all select frame, r2 from li where strength >= 60), h as (select frame, residue from e group by all having count(*) > 1),
al as (select residue, count(*) as n from h group by residue), b as (select a.residue as a, c.residue as b, count(*) as met from h a join h c on a.frame = c.frame and a.residue < c.residue group by all),
k as (select a, b, met, (select count(*) from embeddings) as t, x.n as na, y.n as nb from b join al x on x.residue = a join al y on y.residue = b)
select a, b, round(case when t - na - nb + met > met then -1.0 else 1.0 end * (met + t - na - nb + met) / t, 5) as correlation from k"""
)
def hub_correlation(spark, sf_dir):
    whole = frames(spark, sf_dir)
    return networks.hub_correlation(networks.interactions(whole, NET), 60.0, whole.count(), 1).select("a", "b", r(F.col("correlation"), 5).alias("correlation"))


@query("with p as (select p_partkey, ['Ala', 'trp', 'HOH', 'GLY'][p_partkey % 4 + 1] as n from part) select p_partkey, n as residue, ['A', 'W', 'X', 'G'][p_partkey % 4 + 1] as letter from p")
def residue_letters(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in ("Ala", "trp", "HOH", "GLY")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("residue"), G.one_letter(name).alias("letter"))


@query("select sqrt(63.0 / 63) as whole, 1.0 as own")
def mode_overlap(spark, sf_dir):
    """All modes of one half of the trajectory span all modes of the other; a set overlaps with itself fully."""
    whole = frames(spark, sf_dir)
    ref = reference(whole)
    halves = [dense.modes(dense.covariance(whole.where(F.col("frame") % 2 == k), ref)[0])[1] for k in (0, 1)]
    found = (springs.inner_product(*halves, 63), springs.inner_product(halves[0], halves[0], 10))
    return spark.createDataFrame([tuple(round(v, 6) for v in found)], "whole double, own double")
