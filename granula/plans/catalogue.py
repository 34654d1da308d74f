"""Queries over the views, each with its DuckDB counterpart."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.operators import graph, ranges, rank_tests
from granula.operators import neighbours as nb
from granula.operators import structure as st
from granula.plans.views import ATOMS_SQL, atom_rows, atoms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CUT = "CASE WHEN a.type_id = 1 AND b.type_id = 1 THEN 3.5 WHEN a.type_id = 2 AND b.type_id = 2 THEN 3.3 ELSE 3.4 END"
_D2 = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"


def _pairs(name: str, condition: str) -> str:
    """Pairs in reach of one cell of 5 angstrom: an equality join on cells."""
    return f"""cells_{name} AS (SELECT *, floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy, floor(z / 5)::BIGINT AS cz FROM atoms),
        steps_{name} AS (SELECT c.* EXCLUDE (cx, cy, cz), cx + u AS cx, cy + v AS cy, cz + w AS cz FROM cells_{name} c, (SELECT unnest([-1, 0, 1]) AS u), (SELECT unnest([-1, 0, 1]) AS v), (SELECT unnest([-1, 0, 1]) AS w)),
        {name} AS (SELECT a.frame, a.atom_id AS i, b.atom_id AS j, a.type_id AS ti, b.type_id AS tj, a.surf AS si, b.surf AS sj,
        b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt({_D2}) AS r
        FROM cells_{name} a JOIN steps_{name} b ON a.frame = b.frame AND a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND a.atom_id < b.atom_id AND {condition})"""


def _all_pairs(name: str, condition: str) -> str:
    return f"""{name} AS (SELECT a.frame, a.atom_id AS i, b.atom_id AS j, a.type_id AS ti, b.type_id AS tj, a.surf AS si, b.surf AS sj,
        b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt({_D2}) AS r
        FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom_id < b.atom_id AND {condition})"""


_A = f"WITH atoms AS ({ATOMS_SQL})"
_H = f"{_A}, {_pairs('half', f'{_D2} <= ({_CUT})::DOUBLE * ({_CUT})::DOUBLE')}"
_B = f"{_H}, bonds AS (SELECT frame, i, j, ti, tj, si, sj, dx, dy, dz, r FROM half UNION ALL SELECT frame, j, i, tj, ti, sj, si, -dx, -dy, -dz, r FROM half)"
_C = f"""{_B}, cn AS (SELECT frame, i, count(*) AS cn FROM bonds GROUP BY 1, 2),
    gc AS (SELECT a.frame, a.atom_id, a.type_id, a.surf, coalesce(max(c.cn), 0)::BIGINT AS cn, round(coalesce(sum(d.cn) / 12.0::DOUBLE, 0), 6) AS gcn
           FROM atoms a LEFT JOIN bonds ON bonds.frame = a.frame AND bonds.i = a.atom_id LEFT JOIN cn d ON d.frame = bonds.frame AND d.i = bonds.j
           LEFT JOIN cn c ON c.frame = a.frame AND c.i = a.atom_id GROUP BY 1, 2, 3, 4)"""


def _bonds(spark: SparkSession, sf: str) -> DataFrame:
    return nb.both_ways(nb.half_bonds(atoms(spark, sf)))


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LEN = """round(avg(r), 6) AS avg_r, round(stddev_pop(r), 6) AS std_r, round(max(r), 6) AS max_r, round(min(r), 6) AS min_r, count(*) AS n"""


@query(f"{_H} SELECT frame, t1, t2, {_LEN} FROM (SELECT *, least(ti, tj) AS t1, greatest(ti, tj) AS t2 FROM half) GROUP BY GROUPING SETS ((frame), (frame, t1, t2))")
def bond_length_stats(spark, sf):
    return st.bond_lengths(nb.half_bonds(atoms(spark, sf)))


@query(f"{_A} SELECT frame, count(*) AS natoms, sum(surf)::BIGINT AS nsurf, count(*) FILTER (type_id = 1) AS n1, count(*) FILTER (type_id = 2) AS n2 FROM atoms GROUP BY frame")
def atoms_counts(spark, sf):
    return st.atom_counts(atoms(spark, sf))


@query(f"""{_A} SELECT conf_id, {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(max({c}) - min({c}) + 10.0::DOUBLE, 6) AS l{c}, round((max({c}) + min({c})) / 2, 6) AS mid_{c}" for c in "xyz")} FROM atoms GROUP BY conf_id""")
def cell_bounds(spark, sf):
    return st.cell_bounds(atoms(spark, sf))


@query(f"{_A} SELECT frame, atom_id, x, y, z FROM atoms WHERE frame BETWEEN 3 AND 60 AND frame % 5 = 0")
def frame_stride(spark, sf):
    return atoms(spark, sf).where("frame BETWEEN 3 AND 60 AND frame % 5 = 0").select("frame", "atom_id", "x", "y", "z")


@query(f"{_A} SELECT frame, CASE WHEN z < 5 THEN 0 ELSE floor(z / 5)::INTEGER END AS slab, count(*) AS n FROM atoms WHERE z < 5 OR (z < 25 AND z <> 5 * floor(z / 5)) GROUP BY 1, 2")
def slab_slice(spark, sf):
    inside = "z < 5 OR (z < 25 AND z <> 5 * floor(z / 5))"
    return atoms(spark, sf).where(inside).groupBy("frame", F.expr("CASE WHEN z < 5 THEN 0 ELSE int(floor(z / 5)) END").alias("slab")).agg(F.count("*").alias("n"))


@query(f"{_H} SELECT frame, i, j, ti, tj, round(r, 6) AS r FROM half")
def neighbour_bonds(spark, sf):
    return nb.half_bonds(atoms(spark, sf)).select("frame", "i", "j", "ti", "tj", st.r6("r").alias("r"))


@query(f"{_A}, {_pairs('far', f'{_D2} <= ({_CUT})::DOUBLE * ({_CUT})::DOUBLE * 2.0::DOUBLE')} SELECT frame, count(*) AS n, round(avg(r), 6) AS avg_r FROM far GROUP BY frame")
def bonds_extended(spark, sf):
    return nb.half_bonds(atoms(spark, sf), 2.0).groupBy("frame").agg(F.count("*").alias("n"), st.r6(F.avg("r")).alias("avg_r"))


@query(f"{_H} SELECT frame, i, j, round(r, 6) AS r FROM half WHERE si = 1 AND sj = 1")
def bonds_surface(spark, sf):
    return nb.half_bonds(atoms(spark, sf)).where("si = 1 and sj = 1").select("frame", "i", "j", st.r6("r").alias("r"))


_RAD = "(CASE WHEN {0} = 1 THEN 1.44 ELSE 1.25 END)"


@query(f"""{_A}, {_pairs("near", f"{_D2} < ({_RAD.format('a.type_id')} + {_RAD.format('b.type_id')})::DOUBLE * ({_RAD.format('a.type_id')} + {_RAD.format('b.type_id')})::DOUBLE")} SELECT frame, i, j FROM near""")
def pairs_nopbc_strict(spark, sf):
    rad = lambda c: F.when(F.col(c) == 1, F.lit(1.44)).otherwise(F.lit(1.25))
    reach = F.round(rad("ti") + rad("tj"), 2)
    return nb.grid_pairs(atoms(spark, sf), 2.9, F.col("d2") < reach * reach).select("frame", "i", "j")


@query(f"{_C} SELECT frame, atom_id, type_id, surf, cn FROM gc")
def coordination(spark, sf):
    a = atoms(spark, sf)
    return st.coordination(a, nb.both_ways(nb.half_bonds(a))).select("frame", "atom_id", "type_id", "surf", "cn")


@query(f"""{_B} SELECT a.frame, a.atom_id, count(j) AS cn, count(*) FILTER (least(ti, tj) = 1 AND greatest(ti, tj) = 1) AS cn11,
    count(*) FILTER (least(ti, tj) = 1 AND greatest(ti, tj) = 2) AS cn12, count(*) FILTER (least(ti, tj) = 2) AS cn22
    FROM atoms a LEFT JOIN bonds ON bonds.frame = a.frame AND bonds.i = a.atom_id GROUP BY 1, 2""")
def coord_partial(spark, sf):
    a = atoms(spark, sf)
    return st.coordination(a, nb.both_ways(nb.half_bonds(a))).select("frame", "atom_id", "cn", "cn11", "cn12", "cn22")


@query(f"{_C} SELECT frame, atom_id, cn, gcn FROM gc")
def gcn(spark, sf):
    a = atoms(spark, sf)
    return st.generalised(a, nb.both_ways(nb.half_bonds(a))).select("frame", "atom_id", "cn", "gcn")


@query(f"""{_B}, sb AS (SELECT * FROM bonds WHERE si = 1 AND sj = 1), cs AS (SELECT frame, i, count(*) AS cn FROM sb GROUP BY 1, 2),
    g AS (SELECT sb.frame, sb.i, count(*) AS cn, sum(cs.cn)::DOUBLE / max(cs.cn) AS gcn FROM sb JOIN cs ON cs.frame = sb.frame AND cs.i = sb.j GROUP BY 1, 2)
    SELECT a.frame, a.atom_id, coalesce(g.cn, 0)::BIGINT AS cn, round(coalesce(g.gcn, 0), 6) AS gcn FROM atoms a LEFT JOIN g ON g.frame = a.frame AND g.i = a.atom_id WHERE a.surf = 1""")
def surf_gcn(spark, sf):
    a = atoms(spark, sf)
    b = nb.both_ways(nb.half_bonds(a).where("si = 1 and sj = 1"))
    return st.generalised(a.where("surf = 1"), b, None).select("frame", "atom_id", "cn", "gcn")


@query(f"""{_C}, e AS (SELECT frame, type_id, surf, 'cn' AS kind, cn AS bin FROM gc UNION ALL SELECT frame, type_id, surf, 'gcn', ceil(gcn)::BIGINT FROM gc)
    SELECT frame, kind, bin, type_id, surf, count(*) AS n FROM e
    GROUP BY GROUPING SETS ((frame, kind, bin), (frame, kind, bin, type_id), (frame, kind, bin, surf), (frame, kind, bin, type_id, surf))""")
def coord_hist(spark, sf):
    a = atoms(spark, sf)
    return st.coordination_histogram(st.generalised(a, nb.both_ways(nb.half_bonds(a))))


@query(f"""{_C} SELECT frame, type_id, surf, round(avg(cn), 6) AS avg_cn, round(sum(round(gcn * 12)) / (12 * count(*)), 6) AS avg_gcn FROM gc
    GROUP BY GROUPING SETS ((frame), (frame, type_id), (frame, surf), (frame, type_id, surf))""")
def coord_scope_avg(spark, sf):
    a = atoms(spark, sf)
    return st.coordination_means(st.generalised(a, nb.both_ways(nb.half_bonds(a))))


@query(f"{_H} SELECT frame, least(ti, tj) AS t1, greatest(ti, tj) AS t2, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY frame), 6) AS fraction FROM half GROUP BY 1, 2, 3")
def bond_type_fraction(spark, sf):
    return st.bond_fractions(nb.half_bonds(atoms(spark, sf)))


@query(f"{_B} SELECT frame, i AS atom_id, tj, round(avg(r), 6) AS avg_r, round(max(r), 6) AS max_r, round(min(r), 6) AS min_r, count(*) AS n FROM bonds GROUP BY 1, 2, 3")
def per_atom_bond_stats(spark, sf):
    return st.atom_bond_lengths(_bonds(spark, sf))


#: g(r) and S(q) of the views: step, points, density, waves (wave 0 is undefined).
_STEP, _POINTS, _RHO, _WAVES = 0.08, 120, 0.05, 513
_REACH = _STEP * (_POINTS - 0.5)
_G = f"""{_A}, {_all_pairs('p', f'{_D2} <= {_REACH + 0.01:.4f}::DOUBLE * {_REACH + 0.01:.4f}::DOUBLE')},
    q AS (SELECT frame, least(ti, tj) AS t1, greatest(ti, tj) AS t2, floor(round(r / {_STEP}::DOUBLE, 6) + 1.5)::BIGINT AS bin FROM p),
    c AS (SELECT frame, count(*) AS natoms FROM atoms GROUP BY frame),
    m AS (SELECT frame, bin, t1, t2, count(*) AS n FROM q WHERE bin > 1 AND bin <= {_POINTS} GROUP BY GROUPING SETS ((frame, bin), (frame, bin, t1, t2))),
    g AS (SELECT frame, t1, t2, bin, n, round(n / ({2 * math.pi * _STEP * _RHO!r}::DOUBLE * natoms * ((bin - 1) * {_STEP}::DOUBLE) * ((bin - 1) * {_STEP}::DOUBLE)), 6) AS g FROM m JOIN c USING (frame))"""


def _rdf(spark, sf):
    a = atoms(spark, sf)
    h = ranges.dealt(st.distance_histogram(a, _STEP, _POINTS), "frame", atom_rows(spark, sf))
    return st.rdf(h, st.atom_counts(a), _STEP, _RHO)


@query(f"{_G} SELECT frame, bin, n, g FROM g WHERE t1 IS NULL")
def rdf_total(spark, sf):
    return _rdf(spark, sf).where("t1 is null").select("frame", "bin", "n", "g")


@query(f"{_G} SELECT * FROM g WHERE t1 IS NOT NULL")
def rdf_partial(spark, sf):
    return _rdf(spark, sf).where("t1 is not null")


_SIZE = 2 * _WAVES - 2
_K = 4 * math.pi * _RHO * _STEP**2 / (2 * math.pi / (_STEP * _SIZE))


@query(f"""{_G}, f AS (SELECT d.frame, b.bin, coalesce(g.g, 0) - 1 AS h FROM (SELECT DISTINCT frame FROM g) d, (SELECT unnest(range(2, {_POINTS + 1})) AS bin) b
    LEFT JOIN (SELECT * FROM g WHERE t1 IS NULL) g ON g.frame = d.frame AND g.bin = b.bin)
    SELECT frame, wave::INTEGER AS wave, round(1 + {_K!r}::DOUBLE / wave * sum((bin - 1) * h * sin({2 * math.pi / _SIZE!r}::DOUBLE * (bin - 1) * wave)), 4) AS s
    FROM f, (SELECT unnest(range(1, {_WAVES})) AS wave) GROUP BY frame, wave""")
def structure_factor(spark, sf):
    return st.structure_factor(_rdf(spark, sf), _STEP, _POINTS, _RHO, _WAVES)


def _deg(cos: str) -> str:
    return f"greatest(1, floor(round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {cos})))), 6) + 0.5)::INTEGER)"


_G3 = f"""{_B}, u AS (SELECT frame, i, j, ti, tj, dx / r AS x, dy / r AS y, dz / r AS z FROM bonds WHERE r > 0),
    ang AS (SELECT a.frame, a.ti, a.tj, b.tj AS tk, {_deg("a.x * b.x + a.y * b.y + a.z * b.z")} AS bin FROM u a JOIN u b ON a.frame = b.frame AND a.i = b.i AND a.j < b.j)"""
_G32 = f"""{_B}, p AS (SELECT a.frame, a.ti, a.tj, b.tj AS tk, a.dx AS ax, a.dy AS ay, a.dz AS az, a.r AS ra, a.dx + b.dx AS cx, a.dy + b.dy AS cy, a.dz + b.dz AS cz
    FROM bonds a JOIN bonds b ON a.frame = b.frame AND a.j = b.i AND b.j <> a.i),
    ang AS (SELECT frame, ti, tj, tk, {_deg("(ax * cx + ay * cy + az * cz) / (ra * sqrt(cx * cx + cy * cy + cz * cz))")} AS bin FROM p WHERE ra > 0 AND cx * cx + cy * cy + cz * cz > 0)"""
_STATS = "SELECT frame, ti, tj, tk, round(avg(bin), 6) AS avg_deg, round(stddev_pop(bin), 6) AS std_deg, max(bin) AS max_deg, min(bin) AS min_deg, count(*) AS n FROM ang GROUP BY GROUPING SETS ((frame), (frame, ti, tj, tk))"


@query(f"{_G3} SELECT frame, bin, count(*) AS n FROM ang GROUP BY 1, 2")
def angle_g3(spark, sf):
    return st.angle_histogram(st.first_shell_angles(_bonds(spark, sf)))


@query(f"{_G3} {_STATS}")
def angle_g3_partial(spark, sf):
    return st.angle_stats(st.first_shell_angles(_bonds(spark, sf)))


@query(f"{_G32} {_STATS}")
def angle_g3_2(spark, sf):
    return st.angle_stats(st.second_shell_angles(_bonds(spark, sf)))


@query(f"""{_A}, m AS (SELECT frame, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM atoms GROUP BY frame),
    s AS (SELECT frame, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS r FROM atoms JOIN m USING (frame) WHERE surf = 1)
    SELECT frame, count(*) AS n, round(min(r), 6) AS rmin, round(max(r), 6) AS rmax, round(max(r) - min(r), 6) AS rdif, round(avg(r), 6) AS ravg,
    round(stddev_samp(r), 6) AS rstd, round(skewness(r), 6) AS rskew, round(kurtosis(r), 6) AS rkurt FROM s GROUP BY frame""")
def surf_geometry(spark, sf):
    return st.surface_geometry(atoms(spark, sf))


def _x(a: str, b: str, out: str) -> str:
    return ", ".join(f"{a}{u} * {b}{v} - {a}{v} * {b}{u} AS {out}{w}" for u, v, w in (("y", "z", "x"), ("z", "x", "y"), ("x", "y", "z")))


_FLAT = "NOT (abs({0}x) < 0.1 AND abs({0}y) <= 0.1 AND abs({0}z) <= 0.1)"


_TORSION = f"""{_B}, u AS (SELECT frame, i, j, ti, tj, dx / r AS x, dy / r AS y, dz / r AS z FROM bonds WHERE r > 0),
    ab AS (SELECT a.frame, a.i, a.j, b.j AS k, a.ti, a.tj, b.tj AS tk, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz FROM u a JOIN u b ON a.frame = b.frame AND a.j = b.i AND b.j <> a.i),
    n AS (SELECT *, {_x("a", "b", "n").replace("by", '"by"')} FROM ab), m AS (SELECT *, {_x("n", "b", "m").replace("by", '"by"')} FROM n WHERE {_FLAT.format("n")}),
    p AS (SELECT m.*, d.j AS l, d.tj AS tl, d.x AS dx, d.y AS dy, d.z AS dz FROM m JOIN u d ON d.frame = m.frame AND d.i = m.k AND d.j <> m.i AND d.j <> m.j),
    q AS (SELECT *, {_x("b", "d", "q").replace("by", '"by"')} FROM p),
    t AS (SELECT frame, ti, tj, tk, tl, round(degrees(atan2(mx * qx + my * qy + mz * qz, nx * qx + ny * qy + nz * qz)), 6) AS deg FROM q WHERE {_FLAT.format("q")}),
    b AS (SELECT frame, ti, tj, tk, tl, (CASE WHEN deg < 0 THEN ceil(deg - 0.5) ELSE floor(deg + 0.5) END)::INTEGER AS b FROM t),
    h AS (SELECT frame, ti, tj, tk, tl, 'neg' AS half, CASE WHEN abs(b) = 180 THEN -180 ELSE b END AS bin FROM b WHERE b <= 0 OR b = 180
          UNION ALL SELECT frame, ti, tj, tk, tl, 'pos', CASE WHEN abs(b) = 180 THEN 180 ELSE b END FROM b WHERE b >= 0 OR b = -180)"""


@query(f"{_TORSION} SELECT frame, half, bin::INTEGER AS bin, count(*) AS n FROM h GROUP BY 1, 2, 3")
def torsion(spark, sf):
    return st.torsions(_bonds(spark, sf))


@query(f"""{_TORSION} SELECT frame, ti, tj, tk, tl, half, round(avg(bin), 6) AS avg_deg, round(stddev_pop(bin), 6) AS std_deg, max(bin)::INTEGER AS max_deg, min(bin)::INTEGER AS min_deg, count(*) AS n
    FROM h GROUP BY GROUPING SETS ((frame, half), (frame, ti, tj, tk, tl, half))""")
def torsion_partials(spark, sf):
    return st.torsion_statistics(_bonds(spark, sf))


@query(f"""{_B.replace("WITH", "WITH RECURSIVE", 1)}, two AS (SELECT frame, i FROM bonds GROUP BY 1, 2 HAVING count(*) = 2),
    e AS (SELECT b.frame, b.i, b.j FROM bonds b JOIN two x ON x.frame = b.frame AND x.i = b.i JOIN two y ON y.frame = b.frame AND y.i = b.j),
    reach AS (SELECT frame, i, i AS j FROM two UNION SELECT reach.frame, reach.i, e.j FROM reach JOIN e ON e.frame = reach.frame AND e.i = reach.j),
    c AS (SELECT frame, i, min(j) AS c FROM reach GROUP BY 1, 2), s AS (SELECT frame, c, count(*) AS length FROM c GROUP BY 1, 2)
    SELECT frame, length, count(*) AS n FROM s GROUP BY 1, 2""")
def chains(spark, sf):
    return graph.chains(_bonds(spark, sf))


@query(None)
def clusters(spark, sf):
    a = atoms(spark, sf)
    return graph.cluster_sizes(graph.clusters(a, nb.half_bonds(a).where("si = 1 and sj = 1")))


_P6 = "(231 * power({0}, 6) - 315 * power({0}, 4) + 105 * power({0}, 2) - 5) / 16"
_DOT = "(a.x * b.x + a.y * b.y + a.z * b.z)"


@query(f"""{_B}, u AS (SELECT frame, i, j, dx / r AS x, dy / r AS y, dz / r AS z FROM bonds WHERE r > 0),
    own AS (SELECT a.frame, a.i, sqrt(sum({_P6.format(_DOT)})) AS q FROM u a JOIN u b ON a.frame = b.frame AND a.i = b.i GROUP BY 1, 2),
    two AS (SELECT e.frame, e.i, e.j, sum({_P6.format(_DOT)}) AS s FROM half e JOIN u a ON a.frame = e.frame AND a.i = e.i JOIN u b ON b.frame = e.frame AND b.i = e.j WHERE e.r > 0 GROUP BY 1, 2, 3),
    c AS (SELECT two.frame, two.i, two.j, round(s / (x.q * y.q), 9) > 0.7 AS same FROM two JOIN own x ON x.frame = two.frame AND x.i = two.i JOIN own y ON y.frame = two.frame AND y.i = two.j),
    e AS (SELECT frame, i, same FROM c UNION ALL SELECT frame, j, same FROM c)
    SELECT a.frame, a.atom_id, count(*) FILTER (e.same) AS q6q6 FROM atoms a LEFT JOIN e ON e.frame = a.frame AND e.i = a.atom_id GROUP BY 1, 2""")
def q6_connectivity(spark, sf):
    a = atoms(spark, sf)
    return st.bond_order(a, nb.both_ways(nb.half_bonds(a)))


@query(f"""{_B}, n AS (SELECT a.frame, a.type_id, a.atom_id, count(*) FILTER (tj = 1) AS n1, count(*) FILTER (tj = 2) AS n2 FROM atoms a LEFT JOIN bonds ON bonds.frame = a.frame AND bonds.i = a.atom_id GROUP BY 1, 2, 3)
    SELECT frame, type_id, n1, n2, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY frame), 6) AS pct FROM n GROUP BY 1, 2, 3, 4""")
def structural_units(spark, sf):
    a = atoms(spark, sf)
    return st.structural_units(a, nb.both_ways(nb.half_bonds(a)))


_SIZES = [2.0, 4.0, 8.0, 16.0]
_BOX = f"""{_A}, s AS (SELECT unnest({_SIZES}::DOUBLE[]) AS size), c AS (SELECT frame, size, count(*) AS boxes FROM
    (SELECT DISTINCT frame, size, floor(x / size) AS a, floor(y / size) AS b, floor(z / size) AS c FROM atoms, s) GROUP BY 1, 2)"""


@query(f"{_BOX} SELECT * FROM c")
def boxcount_centres(spark, sf):
    return st.box_counts(atoms(spark, sf), _SIZES)


@query(f"{_BOX} SELECT frame, round(regr_slope(log10(boxes), -log10(size)), 6) AS dimension, round(regr_r2(log10(boxes), -log10(size)), 6) AS r2, round(regr_intercept(log10(boxes), -log10(size)), 6) AS intercept FROM c GROUP BY frame")
def fractal_slope(spark, sf):
    return st.box_dimension(st.box_counts(atoms(spark, sf), _SIZES))


@query(f"""{_A} SELECT a.conf_id, a.frame, round(sqrt(sum({_D2}) / (3 * count(*))), 6) AS rmsd, count(*) AS n
    FROM atoms a JOIN atoms b ON a.conf_id = b.conf_id AND b.frame = a.frame + 1 AND a.atom_id = b.atom_id GROUP BY 1, 2""")
def rmsd_raw(spark, sf):
    return st.rmsd_next(atoms(spark, sf))


_LIN = f"""{_A}, p AS (SELECT a.conf_id, a.frame, a.atom_id AS i, b.atom_id AS j, {_D2} AS d2 FROM atoms a JOIN atoms b ON a.conf_id = b.conf_id AND a.frame = b.frame AND a.atom_id <> b.atom_id)"""
_LV = "sqrt(greatest(0, avg(d2) - avg(sqrt(d2)) * avg(sqrt(d2)))) / avg(sqrt(d2)) AS v"


@query(f"{_LIN}, q AS (SELECT conf_id, i, j, {_LV} FROM p GROUP BY 1, 2, 3) SELECT conf_id, i AS atom_id, round(avg(v), 6) AS lindemann FROM q GROUP BY 1, 2")
def lindemann(spark, sf):
    return st.lindemann(atoms(spark, sf))


@query(ORACLES["lindemann"])
def lindemann_all(spark, sf):
    return st.lindemann(atoms(spark, sf))


@query(f"""{_LIN}, t AS (SELECT DISTINCT conf_id, frame FROM atoms), w AS (SELECT a.conf_id, a.frame, b.frame AS other FROM t a JOIN t b ON a.conf_id = b.conf_id AND b.frame BETWEEN a.frame - 2 AND a.frame + 2),
    f AS (SELECT conf_id, frame FROM w GROUP BY 1, 2 HAVING count(*) = 5), q AS (SELECT w.conf_id, w.frame, i, j, {_LV} FROM f JOIN w USING (conf_id, frame) JOIN p ON p.conf_id = w.conf_id AND p.frame = w.other GROUP BY 1, 2, 3, 4),
    l AS (SELECT conf_id, frame, i AS atom_id, avg(v) AS v FROM q GROUP BY 1, 2, 3), k AS (SELECT conf_id, atom_id, arg_min(type_id, frame) AS type_id FROM atoms GROUP BY 1, 2)
    SELECT l.conf_id, frame, type_id, round(avg(v), 5) AS lindemann, count(*) AS n FROM l JOIN k USING (conf_id, atom_id) GROUP BY GROUPING SETS ((l.conf_id, frame), (l.conf_id, frame, type_id))""")
def lindemann_windows(spark, sf):
    a = atoms(spark, sf)
    return st.lindemann_means(a, st.lindemann(a, 2))


@query(f"""{_B}, cs AS (SELECT frame, i, count(*) AS scn FROM bonds WHERE si = 1 AND sj = 1 GROUP BY 1, 2),
    n AS (SELECT a.frame, count(*) AS natoms, count(*) FILTER (scn BETWEEN 1 AND 3) AS defects, count(*) FILTER (scn BETWEEN 4 AND 7) AS micros, count(*) FILTER (scn BETWEEN 9 AND 11) AS facets
          FROM atoms a LEFT JOIN cs ON cs.frame = a.frame AND cs.i = a.atom_id GROUP BY 1)
    SELECT *, round(defects / natoms, 6) AS defects_ratio, round(micros / natoms, 6) AS micros_ratio, round(facets / natoms, 6) AS facets_ratio FROM n""")
def surface_sites(spark, sf):
    return st.surface_sites(atoms(spark, sf), _bonds(spark, sf))


@query(f"{_G3} SELECT frame, floor((bin - 1) / 10)::BIGINT AS part, count(*) AS n FROM ang GROUP BY 1, 2")
def curve_rebins(spark, sf):
    return st.rebin(angle_g3(spark, sf))


_TWO = f"""{_G}, f AS (SELECT d.frame, b.bin, coalesce(g.g, 0) AS v FROM (SELECT DISTINCT frame FROM g) d, (SELECT unnest(range(2, {_POINTS + 1})) AS bin) b
    LEFT JOIN (SELECT * FROM g WHERE t1 IS NULL) g ON g.frame = d.frame AND g.bin = b.bin),
    pr AS (SELECT a.frame, a.bin, a.v AS v1, b.v AS v2, a.v / sum(a.v) OVER w AS p, b.v / sum(b.v) OVER w AS q FROM f a JOIN f b ON b.frame = a.frame + 1 AND b.bin = a.bin WINDOW w AS (PARTITION BY a.frame))"""


@query(f"""{_TWO}, r AS (SELECT frame, p, row_number() OVER (PARTITION BY frame ORDER BY p) AS k FROM pr), t AS (SELECT frame, q, row_number() OVER (PARTITION BY frame ORDER BY q) AS k FROM pr),
    w AS (SELECT frame, avg(abs(p - q)) AS w1 FROM r JOIN t USING (frame, k) GROUP BY frame), e AS (SELECT frame, p, q, p + 1e-127::DOUBLE AS a, q + 1e-127::DOUBLE AS b, (p + q) / 2 + 1e-127::DOUBLE AS m FROM pr)
    SELECT frame, round(any_value(w1), 8) AS w1, round(sqrt(sum(power(sqrt(p) - sqrt(q), 2)) / 2), 6) AS hellinger, round(sum(a * ln(a / b)), 6) AS kl, round(sum(a * ln(a / m) + b * ln(b / m)) / 2, 6) AS js
    FROM e JOIN w USING (frame) GROUP BY frame""")
def rdf_divergence(spark, sf):
    pairs = rank_tests.next_pairs(rank_tests.curve_samples(_rdf(spark, sf).where("t1 is null"), range(2, _POINTS + 1)))
    return rank_tests.curve_distances(pairs).withColumnRenamed("pair", "frame")


_N = _POINTS - 1


@query(f"""{_TWO}, z AS (SELECT frame, 1 AS side, v1 AS v FROM pr UNION ALL SELECT frame, 2, v2 FROM pr),
    cc AS (SELECT frame, v, count(*) AS t, count(*) FILTER (side = 1) AS c1, count(*) FILTER (side = 2) AS c2 FROM z GROUP BY 1, 2),
    mm AS (SELECT *, sum(t) OVER w - t + t / 2.0::DOUBLE AS b, sum(c1) OVER w - c1 / 2.0::DOUBLE AS m1, sum(c2) OVER w - c2 / 2.0::DOUBLE AS m2, abs(sum(c1) OVER w - sum(c2) OVER w) / {_N}.0::DOUBLE AS d FROM cc WINDOW w AS (PARTITION BY frame ORDER BY v)),
    hg AS (SELECT sum(1.0::DOUBLE / i) AS h FROM range(1, {2 * _N}) x(i)), gg AS (SELECT sum(1.0::DOUBLE / (({2 * _N} - i) * j)) AS g FROM range(1, {2 * _N - 1}) x(i), range(2, {2 * _N}) y(j) WHERE j > i),
    co AS (SELECT {2.0 / _N!r}::DOUBLE AS r, h, g, {2 * _N}.0::DOUBLE AS n FROM hg, gg),
    sg AS (SELECT sqrt((((4 * g - 6) + (10 - 6 * g) * r) * n * n * n + ((2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * r - 8 * h + 4 * g - 6) * n * n
        + ((6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * r + 4 * h) * n + (2 * h + 6) * 4 - 8 * h) / ((n - 1) * (n - 2) * (n - 3))) AS sigma, n FROM co),
    s AS (SELECT frame, ((n - 1) / n * sum(t / n * (power(n * m1 - b * {_N}, 2) + power(n * m2 - b * {_N}, 2)) / (b * (n - b) - n * t / 4) / {_N}) - 1) / any_value(sigma) AS ad, max(d) AS ks FROM mm, sg GROUP BY frame, n),
    rk AS (SELECT frame, side, rank() OVER (PARTITION BY frame ORDER BY v) + (count(*) OVER (PARTITION BY frame, v) - 1) / 2.0::DOUBLE - row_number() OVER (PARTITION BY frame, side ORDER BY v) AS o FROM z),
    cv AS (SELECT frame, {_N} * sum(o * o) / ({_N}.0::DOUBLE * {_N} * {2 * _N}) - (4.0::DOUBLE * {_N * _N} - 1) / {12 * _N} AS cvm FROM rk GROUP BY frame),
    x AS (SELECT s.*, cvm, 1 / 6.0::DOUBLE + (cvm - (1 + 1 / {2 * _N}.0::DOUBLE) / 6) / sqrt(45 * {(2 * _N + 1) * (4 * _N * _N * 2 * _N - 6 * _N * _N - 2 * _N * _N) / (45 * 4 * _N * _N * 4 * _N * _N)!r}::DOUBLE) AS x FROM s JOIN cv USING (frame)),
    kn AS (SELECT k, (4.0::DOUBLE * k + 1) AS y, exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE) - lgamma(0.5::DOUBLE)) AS a FROM range(0, 21) r(k)),
    pc AS (SELECT frame, sum(a * sqrt(y) / (pi() * sqrt(x)) * CASE WHEN i = 0 THEN 0.5::DOUBLE ELSE 1 END * 0.08::DOUBLE * exp(-y * y / (16 * x) * (1 + (exp(i * 0.08::DOUBLE) + exp(-i * 0.08::DOUBLE)) / 2)) * (exp(i * 0.02::DOUBLE) + exp(-i * 0.02::DOUBLE)) / 2) AS cdf
           FROM x, kn, range(0, 190) r(i) WHERE x >= 0.003 GROUP BY frame),
    pk AS (SELECT frame, least(1, greatest(0, 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(2 * lgamma({_N + 1}.0::DOUBLE) - lgamma({_N + 1}.0::DOUBLE - k * h) - lgamma({_N + 1}.0::DOUBLE + k * h))))) AS p_ks
           FROM (SELECT frame, round(ks * {_N})::BIGINT AS h FROM s), range(1, {_N + 1}) r(k) WHERE h > 0 AND k * h <= {_N} GROUP BY frame)
    SELECT frame, round(ad, 6) AS ad, round(CASE WHEN ad < {min(rank_tests.AD_POINTS)!r}::DOUBLE THEN 0.25 WHEN ad > {max(rank_tests.AD_POINTS)!r}::DOUBLE THEN 0.001 ELSE exp({rank_tests.AD_FIT[0]!r}::DOUBLE * ad * ad + {rank_tests.AD_FIT[1]!r}::DOUBLE * ad + {rank_tests.AD_FIT[2]!r}::DOUBLE) END, 6) AS p_ad,
    round(ks, 6) AS ks, round(coalesce(p_ks, 1), 6) AS p_ks, round(cvm, 6) AS cvm, round(CASE WHEN x < 0.003 THEN 1 ELSE greatest(0, 1 - cdf) END, 6) AS p_cvm FROM x LEFT JOIN pc USING (frame) LEFT JOIN pk USING (frame)""")
def rdf_rank_tests(spark, sf):
    pairs = rank_tests.next_pairs(rank_tests.curve_samples(_rdf(spark, sf).where("t1 is null"), range(2, _POINTS + 1)))
    return rank_tests.two_sample_tests(pairs).withColumnRenamed("pair", "frame")


for _name in ("rdf_total", "rdf_partial", "structure_factor", "rdf_divergence"):
    # The names under which these queries had all bins and waves before.
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]


@query(f"""{_B}, b AS (SELECT frame, i, avg(r) AS avg_r, count(*) AS cn FROM bonds GROUP BY 1, 2)
    SELECT a.frame, a.atom_id, round(avg_r, 6) AS avg_r, coalesce(cn, 0)::BIGINT AS cn FROM atoms a LEFT JOIN b ON b.frame = a.frame AND b.i = a.atom_id""")
def atom_mean_bond(spark, sf):
    return st.mean_bonds(atoms(spark, sf), _bonds(spark, sf))


@query(f"{_B} SELECT frame, count(DISTINCT i) AS n FROM bonds WHERE si = 0 AND sj = 1 GROUP BY frame")
def bulk_under_surface(spark, sf):
    return st.under_surface(atoms(spark, sf), _bonds(spark, sf))


@query(f"""{_B}, n AS (SELECT a.frame, a.type_id, a.atom_id, count(*) FILTER (tj = 1) AS n1, count(*) FILTER (tj = 2) AS n2 FROM atoms a LEFT JOIN bonds ON bonds.frame = a.frame AND bonds.i = a.atom_id GROUP BY 1, 2, 3),
    t AS (SELECT * FROM (VALUES (1, 1, 1, 0), (2, 2, 0, 1), (3, 1, 2, 1), (4, 2, 1, 2), (5, 1, 1, 0)) t(template, type_id, n1, n2))
    SELECT n.frame, n.atom_id, coalesce(max(t.template), 0)::INTEGER AS template FROM n LEFT JOIN t ON t.type_id = n.type_id AND t.n1 = n.n1 AND t.n2 = n.n2 GROUP BY 1, 2""")
def unit_tracking(spark, sf):
    a = atoms(spark, sf)
    return st.unit_tracking(a, nb.both_ways(nb.half_bonds(a)), [(1, 1, 0), (2, 0, 1), (1, 2, 1), (2, 1, 2), (1, 1, 0)])


@query("""WITH v AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL),
    c AS (SELECT label, d, count(x) AS n, avg(x) AS m, var_pop(x) * count(x) AS w FROM v GROUP BY 1, 2), g AS (SELECT d, sum(n * m) / sum(n) AS g FROM c GROUP BY d),
    k AS (SELECT c.label, max(n) AS n, sum(w) AS w, sum(n * (m - g) * (m - g)) AS b FROM c JOIN g USING (d) GROUP BY c.label)
    SELECT count(*) AS clusters, sum(n)::BIGINT AS n, round((sum(b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM k""")
def cluster_separation(spark, sf):
    return st.calinski_harabasz(spark.read.parquet(f"{sf}/embeddings.parquet"), "label", "embedding")


def _shared(name: str, tables: str, sql: str, duck: str | None = None) -> None:
    """A query that one SQL text expresses on both sides; ``duck`` where the dialects differ."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(sql, **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in tables.split()})

    run.__name__ = name
    text = duck or sql
    for t in tables.split():
        text = text.replace("{" + t + "}", t)
    query(text)(run)


def _oracle(name: str, tables: str, sql: str, duck: str | None = None) -> None:
    """The SQL of a query whose Spark side is a library function, in ``more``."""
    text = duck or sql
    for t in tables.split():
        text = text.replace("{" + t + "}", t)
    ORACLES[name] = text


_EV = "SELECT user_id AS conf_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_type, value FROM {events}"

_oracle("depad", "events", f"""WITH e AS ({_EV}), d AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY conf_id ORDER BY line_no) THEN line_no END AS again FROM e),
    m AS (SELECT *, min(again) OVER (PARTITION BY conf_id) AS cut FROM d) SELECT conf_id, line_no, event_type, value FROM m WHERE cut IS NULL OR line_no <= cut - 2""")
_oracle("log_scan", "events", f"""WITH e AS ({_EV}), s AS (SELECT *, lag(value) OVER (PARTITION BY conf_id ORDER BY line_no) AS last_value,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY conf_id ORDER BY line_no) AS run FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY conf_id, run ORDER BY line_no) AS k FROM s WHERE event_type = 'purchase' AND run > 0)
    SELECT conf_id, CAST(run AS BIGINT) AS run, line_no, round(last_value, 6) AS energy FROM f WHERE k = 1""")
_oracle("rolling_mean", "events", f"""WITH e AS ({_EV}), r AS (SELECT conf_id, line_no, avg(value) OVER (PARTITION BY conf_id ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM e)
    SELECT conf_id, line_no, round(m, 6) AS mean5 FROM r WHERE line_no >= 5""")
_oracle("block_mean", "events", f"WITH e AS ({_EV}) SELECT conf_id, CAST(floor((line_no - 1) / 10) AS BIGINT) AS block, round(avg(value), 6) AS mean, count(*) AS n FROM e GROUP BY conf_id, CAST(floor((line_no - 1) / 10) AS BIGINT)")
_oracle("local_maxima", "events", f"""WITH e AS ({_EV}), w AS (SELECT *, lag(value) OVER (PARTITION BY conf_id ORDER BY line_no) AS a, lead(value) OVER (PARTITION BY conf_id ORDER BY line_no) AS b FROM e)
    SELECT conf_id, line_no, round(value, 6) AS peak FROM w WHERE value > a AND value > b""")
_shared("zscore_peaks", "events", f"""WITH e AS ({_EV}), w AS (SELECT *, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s, count(*) OVER p AS n FROM e
    WINDOW p AS (PARTITION BY conf_id ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT conf_id, line_no, CASE WHEN value > m THEN 1 ELSE -1 END AS signal FROM w WHERE n = 10 AND abs(value - m) > 2 * s""")
_oracle("welch_t", "events", f"""WITH e AS ({_EV}), c AS (SELECT *, ntile(2) OVER (PARTITION BY conf_id ORDER BY line_no) AS h FROM e),
    a AS (SELECT conf_id, avg(CASE WHEN h = 1 THEN value END) AS m1, avg(CASE WHEN h = 2 THEN value END) AS m2, var_samp(CASE WHEN h = 1 THEN value END) AS v1, var_samp(CASE WHEN h = 2 THEN value END) AS v2,
    count(CASE WHEN h = 1 THEN 1 END) AS n1, count(CASE WHEN h = 2 THEN 1 END) AS n2 FROM c GROUP BY conf_id)
    SELECT conf_id, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) AS df
    FROM a WHERE n1 > 1 AND n2 > 1 AND v1 / n1 + v2 / n2 > 0""")
_shared("last_frame", "lineitem", "SELECT l_suppkey AS conf_id, max(l_shipdate) AS last_step, count(*) AS n FROM {lineitem} GROUP BY l_suppkey")
_oracle("dedup_clean", "lineitem", "SELECT DISTINCT l_orderkey, l_linenumber, round(l_quantity, 4) AS quantity FROM {lineitem}")
_oracle("onehot", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_a, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS is_n, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_r FROM {lineitem}")
_oracle("scale_minmax", "lineitem", """SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - min(l_quantity) OVER w) / nullif(max(l_quantity) OVER w - min(l_quantity) OVER w, 0), 6) AS scaled
    FROM {lineitem} WINDOW w AS (PARTITION BY l_suppkey)""")
_oracle("variance_filter", "lineitem", """SELECT name, round(v, 6) AS variance FROM (SELECT 'quantity' AS name, var_pop(l_quantity) AS v FROM {lineitem} UNION ALL SELECT 'discount', var_pop(l_discount) FROM {lineitem}
    UNION ALL SELECT 'tax', var_pop(l_tax) FROM {lineitem}) WHERE v > 0.0009""")
_oracle("anti_join_remaining", "orders lineitem", "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
_shared("reindex", "supplier", "SELECT s_suppkey, lpad(CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS {string}), 6, '0') AS conf_id FROM {supplier}".replace("{string}", "STRING"),
        "SELECT s_suppkey, lpad(CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS VARCHAR), 6, '0') AS conf_id FROM {supplier}")
_oracle("name_parse", "part", "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)', 1) AS letters, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, substring(p_type, 1, 2) AS shape FROM {part}")
_shared("param_sweep", "nation", """SELECT a.n_nationkey AS e1, b.n_nationkey AS e2, s.size1, t.size2 FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
    JOIN (SELECT DISTINCT n_regionkey * 10 + 20 AS size1 FROM {nation}) s ON s.size1 > 20 JOIN (SELECT DISTINCT n_regionkey * 10 + 20 AS size2 FROM {nation}) t ON t.size2 < s.size1""")
_oracle("lead_frame_pairs", "events", f"WITH e AS ({_EV}) SELECT conf_id, line_no, lead(line_no) OVER (PARTITION BY conf_id ORDER BY line_no) AS next_no, round(lead(value) OVER (PARTITION BY conf_id ORDER BY line_no) - value, 6) AS step FROM e")
_shared("hist_bin_rules", "events", """SELECT event_type, count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS bins_sqrt, CAST(ceil(log2(count(*))) AS BIGINT) + 1 AS bins_sturges,
    CAST(ceil(2 * power(count(*), 1 / 3.0)) AS BIGINT) AS bins_rice, round(3.49 * stddev_samp(value) / power(count(*), 1 / 3.0), 2) AS width_scott FROM {events} GROUP BY event_type""")
_oracle("config_union", "customer supplier", "SELECT 'customer' AS source, c_nationkey AS nation, count(*) AS n FROM {customer} GROUP BY c_nationkey UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM {supplier} GROUP BY s_nationkey")
_oracle("formation_energy", "lineitem", "SELECT l_suppkey AS frame, round(sum(l_extendedprice) - sum(CASE WHEN l_returnflag = 'A' THEN 3.81 ELSE 4.39 END), 4) AS energy FROM {lineitem} GROUP BY l_suppkey")
_oracle("group_mean_sorted", "part", "SELECT substring(p_type, 1, 2) AS shape, round(avg(p_retailprice), 4) AS mean_price, round(avg(p_size), 6) AS mean_size, count(*) AS n FROM {part} GROUP BY substring(p_type, 1, 2) ORDER BY shape")
_oracle("resource_estimate", "lineitem", """WITH n AS (SELECT l_suppkey AS frame, count(*) AS natoms FROM {lineitem} GROUP BY l_suppkey), c AS (SELECT *, CAST((floor((natoms - 1) / 64000) + 1) * 48 AS BIGINT) AS ncpus FROM n)
    SELECT frame, natoms, ncpus, CAST(floor(36 * natoms / ncpus) AS BIGINT) AS seconds FROM c""")
_oracle("density_overlap", "events", """WITH h AS (SELECT event_type, value AS v, count(*) AS n FROM {events} WHERE value IS NOT NULL GROUP BY event_type, value),
    t AS (SELECT event_type, sum(n) AS total FROM h GROUP BY event_type), g AS (SELECT *, (SELECT min(v) FROM h) AS lo, (SELECT (max(v) - min(v)) / 99 FROM h) AS w, explode(sequence(0, 99)) AS i FROM h),
    k AS (SELECT event_type, i, max(w) AS w, sum(n * exp(-power((lo + w * i - v) / 5, 2) / 2)) / (5 * sqrt(2 * pi())) AS s FROM g GROUP BY event_type, i),
    d AS (SELECT k.event_type, k.i, k.w, k.s / t.total AS p FROM k JOIN t ON t.event_type = k.event_type)
    SELECT a.event_type AS type_a, b.event_type AS type_b, round(sum(sqrt(a.p * b.p) * a.w), 6) AS bhattacharyya FROM d a JOIN d b ON a.i = b.i AND a.event_type < b.event_type GROUP BY a.event_type, b.event_type""")
ORACLES["density_overlap"] = ORACLES["density_overlap"].replace("explode(sequence(0, 99))", "unnest(range(0, 100))")
