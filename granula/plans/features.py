"""The published dataset as queries: long features, the wide row, and the row merged with simulated energies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granula.operators import cases, consensus, dataset, ranges, rings, selection, selectivity, surface
from granula.operators import neighbours as nb
from granula.operators import structure as st
from granula.sources import results
from granula.plans import catalogue, more  # noqa: F401 - more adds to the catalogue
from granula.plans.catalogue import _A, _B, _C, _H, _bonds, ORACLES, query
from granula.plans.views import atom_rows, atoms

_ELEMENTS = ("Au", "Pt")
#: Groups of features that have no SQL.
_NO_SQL = ("S_", "Curve_", *dataset.LATTICES)


def _long(spark: SparkSession, sf: str, surfaces: bool) -> DataFrame:
    a = atoms(spark, sf)
    half = nb.half_bonds(a)  # found again in each frame's task by all who use it: they never leave it, so nothing is written
    return dataset.features_long(a, half, surface.curvature(a, nb.both_ways(half)) if surfaces else None, atom_rows(spark, sf))


def _each(source: str, name: str, values: dict[str, str]) -> str:
    """Rows (frame, feature, value) of some columns of another query's SQL."""
    names = ", ".join(f"{name} || '{k}'" for k in values)
    return f"SELECT frame, unnest([{names}]) AS feature, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in values.values())}]) AS value FROM ({ORACLES[source]})"


_PREFIX = "CASE WHEN type_id IS NULL THEN 'MM' ELSE 'Ele' || type_id || 'M' END"
_SCOPE = "CASE WHEN surf IS NULL THEN 'T' WHEN surf = 0 THEN 'B' ELSE 'S' END"
_PAIR = "CASE WHEN t1 IS NULL THEN 'MM' ELSE 'Ele' || t1 || 'Ele' || t2 END"
_THREE = "CASE WHEN ti IS NULL THEN 'MMM' ELSE 'Ele' || ti || 'Ele' || tj || 'Ele' || tk END"
_FOUR = "CASE WHEN ti IS NULL THEN 'MMMM' ELSE 'Ele' || ti || 'Ele' || tj || 'Ele' || tk || 'Ele' || tl END"
_DEG = {"avg": "avg_deg", "std": "std_deg", "max": "max_deg", "min": "min_deg", "num": "n"}
_OWN = f"(SELECT o.*, a.type_id FROM ({ORACLES['surf_gcn']}) o JOIN ({ORACLES['coordination']}) a USING (frame, atom_id))"
_LONG = " UNION ALL ".join([
    _each("atoms_counts", "''", {"N_atom_total": "natoms", "N_Ele1": "n1", "N_Ele2": "n2", "N_atom_bulk": "natoms - nsurf", "N_atom_surface": "nsurf"}),
    _each("surf_geometry", "'R_'", {"min": "rmin", "max": "rmax", "diff": "rdif", "avg": "ravg", "std": "rstd", "skew": "rskew", "kurt": "rkurt"}),
    f"SELECT frame, {_PREFIX} || '_' || {_SCOPE} || upper(kind) || '_' || bin, n::DOUBLE FROM ({ORACLES['coord_hist']}) WHERE bin <= 20",
    _each("coord_scope_avg", f"{_PREFIX} || '_' || {_SCOPE}", {"CN_avg": "avg_cn", "GCN_avg": "avg_gcn"}),
    f"""SELECT frame, {_PREFIX} || '_SO' || kind || '_' || bin, n::DOUBLE FROM (SELECT frame, type_id, kind, bin, count(*) AS n
        FROM (SELECT frame, type_id, unnest(['CN', 'GCN']) AS kind, unnest([cn, ceil(gcn)::BIGINT]) AS bin FROM {_OWN}) GROUP BY GROUPING SETS ((frame, kind, bin), (frame, type_id, kind, bin))) WHERE bin <= 20""",
    f"SELECT frame, {_PREFIX} || '_SO' || unnest(['CN_avg', 'GCN_avg']), unnest([round(c, 6), round(g, 6)]) FROM (SELECT frame, type_id, avg(cn) AS c, avg(gcn) AS g FROM {_OWN} GROUP BY GROUPING SETS ((frame), (frame, type_id)))",
    _each("bond_length_stats", _PAIR, {"_BL_avg": "avg_r", "_BL_std": "std_r", "_BL_max": "max_r", "_BL_min": "min_r", "_BL_num": "n"}),
    _each("bond_type_fraction", _PAIR, {"_frac": "fraction"}),
    f"SELECT frame, 'N_bond', n::DOUBLE FROM ({ORACLES['bond_length_stats']}) WHERE t1 IS NULL",
    _each("angle_g3_partial", _THREE, {f"_BA1_{k}": v for k, v in _DEG.items()}),
    _each("angle_g3_2", _THREE, {f"_BA2_{k}": v for k, v in _DEG.items()}),
    _each("torsion_partials", f"{_FOUR} || '_BT' || half", {f"_{k}": v for k, v in _DEG.items()}),
    f"SELECT frame, 'q6q6_' || {_SCOPE} || '_' || CASE WHEN bin > 20 THEN '20+' ELSE bin::VARCHAR END, n::DOUBLE FROM ({ORACLES['q6_histogram']})",
    f"""SELECT frame, 'q6q6_' || {_SCOPE} || '_avg', round(m, 6) FROM (SELECT q.frame, a.surf, avg(q6q6) AS m FROM ({ORACLES['q6_connectivity']}) q JOIN ({ORACLES['coordination']}) a USING (frame, atom_id)
        GROUP BY GROUPING SETS ((q.frame), (q.frame, a.surf)))""",
])


@query(_LONG)
def dataset_long(spark, sf):
    """Features of each frame, a row each, without facets, curvature and lattice classes, which have no SQL."""
    return _long(spark, sf, False)


def _column(c: str) -> str:
    v = f"v['{c}']"
    if c.startswith(_NO_SQL):
        return f'CAST(NULL AS DOUBLE) AS "{c}"'
    return f'{f"coalesce({v}, 0)" if dataset.is_count(c) else v} AS "{c}"'


def _derived() -> str:
    """The columns that come from others, as a list of expressions over the wide row."""
    packed = " + ".join(f'"N_Ele{k}" * ({dataset.ELEMENTS[e][0]}::DOUBLE / 6.02214076e23::DOUBLE) / ({dataset.ELEMENTS[e][1]}::DOUBLE / 1e30::DOUBLE)' for k, e in enumerate(_ELEMENTS, 1))
    out = {"Vol_bulk_pack": packed, "Vol_sphere": '3.0::DOUBLE / 4 * pi() * power("R_avg", 3)'}
    for s, numbers in dataset.SITES.items():
        of = {f"_Ele{k}": "(" + " + ".join(f'"Ele{k}M_SCN_{n}"' for n in numbers) + ")" for k in (1, 2)}
        of[""] = f"({of['_Ele1']} + {of['_Ele2']})"
        for e, n in of.items():
            out[f"Surf_{s}{e}"] = n
            for v in ("bulk_pack", "sphere"):
                out |= {f"Surf_{s}{e}_{v}_conc": f"{n} / ({out[f'Vol_{v}']})", f"Surf_{s}{e}_{v}_ratio": f'{n} / "N_atom_total"'}
    return ", ".join(f'{v} AS "{k}"' for k, v in out.items())


_SIMULATED = "SELECT l_suppkey AS frame, avg(l_quantity)::DOUBLE AS T, avg(l_tax)::DOUBLE AS P, -sum(l_extendedprice)::DOUBLE AS Potential_E, sum(l_discount)::DOUBLE AS Kinetic_E, (sum(l_discount) - sum(l_extendedprice))::DOUBLE AS Total_E FROM {} GROUP BY l_suppkey"
_BULK = " + ".join(f'"N_Ele{k}" * ({dataset.ELEMENTS[e][2]}::DOUBLE)' for k, e in enumerate(_ELEMENTS, 1))


def _published(spark: SparkSession, sf: str, surfaces: bool) -> DataFrame:
    simulated = spark.sql(_SIMULATED.format("{t}").replace("::DOUBLE", ""), t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    rows = dataset.published(dataset.wide(_long(spark, sf, surfaces), dataset.LATTICES if surfaces else _NO_SQL), simulated, _ELEMENTS)
    return rows.select("frame", *[F.round(F.col(f"`{c}`"), 9 if c.endswith("conc") else 6).alias(c) for c in dataset.names()])


@query(f"""WITH l AS ({_LONG}), v AS MATERIALIZED (SELECT frame, map(list(feature), list(value)) AS v FROM l GROUP BY frame),
    m AS MATERIALIZED (SELECT frame, {", ".join(map(_column, dataset.measured_names()))} FROM v), d AS (SELECT m.*, {_derived()} FROM m), s AS ({_SIMULATED.format("lineitem")}),
    p AS (SELECT d.*, s.* EXCLUDE (frame), Total_E - ({_BULK}) AS "Formation_E" FROM d JOIN s USING (frame))
    SELECT frame, {", ".join(f'round("{c}", {9 if c.endswith("conc") else 6}) AS "{c}"' for c in dataset.names())} FROM p""")
def dataset_wide(spark, sf):
    """The dataset's 972 columns merged with simulated energies; facets, curvature and lattice classes are null, as they have no SQL."""
    return _published(spark, sf, False)


@query(None)
def dataset_published(spark, sf):
    """The dataset's 972 columns with facets and curvature; lattice classes are null."""
    return _published(spark, sf, True)


#: Lines (slope, intercept) of an activity curve.
_LINES = [(0.063, -0.35), (0.29, -1.6), (-0.27, 1.75), (0.055, -0.42), (-0.055, 0.42)]
_N = selectivity.grid_points()


@query(f"""{_C}, g0 AS (SELECT k, 1.0::DOUBLE + k * 0.001::DOUBLE AS x, CASE WHEN k = 0 OR k = {_N - 1} THEN 1.0::DOUBLE WHEN k % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END * 0.001::DOUBLE / 3 AS w FROM range(0, {_N}) r(k)),
    g1 AS (SELECT *, least({", ".join(f"{a}::DOUBLE * x + ({b}::DOUBLE)" for a, b in _LINES)}) AS v FROM g0), g2 AS (SELECT *, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS u FROM g1), cu AS (SELECT k, x, w, u / sum(u * w) OVER () AS q FROM g2),
    val AS (SELECT frame, gcn AS v FROM gc), st AS (SELECT frame, count(*) AS n, least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.3489795003921634::DOUBLE) * power(count(*) * 3 / 4.0::DOUBLE, -0.2::DOUBLE) AS h FROM val GROUP BY 1),
    dv AS (SELECT frame, v, count(*) AS m FROM val GROUP BY 1, 2), de AS (SELECT frame, k, sum(m * exp(-power((x - v) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS p FROM dv JOIN st USING (frame), cu GROUP BY 1, 2),
    bo AS (SELECT frame, k, x, w, p, q, CASE WHEN p <> 0 AND q <> 0 THEN least(p, q) END AS o FROM de JOIN cu USING (k)), mx AS (SELECT *, max(o) OVER (PARTITION BY frame) AS mo, max(q) OVER (PARTITION BY frame) AS mq FROM bo),
    s AS (SELECT frame, arg_max(x, (p, -k)) AS xp, arg_max(x, (q, -k)) AS xq, min(x) FILTER (o > mo / 2) AS ol, max(x) FILTER (o > mo / 2) AS oh, min(x) FILTER (q > mq / 2) AS ql, max(x) FILTER (q > mq / 2) AS qh, sum(p * q * w) AS sen FROM mx GROUP BY 1)
    SELECT frame, round(1 - abs(xp - xq) / 13, 4) AS selectivity, round(CASE WHEN ol > ql AND oh < qh THEN 1 - (oh - ol) / (qh - ql) / 2 ELSE (oh - ol) / (qh - ql) / 2 END, 4) AS specificity, round(sen, 6) AS sensitivity FROM s""")
def reaction_selectivity(spark, sf):
    """How well each frame's generalised coordination numbers fit an activity curve."""
    a = atoms(spark, sf)
    g = st.generalised(a, nb.both_ways(nb.half_bonds(a)))
    s = selectivity.fits(g, "frame", "gcn", selectivity.activity_curve(spark, _LINES))
    return s.select("frame", F.round("selectivity", 4).alias("selectivity"), F.round("specificity", 4).alias("specificity"), F.round("sensitivity", 6).alias("sensitivity"))


_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, round(sum(n / t * ln(n * t / (nx * ny))), 9) AS mi FROM (SELECT *, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny
    FROM (SELECT {a} AS x, {b} AS y, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2))""" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]))
def pairwise_information(spark, sf):
    return selection.pairwise_information(spark.read.parquet(f"{sf}/lineitem.parquet"), _COLUMNS)


@query(None)
def select_features(spark, sf):
    """Columns picked for what they tell about the line status and not about each other."""
    return selection.forward_selection(spark.read.parquet(f"{sf}/lineitem.parquet"), [c for c in _COLUMNS if c != "l_linestatus"], "l_linestatus")


@query(None)
def consensus_clusters(spark, sf):
    """Orders of each customer's nation clustered by how often five simple labellings agree."""
    t = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    runs = {"status": F.col("o_orderstatus"), "priority": F.substring("o_orderpriority", 1, 1), "segment": F.substring("c_mktsegment", 1, 2), "price": F.floor(F.col("o_totalprice") / 50000), "year": F.year("o_orderdate")}
    rows = t.select(F.col("c_nationkey").alias("nation"), "o_orderkey", F.inline(F.array(*[F.struct(F.lit(k).alias("run"), v.cast("string").alias("label")) for k, v in runs.items()])))
    return consensus.consensus(rows, "nation", "o_orderkey", "run", "label", 6)


@query(f"""{_B}, c AS (SELECT frame, i, {", ".join(f"count(*) FILTER (least(ti, tj) = {a} AND greatest(ti, tj) = {b}) AS c{a}{b}" for a, b in ((1, 1), (1, 2), (2, 2)))} FROM bonds GROUP BY 1, 2)
    SELECT a.frame, a.atom_id, {", ".join(f"round(coalesce(sum(c{p}) / 12.0::DOUBLE, 0), 6) AS gcn{p}" for p in ("11", "12", "22"))} FROM atoms a LEFT JOIN bonds b ON b.frame = a.frame AND b.i = a.atom_id LEFT JOIN c ON c.frame = b.frame AND c.i = b.j GROUP BY 1, 2""")
def gcn_partial(spark, sf):
    a = atoms(spark, sf)
    return st.generalised_partial(a, nb.both_ways(nb.half_bonds(a)))


_ORDERS = {l: st.harmonics(l) for l in range(0, 13, 2)}


@query(f"""{_H}, u AS (SELECT frame, dx / r AS x, dy / r AS y, dz / r AS z FROM half WHERE r > 0),
    m AS (SELECT frame, {", ".join(f"sqrt({' + '.join(f'power(avg({t}), 2)' for t in ts)}) AS q{l}" for l, ts in _ORDERS.items())} FROM u GROUP BY frame)
    {" UNION ALL ".join(f"SELECT frame, {l} AS l, {f'round(q{l}, 6)' if l in _ORDERS else '0.0::DOUBLE'} AS q FROM m" for l in range(13))}""")
def global_order(spark, sf):
    return st.global_order(nb.half_bonds(atoms(spark, sf)))


@query(f"{_A} SELECT frame, CASE type_id WHEN 1 THEN 'Au' ELSE 'Pt' END AS element, count(*) AS n FROM atoms GROUP BY 1, 2")
def named_elements(spark, sf):
    types = spark.createDataFrame([(1, "Au"), (2, "Pt")], "type_id int, element string")
    return st.named_types(atoms(spark, sf), types).groupBy("frame", "element").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(c_mktsegment, 'A') AND contains(c_name, '7')")
def elements_in_names(spark, sf):
    t = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    return results.of_elements(t, "c_mktsegment", "c_name", "A", "7")


@query("SELECT s.s_suppkey, s.s_nationkey AS cluster, n.spent, n.orders FROM supplier s LEFT JOIN (SELECT l_suppkey, round(sum(l_extendedprice), 4) AS spent, count(*) AS orders FROM lineitem GROUP BY 1) n ON n.l_suppkey = s.s_suppkey")
def scores_of_clusters(spark, sf):
    points = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("cluster"))
    scores = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum("l_extendedprice"), 4).alias("spent"), F.count("*").alias("orders"))
    return st.labelled(points, scores, ["s_suppkey"])


def _settled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a = atoms(spark, sf).select("frame", "atom_id", "x", "y", "z")
    peaks = ranges.fixed(cases.density_peaks(a, "frame", "atom_id", ["x", "y", "z"], 3.0).select("frame", "atom_id", "gamma"))
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("gamma"), "atom_id"))
    points = a.join(peaks.withColumn("centre", rank <= 8), ["frame", "atom_id"])
    return points, cases.settled_clusters(points, "frame", "atom_id", ["x", "y", "z"], "centre", 30)


@query(None)
def settled_clusters(spark, sf):
    """Atoms of each frame by the nearest of eight density peaks, small clusters given up."""
    return _settled(spark, sf)[1]


@query(None)
def sub_cluster_traces(spark, sf):
    """How far labels reach inside each settled cluster, step by step."""
    return cases.peak_traces(atoms(spark, sf), "frame", "atom_id", ["x", "y", "z"], 3.0, 8, 30)


_E = "SELECT 1 FROM e z WHERE z.frame = {0}.frame AND z.i = {1} AND z.j = {2}"
_NOT = lambda t, *pairs: " AND ".join(f"NOT EXISTS ({_E.format(t, a, b)})" for a, b in pairs)
_FAR = lambda t, a, b: f"NOT EXISTS (SELECT 1 FROM near z WHERE z.frame = {t}.frame AND z.i = {a} AND z.j = {b})"


@query(f"""{_B}, e AS MATERIALIZED (SELECT DISTINCT frame, i, j FROM bonds), p2 AS (SELECT x.frame, x.i AS a, x.j AS b, y.j AS c FROM e x JOIN e y ON y.frame = x.frame AND y.i = x.j AND y.j <> x.i),
    two AS MATERIALIZED (SELECT * FROM p2 WHERE {_NOT("p2", ("p2.a", "p2.c"))}), near AS MATERIALIZED (SELECT * FROM e UNION SELECT frame, a, c FROM two),
    p3 AS (SELECT t.*, y.j AS d FROM two t JOIN e y ON y.frame = t.frame AND y.i = t.c AND y.j NOT IN (t.a, t.b)), three AS MATERIALIZED (SELECT * FROM p3 WHERE a < b AND a < c AND a < d AND {_FAR("p3", "p3.a", "p3.d")}),
    r3 AS (SELECT x.frame FROM e x JOIN e y ON y.frame = x.frame AND y.i = x.j JOIN e z ON z.frame = x.frame AND z.i = x.i AND z.j = y.j WHERE x.i < x.j AND y.i < y.j),
    q4 AS (SELECT x.frame, x.b, y.b AS d FROM two x JOIN two y ON y.frame = x.frame AND y.a = x.a AND y.c = x.c WHERE x.a < x.c AND x.a < x.b AND x.b < y.b), r4 AS (SELECT frame FROM q4 WHERE {_NOT("q4", ("q4.b", "q4.d"))}),
    q5 AS (SELECT x.frame, x.b, x.c, y.b AS f, y.c AS d FROM two x JOIN two y ON y.frame = x.frame AND y.a = x.a JOIN e w ON w.frame = x.frame AND w.i = x.c AND w.j = y.c WHERE x.c < y.c AND x.b <> y.b AND x.a < x.b AND x.a < x.c AND x.a < y.b),
    r5 AS (SELECT frame FROM q5 WHERE {_NOT("q5", ("q5.b", "q5.f"), ("q5.b", "q5.d"), ("q5.f", "q5.c"))}),
    q6 AS (SELECT x.frame, x.b, x.c, y.b AS f, y.c AS g FROM three x JOIN three y ON y.frame = x.frame AND y.a = x.a AND y.d = x.d WHERE x.b < y.b AND x.c <> y.c),
    r6 AS (SELECT frame FROM q6 WHERE {_NOT("q6", ("q6.b", "q6.f"), ("q6.c", "q6.g"))} AND {_FAR("q6", "q6.b", "q6.g")} AND {_FAR("q6", "q6.f", "q6.c")})
    {" UNION ALL ".join(f"SELECT frame, {k} AS size, count(*) AS n FROM r{k} GROUP BY frame" for k in (3, 4, 5, 6))}""")
def shortest_rings(spark, sf):
    """Rings of three to six bonds of each frame."""
    return rings.rings(_bonds(spark, sf))
