"""Series, cleaning, alignment, surfaces, boxes, cases, generators and readers against plain versions."""

import functools
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.operators import alignment, boxes, cases, cleaning, generators, ranges, series, surface
from granula.operators import neighbours as nb
from granula.operators import structure as st
from granula.sources import logs, structures

ATOMS = "conf_id string, frame long, atom_id long, type_id int, surf int, x double, y double, z double"


@pytest.fixture(scope="module")
def walks(spark):
    r = random.Random(4)
    rows = []
    for key in range(3):
        v = 0.0
        for i in range(1, 90 if key else 8):
            v = 0.6 * v + r.gauss(0, 1) + (6 if i % 23 == 0 else 0)
            rows.append((key, i, v))
    return rows, spark.createDataFrame(rows, "k long, n long, v double").repartition(3)


def of(rows, key):
    return np.array([v for k, _, v in rows if k == key])


def zscore(y, lag, threshold, influence):
    """Signals from the definition: what each row's mean, deviation and filtered value are, by name."""
    filtered, signals = {}, {}

    def window(i):
        first = 0 if i == lag else i - 1 - lag
        return [filtered[j] for j in range(first, first + lag)]

    for i, v in enumerate(y):
        filtered[i] = v
        if lag <= i < len(y) - 1:
            held = window(i)
            mean = math.fsum(held) / lag
            deviation = math.sqrt(math.fsum((x - mean) ** 2 for x in held) / lag)
            if abs(v - mean) > threshold * deviation:
                signals[i + 1] = 1 if v > mean else -1
                filtered[i] = filtered[i - 1] + influence * (v - filtered[i - 1])
    return list(signals.items())


@pytest.mark.parametrize("influence", [1.0, 0.4])
def test_zscore_signals(walks, influence):
    rows, df = walks
    got = sorted(tuple(r) for r in series.zscore_signals(df, "k", "n", "v", 10, 2.0, influence).collect())
    assert got == sorted((k, i, s) for k in range(3) for i, s in zscore(of(rows, k), 10, 2.0, influence))
    assert got


def spread(y, k, h, kind, similar):
    """Peaks by filters over all rows: heights, the limit, likeness, and closeness to the peak before."""
    n = len(y)

    def height(i):
        sides = [[y[j] for j in range(n) if i - k <= j < i], [y[j] for j in range(n) if i < j < i + k]]
        part = {1: lambda s: max(y[i] - x for x in s), 2: lambda s: math.fsum(y[i] - x for x in s) / k, 3: lambda s: y[i] - math.fsum(s) / k}[kind]
        return math.fsum(map(part, sides)) / 2 if 0 < i < n - 1 else 0.0

    s = [height(i) for i in range(n)]
    up, rest = [v for v in s if v > 0], [v for v in s if v <= 0]
    dominated = statistics.fmean(rest) > -0.02 and statistics.pstdev(rest) < 0.02
    limit = max(up) * h / 20 if dominated else statistics.fmean(up) + h * statistics.pstdev(up)
    high = [i for i in range(n) if s[i] > limit]
    alone = [i for i in high if not dominated or i == high[0] or not any(abs(s[j] - s[i]) <= similar for j in range(n) if j != i and i - k <= j < i + k)]
    # The peak that stands after any number of candidates: the last kept, or the candidate that replaces it.
    kept = functools.reduce(lambda out, i: [*out, i] if not out or i >= out[-1] + k else [*out[:-1], i] if s[i] > s[out[-1]] else out, alone, [])
    return [i + 1 for i in kept]


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_spread_peaks(walks, kind):
    rows, df = walks
    got = sorted((r.k, r.n) for r in series.spread_peaks(df, "k", "n", "v", 5, 1.0, kind).collect())
    assert got == sorted((k, i) for k in range(3) for i in spread(of(rows, k), 5, 1.0, kind, 0.01))


@pytest.mark.parametrize("similar", [0.01, 2.0])
def test_spread_peaks_where_one_dominates(spark, similar):
    r = random.Random(12)
    rows = [(c, i, 9.0 * (i == 30) + 4.0 * (i in (33, 50, 52)) + 0.001 * r.random()) for c in range(3) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, n long, v double")
    got = sorted((x.k, x.n + 1) for x in series.spread_peaks(df, "k", "n", "v", 5, 1.0, 1, similar).collect())
    assert got == sorted((k, i) for k in range(3) for i in spread(of(rows, k), 5, 1.0, 1, similar))


def test_welch(walks):
    rows, df = walks
    got = {r.k: r for r in series.welch(df, "k", "n", "v", 20).collect()}
    assert set(got) == {1, 2}
    for k, r in got.items():
        y = of(rows, k)
        a, b = y[-40:-20], y[-20:]
        assert r.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 20 + b.var(ddof=1) / 20))
    # Tabulated values of Student's distribution.
    assert series.two_sided_p(np.array([2.228, 12.706, 1.96]), np.array([10.0, 1.0, 1e5])) == pytest.approx([0.05, 0.05, 0.05], abs=2e-4)


def test_early_stop(spark):
    r = random.Random(1)
    rows = [(c, f, r.random() < 0.25) for c in range(4) for f in range(30)]
    got = {(x.c, x.f): x.seen for x in series.early_stop(spark.createDataFrame(rows, "c long, f long, r boolean"), "c", "f", "r", 5).collect()}
    for c in range(4):
        streak, seen = 0, True
        for _, f, redundant in [x for x in rows if x[0] == c]:
            seen = seen and streak <= 5
            assert got[c, f] == seen
            streak = 0 if redundant else streak + 1


def test_peak_drift(spark):
    rows = [(0, p) for p in (10, 30, 52, 70)] + [(1, p) for p in (11, 32, 53, 72)] + [(2, p) for p in (11, 60)]
    got = {r.f: r.steady for r in series.peak_drift(spark.createDataFrame(rows, "f long, p long"), "f", "p", 3, 3.0).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_ranges(spark):
    values = [random.Random(2).randint(0, 400) for _ in range(900)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(5)
    place = {i: n for n, i in enumerate(sorted(range(900), key=lambda i: (values[i], i)), 1)}
    assert {r.i: r["index"] for r in ranges.dense_index(df, ["v", "i"]).collect()} == place
    got = {r.v: float(r["rank"]) for r in ranges.average_ranks(df, "v").collect()}
    assert got == {v: np.mean([place[i] for i in range(900) if values[i] == v]) for v in set(values)}


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "3.5", None, float("inf"), "x"), (2, "no", 1.0, 2.0, "y")], "a long, b string, c double, d double, TypeE string")
    assert cleaning.drop_null_columns(df).columns == ["a", "b", "d", "TypeE"]
    assert [r.d for r in cleaning.replace_infinite(df).orderBy("a").collect()] == [1000.0, 2.0]
    assert cleaning.drop_matching(df, "Type").columns == ["a", "b", "c", "d"]
    assert cleaning.drop_ordinals(df, range(1, 3)).columns == ["a", "d", "TypeE"]
    assert [r.b for r in cleaning.coerce_numeric(df, "a").orderBy("a").collect()] == [3.5, None]
    assert cleaning.rename_by_place(df.select("a", "b"), ["x", "y"], ("x",)).columns == ["y", "x"]
    assert [(r.is_x, r.is_y) for r in cleaning.one_hot(df, "TypeE", ["x", "y"]).orderBy("a").collect()] == [(1, 0), (0, 1)]
    assert cleaning.greedy_drop([("a", "b", 0.95), ("b", "c", 0.99), ("a", "c", 0.2)], {"a": 3, "b": 2, "c": 1}, 0.9) == ["b"]
    assert [r.name for r in cleaning.low_variance(df, ["a", "c"], 0.1).collect()] == ["a"]


def test_normality_tells_shapes_apart(spark):
    r = random.Random(3)
    rows = [("normal", r.gauss(0, 1)) for _ in range(500)] + [("skewed", r.expovariate(1)) for _ in range(500)]
    got = {x.g: x.p for x in cleaning.normality(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got["normal"] > 0.01 and got["skewed"] < 1e-6


def rotation(r):
    q, _ = np.linalg.qr(np.array([[r.gauss(0, 1) for _ in range(3)] for _ in range(3)]))
    return q * np.sign(np.linalg.det(q))


def aligned_rmsd(p, q):
    """The least deviation over all turns of p about its centre, by the largest eigenvalue of the quaternion matrix."""
    a, b = p - p.mean(0), q - q.mean(0)
    s = a.T @ b
    axial = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    k = np.block([[np.trace(s), axial], [axial[:, None], s + s.T - np.trace(s) * np.eye(3)]])
    moved = len(p) * ((p.mean(0) - q.mean(0)) ** 2).sum()
    return math.sqrt(max(0.0, (a * a).sum() + (b * b).sum() - 2 * np.linalg.eigvalsh(k)[-1] + moved) / (3 * len(p)))


def test_aligned_rmsd(spark):
    r = random.Random(6)
    x = np.array([[r.uniform(0, 9) for _ in range(3)] for _ in range(30)])
    frames = [x, (x - x.mean(0)) @ rotation(r) + x.mean(0), x * [1, 1, -1], np.array([[r.uniform(0, 9) for _ in range(3)] for _ in range(30)])]
    rows = [("np", f, i, 1, 0, *map(float, p)) for f, y in enumerate(frames) for i, p in enumerate(y)]
    got = {g.frame: g.rmsd for g in alignment.aligned_rmsd(spark.createDataFrame(rows, ATOMS)).collect()}
    assert got == {f: pytest.approx(aligned_rmsd(frames[f + 1], frames[f]), abs=2e-5) for f in range(3)}
    assert got[0] < 1e-4


def test_redundancy_takes_no_nan(spark):
    df = spark.createDataFrame([(0, 0.01, 0.01), (1, float("nan"), 0.01), (2, 0.01, 0.3), (3, None, 0.01)], "frame long, rmsd double, hellinger double")
    assert [r.redundant for r in alignment.redundant_frames(df, ["rmsd", "hellinger"]).orderBy("frame").collect()] == [True, False, False, False]


def block(n=3, a=4.0):
    base = [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)]
    at = [((i + u) * a, (j + v) * a, (k + w) * a) for i, j, k in itertools.product(range(n), repeat=3) for u, v, w in base]
    return [("np", 1, m + 1, 1, 0, *map(float, p)) for m, p in enumerate(at)]


def test_cone_surface(spark):
    rows = block(4)
    got = {r.atom_id: r.surface for r in surface.cone_surface(spark.createDataFrame(rows, ATOMS), block=32).collect()}
    p, limit, x = surface.sphere_points(), math.cos(math.radians(45)), np.array([r[5:] for r in rows])
    for k, r in enumerate(rows):
        d = x - x[k]
        near = d[(0 < (d * d).sum(1)) & ((d * d).sum(1) <= 2 * 3.5**2)]
        assert got[r[2]] == int(((near / np.linalg.norm(near, axis=1, keepdims=True)) @ p.T).max(0).min() < limit)
    assert 0 < sum(got.values()) < len(rows)


def test_facets_of_flat_faces(spark):
    # A square patch and its centre: a ring of four at right angles, not bent.
    at = [(0, 0, 0), (2.5, 0, 0), (-2.5, 0, 0), (0, 2.5, 0), (0, -2.5, 0), (0, 0, -3.0)]
    rows = [("np", 1, i, 2, int(i < 5), *map(float, p)) for i, p in enumerate(at)]
    atoms = spark.createDataFrame(rows, ATOMS)
    got = {r.atom_id: (r.curve, r.facet) for r in surface.curvature(atoms, nb.both_ways(nb.half_bonds(atoms))).collect()}
    assert got[0] == (0.0, 1) and len(got) == 5 and got[1][1] == 0


def fits(x, y):
    """Slope, R2 and the 95 % interval's half of every sub-range of at least six points."""
    out = {}
    for lo, hi in itertools.combinations(range(len(x) + 1), 2):
        if hi - lo > 5:
            u, v = x[lo:hi] - x[lo:hi].mean(), y[lo:hi] - y[lo:hi].mean()
            slope = u @ v / (u @ u)
            left = ((v - slope * u) ** 2).sum()
            t = {4: 2.776445, 5: 2.570582, 6: 2.446912, 7: 2.364624, 8: 2.306004}[hi - lo - 2]
            out[lo, hi] = slope, 1 - left / (v @ v), t * math.sqrt(left / (hi - lo - 2) / (u @ u))
    return out


def trimmed(table, n):
    """Read off the table: the last point goes up to and with the first fall of R2 (three digits), then the
    first until it falls; the fit before that fall counts."""
    score = lambda r: round(table[r][1], 3)
    tails = [(0, hi) for hi in range(n, 5, -1)]
    fall = next((k for k in range(1, len(tails)) if score(tails[k]) < score(tails[k - 1])), len(tails) - 1)
    path = tails[: fall + 1]
    heads = [(lo, path[-1][1] - 1) for lo in range(n) if path[-1][1] - 1 - lo > 5]
    for r in heads:
        if score(r) < score(path[-1]):
            break
        path.append(r)
    return table[path[-1]]


def test_trimmed_slope(spark):
    r = random.Random(8)
    rows = [(f, float(k), 2.2 * k + r.gauss(0, 0.3) + (f == 2) * (k > 6) * 3) for f in range(5) for k in range(10)]
    got = {g.frame: g for g in boxes.trimmed_slope(spark.createDataFrame(rows, "frame long, u double, v double"), F.col("u"), F.col("v"), F.col("u")).collect()}
    for f in range(5):
        x, y = (np.array([z[k] for z in rows if z[0] == f]) for k in (1, 2))
        slope, r2, half = trimmed(fits(x, y), 10)
        assert (got[f].dimension, got[f].r2, got[f].low, got[f].high) == pytest.approx((slope, r2, slope - half, slope + half), abs=1e-5)


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(9)
    rows = [(c, i, r.gauss(3 * (i % 3), 0.5), r.gauss(0, 0.5), i % 3) for c in range(2) for i in range(60)]
    return rows, spark.createDataFrame(rows, "c long, i long, x double, y double, g long").repartition(3)


def distances(rows, c):
    p = np.array([r[2:4] for r in rows if r[0] == c])
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))


def test_nearest_and_density(points):
    rows, df = points
    near = {(r.c, r.i, r.rank): r.other for r in cases.nearest(df, "c", "i", ["x", "y"], 4).collect()}
    peaks = {(r.c, r.i): (r.rho, r.delta) for r in cases.density_peaks(df, "c", "i", ["x", "y"], 0.7).collect()}
    for c in range(2):
        d = distances(rows, c)
        rho = np.exp(-((d / 0.7) ** 2)).sum(1) - 1
        for i in range(60):
            order = [j for j in np.argsort(d[i], kind="stable") if j != i]
            assert [near[c, i, k + 1] for k in range(4)] == order[:4]
            denser = [j for j in range(60) if rho[j] > rho[i]]
            assert peaks[c, i] == pytest.approx((rho[i], min(d[i, denser]) if denser else d[i].max()), abs=1e-5)


def test_labels_kmeans_and_scores(points):
    rows, df = points
    steps = sorted((r.c, r.step, r.i, r.distance) for r in cases.spread_labels(df, "c", "i", ["x", "y"]).collect())
    for c in range(2):
        d, done = distances(rows, c), [0]
        for _, k, i, far in steps[60 * c + 1 : 60 * c + 60]:
            left = [j for j in range(60) if j not in done]
            assert far == pytest.approx(d[np.ix_(done, left)].min(), abs=1e-5)
            done.append(i)
    got = cases.kmeans(df, "c", "i", ["x", "y"], 3).join(df, ["c", "i"]).groupBy("c", "cluster").agg(F.countDistinct("g").alias("kinds"), F.count("*").alias("n")).collect()
    assert [(r.kinds, r.n) for r in got] == [(1, 20)] * 6
    s = {r.c: r for r in cases.cluster_scores(df, "c", "g", ["x", "y"]).collect()}
    for c in range(2):
        d, g = distances(rows, c), np.arange(60) % 3
        sil = []
        for i in range(60):
            own = d[i][(g == g[i])].sum() / 19
            other = min(d[i][g == k].mean() for k in range(3) if k != g[i])
            sil.append((other - own) / max(own, other))
        assert s[c].silhouette == pytest.approx(np.mean(sil), abs=1e-5) and 0 < s[c].davies_bouldin < 1


def test_laplacian_prefers_the_structured_column(points):
    _, df = points
    got = {(r.c, r.feature): r.score for r in cases.laplacian_scores(df, "c", "i", ["x", "y"]).collect()}
    assert all(got[c, "x"] < got[c, "y"] for c in range(2))
    assert {r.c: r["at"] for r in cases.elbow(cases.laplacian_scores(df, "c", "i", ["x", "y"]), "c").collect()}.keys() == {0, 1}


def test_co_association_and_shells(spark):
    runs = spark.createDataFrame([(0, r, i, int(i < 2 + r)) for r in range(2) for i in range(4)], "c long, r long, i long, l long")
    got = {(x.a, x.b): x.share for x in cases.co_association(runs, "c", "r", "i", "l").collect()}
    assert got == {(0, 1): 1.0, (2, 3): 0.5, (0, 2): 0.5, (1, 2): 0.5}
    edges = [(0, a, b) for a, b in ((1, 2), (2, 3), (3, 4), (1, 5))]
    both = spark.createDataFrame(edges + [(c, b, a) for c, a, b in edges], "c long, i long, j long")
    assert {r.id: r.shell for r in cases.breadth_first(both, "c", most=2).collect()} == {1: 0, 2: 1, 5: 1, 3: 2}


def test_exposed_faces(spark):
    t = spark.createDataFrame([(0, 1, 2, 3, 4), (0, 5, 2, 3, 4)], "frame long, p0 long, p1 long, p2 long, p3 long")
    got = {(r.a, r.b, r.c) for r in st.exposed_faces(t).collect()}
    assert len(got) == 6 and (2, 3, 4) not in got


def test_shapes_have_their_magic_numbers(spark):
    n = lambda df: df.count()
    assert [n(generators.octahedron(spark, k, 0, 4.0)) for k in (2, 3, 4)] == [6, 19, 44]
    assert [n(generators.octahedron(spark, 2 * c + 1, c, 4.0)) for c in (1, 2)] == [13, 55]
    assert n(generators.octahedron(spark, 4, 1, 4.0)) == 38
    assert [n(generators.icosahedron(spark, k, 4.0)) for k in (1, 2, 3)] == [1, 13, 55]
    assert [n(generators.decahedron(spark, k, 4.0)) for k in (2, 3)] == [7, 23]
    assert [n(generators.tetrahedron(spark, k, 4.0)) for k in (2, 4)] == [4, 20]
    assert n(generators.cube(spark, 1, 4.0)) == 13 and n(generators.cube(spark, 2, 4.0)) == 63
    assert n(generators.rhombic_dodecahedron(spark, 2, 4.0)) == 19
    for shape in (generators.icosahedron(spark, 3, 4.0), generators.decahedron(spark, 3, 4.0), generators.tetrahedron(spark, 3, 4.0)):
        x = np.array(shape.collect())
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.eye(len(x)) * 9
        assert 0.95 * 4 / math.sqrt(2) < d.min() < 1.02 * 4 / math.sqrt(2)


def test_alloys_and_overlap(spark):
    base = generators.octahedron(spark, 5, 0, 4.0).collect()
    atoms = spark.createDataFrame([("np", 1, i, 1, 0, *p) for i, p in enumerate(base)], ATOMS)
    for df in (generators.random_alloy(atoms, "conf_id", "atom_id", 30, 5), generators.random_alloy(generators.thread_position(atoms, "conf_id"), "conf_id", "atom_id", 30, 5, "chance")):
        again = {r.atom_id: r.second for r in df.collect()}
        assert sum(again.values()) == round(0.3 * len(base)) and again == {r.atom_id: r.second for r in df.repartition(3).collect()}
    moved = generators.in_vacuum(atoms, "conf_id")
    layers = {r.y: r.second for r in generators.layered(moved, 4.0).collect()}
    assert set(layers.values()) == {0, 1} and layers[20.0] == 1 and layers[22.0] == 0
    assert max(r.chance for r in generators.radial_position(atoms, "conf_id").collect()) == 1
    core = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0)], "frame long, atom_id long, type_id int, x double, y double, z double")
    shell = spark.createDataFrame([(1, 1, 2, 1.0, 0.0, 0.0), (1, 2, 2, 3.0, 0.0, 0.0)], core.schema)
    got = generators.without_overlap(core, shell, lambda t: F.when(t == 1, F.lit(1.44)).otherwise(F.lit(1.25)), 2.9)
    assert {(r.part, r.atom_id) for r in got.collect()} == {("core", 1), ("shell", 2)}


LOG = """head
- MINIMISATION -
Per MPI rank memory allocation (min/avg/max) = 3.1 | 3.2 | 4.5 Mbytes
Step Temp PotEng
0 300 -1.5
10 301 -2.5
Loop time of 1.5 on 1 procs for 10 steps with 665 atoms
Total # of neighbors = 33613
Step Temp
0 1
Loop time of 2.5 on 1 procs
- MINIMISATION -
a b 1 2 3 4 5
Loop time of 3
"""


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    lines = logs.numbered_lines(spark, str(tmp_path / "a.log"))
    got = [(r.run, r.row, r.step, r.name, r.value) for r in logs.thermo(lines).orderBy("run", "row", "name").collect()]
    assert got[:3] == [(1, 1, 0, "PotEng", -1.5), (1, 1, 0, "Step", 0.0), (1, 1, 0, "Temp", 300.0)] and len(got) == 8
    assert [r.PotEng for r in logs.thermo_wide(lines, "Temp", "PotEng").orderBy("run", "row").collect()] == [-1.5, -2.5, None]
    assert [r.line for r in logs.energies_after(lines).orderBy("conf_id").collect()] == ["10 301 -2.5", "a b 1 2 3 4 5"]
    assert [tuple(r)[1:] for r in logs.minimised_rows(lines).where("conf_id = 1").collect()] == [(1, 1.0, 2.0, 3.0, 4.0, 5.0)]
    assert logs.energy_under(lines, "Step Temp PotEng").first().value == -1.5
    t = logs.log_totals(lines).first()
    assert (t.atoms, t.neighbours, t.memory_mb, t.seconds) == (665, 33613.0, 4.5, 1.5)


def test_tables_of_analysis(spark, tmp_path):
    (tmp_path / "r").write_text("# t\n100 2\n1 0.1 0 0\n2 0.2 3 1\n200 2\n1 0.1 5 0\n2 0.2 6 1\n")
    assert [(r.step, r.bin, r.g) for r in logs.radial_blocks(logs.numbered_lines(spark, str(tmp_path / "r"))).orderBy("step", "bin").collect()] == [(100, 1, 0.0), (100, 2, 3.0), (200, 1, 5.0), (200, 2, 6.0)]
    (tmp_path / "l").write_text("a\nb\nc\n1 0.000000\n2 0.5\n")
    assert [(r.frame, r.value) for r in logs.lindemann_table(logs.numbered_lines(spark, str(tmp_path / "l"))).collect()] == [(2, 0.5)]
    (tmp_path / "c").write_text("TITLE\n  Frame,  Type , n\n 1, Total, 5\n 2, 1, 6\n")
    assert [(r.row, r.name, r.value) for r in logs.analysis_blocks(logs.numbered_lines(spark, str(tmp_path / "c"))).orderBy("row", "name").collect()] == [(1, "Frame", "1"), (1, "Type", "Total"), (1, "n", "5"), (2, "Frame", "2"), (2, "Type", "1"), (2, "n", "6")]
    (tmp_path / "i").write_text("Au Co ! types\n\n3.5! cut\n")
    assert [(r.value, r.comment) for r in logs.control_file(logs.numbered_lines(spark, str(tmp_path / "i"))).orderBy("line_no").collect()] == [("Au Co", "types"), ("3.5", "cut")]
    (tmp_path / "b").write_text("\na\nb\n\n\nc\n")
    assert [(r.part, r.line) for r in logs.split_on_blank(logs.numbered_lines(spark, str(tmp_path / "b"))).orderBy("line_no").collect()] == [(1, "a"), (1, "b"), (2, "c")]
    (tmp_path / "p").write_text("Cu\n1 2\n3\nAg\n4 5\n6\n")
    assert [(r.element, r["values"]) for r in logs.parameter_table(logs.numbered_lines(spark, str(tmp_path / "p")), 2).orderBy("element").collect()] == [("Ag", [4.0, 5.0, 6.0]), ("Cu", [1.0, 2.0, 3.0])]
    (tmp_path / "s").write_text("c\nc\nc\n2 Au Co\n3 0.1 2 0.5 5.5\n79 1 2 fcc\n1 2\n")
    x = logs.setfl(logs.numbered_lines(spark, str(tmp_path / "s"))).first()
    assert (x.elements, x.n_rho, x.cutoff, x.numbers) == (["Au", "Co"], 3, 5.5, [79.0, 1.0, 2.0, None, 1.0, 2.0])


def test_structure_files(spark, tmp_path):
    atoms = spark.createDataFrame([("a", 1, 1, 0.0, 1.0, 2.0), ("a", 2, 2, 3.5, 4.0, 5.0)], "conf_id string, atom_id long, type_id int, x double, y double, z double")
    structures.write_data(atoms, str(tmp_path / "d"), "conf_id")
    files = [str(p) for p in (tmp_path / "d").glob("part-*")]
    got = structures.read_data(spark, *files)
    assert [tuple(r)[1:] for r in got.orderBy("atom_id").collect()] == [(1, 1, 0.0, 1.0, 2.0), (2, 2, 3.5, 4.0, 5.0)]
    h = structures.data_headers(logs.numbered_lines(spark, *files)).where("atoms is not null").first()
    assert (h.atoms, h.types, h.xlo, h.xhi, h.zhi) == (2, 2, 0.0, 3.5, 5.0)
    (tmp_path / "dump").write_text("ITEM: TIMESTEP\n50\nITEM: NUMBER OF ATOMS\n1\nITEM: ATOMS id type x\n7 1 0.5\n")
    assert [(r.step, r.atom_id, r.name, r.value) for r in structures.read_dump(spark, str(tmp_path / "dump")).where("name = 'x'").collect()] == [(50, 7, "x", "0.5")]
    (tmp_path / "x.7.xyz").write_text("1\nc\n12 9 Au 1 2 3\n")
    assert [tuple(r)[1:] for r in structures.read_last_tokens(spark, str(tmp_path / "x.7.xyz")).collect()] == [(1, "Au", 1.0, 2.0, 3.0)]
    found = structures.snapshots(spark, str(tmp_path))
    assert [r.number for r in found.collect()] == [7]
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r.name for r in structures.missing_or_empty(names, spark.createDataFrame([("a", 3), ("b", 0)], "name string, length long")).collect()] == ["b"]
    assert {(r.a, r.b): r.cutoff for r in structures.cutoff_matrix(spark, {("Au", "Co"): 3.4}).collect()} == {("Au", "Co"): 3.4, ("Co", "Au"): 3.4}
