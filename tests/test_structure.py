import itertools
import math
import random

import numpy as np
import pytest

from granula.operators import graph, structure as st
from granula.operators import neighbours as nb

ATOMS = "conf_id string, frame long, atom_id long, type_id int, surf int, x double, y double, z double"


def block(n=3, a=4.0):
    """Face-centred cubic block with nearest distance a / sqrt 2 = 2.83."""
    base = [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)]
    at = [((i + u) * a, (j + v) * a, (k + w) * a) for i, j, k in itertools.product(range(n), repeat=3) for u, v, w in base]
    return [("np", 1, m + 1, 1, 0, *p) for m, p in enumerate(at)]


def test_fcc_interior(spark):
    atoms = spark.createDataFrame(block(), ATOMS)
    bonds = nb.both_ways(nb.half_bonds(atoms))
    cn = {r.atom_id: r.cn for r in st.coordination(atoms, bonds).collect()}
    assert max(cn.values()) == 12
    g = {r.atom_id: r.gcn for r in st.generalised(atoms, bonds).collect()}
    assert max(g.values()) <= 12
    inner = st.bond_order(atoms, bonds).agg({"q6q6": "max"}).first()[0]
    assert inner >= 10


def test_bonds_match_all_pairs(spark):
    rows = block(2)
    atoms = spark.createDataFrame(rows, ATOMS)
    want = {(p[2], q[2]) for p, q in itertools.combinations(rows, 2) if math.dist(p[5:], q[5:]) <= 3.5}
    half = nb.half_bonds(atoms)
    assert {(r.i, r.j) for r in half.collect()} == want
    plan = half._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_right_angle_and_chain(spark):
    at = [(0, 0, 0), (3, 0, 0), (0, 3, 0)]
    atoms = spark.createDataFrame([("np", 1, i + 1, 1, 0, *map(float, p)) for i, p in enumerate(at)], ATOMS)
    bonds = nb.both_ways(nb.half_bonds(atoms))
    assert [r.bin for r in st.first_shell_angles(bonds).collect()] == [90]
    line = spark.createDataFrame([("np", 1, i + 1, 1, 0, 3.0 * i, 0.0, 0.0) for i in range(5)], ATOMS)
    rows = graph.chains(nb.both_ways(nb.half_bonds(line))).collect()
    assert [(r.length, r.n) for r in rows] == [(3, 1)]


def test_clusters(spark):
    at = [(0, 0, 0), (3, 0, 0), (20, 0, 0)]
    atoms = spark.createDataFrame([("np", 1, i + 1, 1, 0, *map(float, p)) for i, p in enumerate(at)], ATOMS)
    got = {r.atom_id: r.cluster for r in graph.clusters(atoms, nb.half_bonds(atoms)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("deg", [60, 180, 0])
def test_torsion_counts_both_halves_at_0_and_180(spark, deg):
    t = math.radians(deg)
    at = [(1.0, 2.5, 0.0), (1.0, 0.0, 0.0), (1.0, 0.0, 2.6), (1.0 + 2.5 * math.sin(t), 2.5 * math.cos(t), 2.6)]
    e = [(1, 2), (2, 3), (3, 4)]
    rows = []
    for a, b in e + [(b, a) for a, b in e]:
        d = [q - p for p, q in zip(at[a - 1], at[b - 1])]
        rows.append((1, a, b, 1, 1, 0, 0, *d, math.hypot(*d)))
    bonds = spark.createDataFrame(rows, "frame long, i long, j long, ti int, tj int, si int, sj int, dx double, dy double, dz double, r double")
    got = {(r.half, abs(r.bin)): r.n for r in st.torsions(bonds).collect()}
    assert set(k[1] for k in got) == {deg}
    assert sum(got.values()) == (4 if deg in (0, 180) else 2)


def test_lindemann_has_all_partners(spark):
    r = random.Random(2)
    at = {(f, i): [r.uniform(0, 9) for _ in range(3)] for f in range(3) for i in range(1, 46)}
    atoms = spark.createDataFrame([("np", f, i, 1, 0, *p) for (f, i), p in at.items()], ATOMS)
    got = {x.atom_id: x.lindemann for x in st.lindemann(atoms).collect()}
    assert len(got) == 45
    for i in got:
        v = []
        for j in range(1, 46):
            d = [math.dist(at[f, i], at[f, j]) for f in range(3)]
            if j != i:
                v.append(math.sqrt(max(0, sum(x * x for x in d) / 3 - (sum(d) / 3) ** 2)) / (sum(d) / 3))
        assert got[i] == pytest.approx(sum(v) / 44, abs=1e-5)


def test_xyz_round_trip(spark, tmp_path):
    from granula.sources.xyz import read_xyz, write_xyz

    (tmp_path / "a.xyz").write_text("2\nfirst\nAu 0 0 0 1\nCo 1.5 0 0 0\n 1 \nsecond\nAu 1 2 3\n")
    got = read_xyz(spark, str(tmp_path / "a.xyz"))
    assert [(r.frame, r.element, r.x, r.surf) for r in got.orderBy("frame", "atom_id").collect()] == [(1, "Au", 0.0, 1), (1, "Co", 1.5, 0), (2, "Au", 1.0, None)]
    write_xyz(got, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value like '%second%'").count() == 1


def test_lindemann_over_gaps(spark):
    r = np.random.default_rng(5)
    assert st._as_slices(np.array([2, 3, 4]), np.array([0, 1])) == (slice(2, 5), slice(0, 2))
    assert all(not isinstance(c, slice) for rows in ([0, 2], [0, 0, 2], []) for c in st._as_slices(np.array(rows, int), np.array([0, 1])))
    at = {(f, i): r.normal(size=3) for f in range(6) for i in range(9) if f % 2 or i not in (0, 4)}
    rows = [("a", f, i, *map(float, x)) for (f, i), x in at.items()]
    atoms = spark.createDataFrame(rows, "conf_id string, frame long, atom_id long, x double, y double, z double")

    def want(i, frames):
        out = []
        for j in range(9):
            d = np.array([np.linalg.norm(at[f, i] - at[f, j]) for f in frames if i != j and (f, i) in at and (f, j) in at])
            if len(d):
                out.append(d.std() / d.mean())
        return round(sum(out) / len(out), 6) if out else None

    for window, spans in ((None, {0: range(6)}), (1, {f: range(f - 1, f + 2) for f in range(1, 5)})):
        got = {(x["frame"] if window else 0, x.atom_id): x.lindemann for x in st.lindemann(atoms, window, 4).collect()}
        expected = {(f, i): want(i, span) for f, span in spans.items() for i in range(9)}
        assert got.keys() == {k for k, v in expected.items() if v is not None}
        assert all(abs(got[k] - expected[k]) < 2e-6 for k in got)
