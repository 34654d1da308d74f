"""Angles along bonds are counted where the frame is, by arrays that hold a bounded number of paths."""

import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from granula.operators import dataset, paths, surface
from granula.operators import neighbours as nb
from granula.operators import structure as st

SF = "/root/testdata/sf0.001"
SCHEMA = "frame long, i long, j long, ti int, tj int, si int, sj int, dx double, dy double, dz double, r double"


def some_bonds(frame, n, reach, seed):
    r = random.Random(seed)
    at = [(r.uniform(0, 6), r.uniform(0, 6), r.uniform(0, 6), r.randint(1, 3)) for _ in range(n)] + [(0.0, 0.0, 0.0, 1), (0.0, 0.0, 0.0, 2)]
    out = []
    for i, j in itertools.permutations(range(len(at)), 2):
        d = [at[j][k] - at[i][k] for k in range(3)]
        if math.hypot(*d) <= reach:
            out.append((frame, i + 1, j + 1, at[i][3], at[j][3], 1, 1, *d, math.hypot(*d)))
    return out


@pytest.mark.parametrize("name", ["torsion", "torsion_partials"])
def test_paths_are_no_rows(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"ShuffledHashJoin \[", plan)) == 1


@pytest.mark.parametrize("block", [1, 50, 1 << 18])
def test_dihedrals_one_by_one(spark, block, monkeypatch):
    monkeypatch.setattr(paths, "_BLOCK", block)
    rows = some_bonds(1, 30, 2.2, 5) + some_bonds(2, 2, 20, 6)
    want = Counter()
    unit = {(f, i, j): [x / r for x in d] for f, i, j, *_, a, b, c, r in rows for d in [(a, b, c)] if r > 0}
    types = {(f, i): t for f, i, _, t, *_ in rows}
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
    flat = lambda p: abs(p[0]) < 0.1 and abs(p[1]) <= 0.1 and abs(p[2]) <= 0.1
    for (f, i, j), (g, k, l) in itertools.product(unit, unit):
        if f != g or (f, j, k) not in unit or len({i, j, k}) < 3 or l in (i, j, k):
            continue
        b = unit[f, j, k]
        n, q = cross(unit[f, i, j], b), cross(b, unit[g, k, l])
        if not flat(n) and not flat(q):
            deg = round(math.degrees(math.atan2(dot(cross(n, b), q), dot(n, q))), 6)
            bin_ = int(math.copysign(math.floor(abs(deg) + 0.5), deg))
            for half in {0: ("neg", "pos"), 180: ("neg", "pos")}.get(abs(bin_), ("neg" if bin_ < 0 else "pos",)):
                want[f, tuple(types[f, x] for x in (i, j, k, l)), half, -abs(bin_) if half == "neg" else abs(bin_)] += 1
    df = spark.createDataFrame(rows, SCHEMA)
    hist = Counter()
    for (f, _, half, b), n in want.items():
        hist[f, half, b] += n
    assert len({f for f, *_ in hist}) == 2
    assert {(x.frame, x.half, x.bin): x.n for x in st.torsions(df).collect()} == hist
    for x in st.torsion_statistics(df).collect():
        c = Counter()
        for (f, t, half, b), n in want.items():
            if (f, half) == (x.frame, x.half) and (x.ti is None or t == (x.ti, x.tj, x.tk, x.tl)):
                c[b] += n
        n = sum(c.values())
        mean = sum(b * m for b, m in c.items()) / n
        assert (x.n, x.max_deg, x.min_deg) == (n, max(c), min(c))
        assert x.avg_deg == pytest.approx(mean, abs=1e-6) and x.std_deg == pytest.approx(math.sqrt(sum(m * (b - mean) ** 2 for b, m in c.items()) / n), abs=1e-5)


@pytest.mark.parametrize("name,looks", [("dataset_long", 1), ("dataset_wide", 1), ("dataset_published", 2)])
def test_features_find_their_bonds_once(spark, name, looks):
    """Once for all groups but facets and curvature, which come from one look of their own."""
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"HashJoin \[frame#\w+, cell#", plan)) == looks


def test_frames_without_bonds_have_features(spark):
    atoms = spark.createDataFrame([(1, 1, 1, 1, 0.0, 0.0, 0.0), (1, 2, 2, 0, 9.0, 0.0, 0.0), (2, 1, 1, 1, 0.0, 0.0, 0.0), (2, 5, 1, 1, 3.0, 0.0, 0.0), (2, 7, 3, 0, 0.0, 9.0, 0.0)], "frame long, atom_id long, type_id int, surf int, x double, y double, z double")
    got = {(r.frame, r.feature): r.value for r in dataset.bond_features(atoms, nb.half_bonds(atoms)).collect()}
    one = {k: v for (f, k), v in got.items() if f == 1}
    assert one["MM_TCN_0"] == 2 and one["Ele1M_SCN_0"] == one["Ele2M_BGCN_0"] == one["MM_SOCN_0"] == one["q6q6_S_0"] == 1 and one["MM_TCN_avg"] == 0
    assert not [k for k in one if "_BL_" in k or "_BA" in k or "_BT" in k or k == "N_bond"]
    two = {k: v for (f, k), v in got.items() if f == 2}
    assert two["N_bond"] == 1 and two["MM_BL_avg"] == two["Ele1Ele1_BL_max"] == 3 and two["Ele1Ele1_frac"] == 1 and two["MM_BL_std"] == 0
    assert two["MM_TCN_1"] == 2 and two["Ele3M_BCN_0"] == 1 and two["Ele1M_SOGCN_1"] == 2 and two["MM_SOGCN_avg"] == 1 and two["MM_TGCN_avg"] == round(2 / 12 / 3, 6)


@pytest.mark.parametrize("cone,points", [(45.0, 3000), (30.0, 500), (70.0, 130)])
def test_exposed_point_by_point(cone, points):
    r = np.random.default_rng(int(cone))
    count = r.integers(1, 60, 400)
    u = r.normal(size=(count.sum(), 3))
    u[:6] = [[1, 0, 0], [0, -1, 0], [0, 0, 1], [1, 1, 0], [1, 1, 1], [-1, 1, -1]]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    start = np.cumsum(count) - count
    dot = u @ surface.sphere_points(points).T
    want = np.maximum.reduceat(dot, start, axis=0).min(1) < np.cos(np.radians(cone))
    assert (surface._exposed(u, start, cone, points) == want).all() and 0 < want.sum() < 400
    # What cells say of a direction holds for it.
    surely, possibly = (np.unpackbits(b[surface._cells(u)].view(np.uint8), axis=1)[:, :points] > 0 for b in surface._reached(cone, points))
    near = dot >= np.cos(np.radians(cone))
    assert (near | ~surely).all() and (possibly | ~near).all() and surely.sum() > 0.5 * near.sum()
