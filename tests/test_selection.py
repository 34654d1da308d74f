"""Selectivity, consensus clusters and forward selection against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.operators import consensus, selection, selectivity

GRID = {"low": 1.0, "end": 5.0, "step": 0.02}
LINES = [(1.0, -1.0), (-0.5, 2.5)]


def simpson(y, h):
    """Parabolas over pairs of intervals; the odd interval by the trapezoid rule, first and last in turn."""
    pairs = lambda v: math.fsum(h / 3 * (v[i] + 4 * v[i + 1] + v[i + 2]) for i in range(0, len(v) - 2, 2))
    if len(y) % 2:
        return pairs(y)
    return (pairs(y[:-1]) + h * (y[-2] + y[-1]) / 2 + pairs(y[1:]) + h * (y[0] + y[1]) / 2) / 2


@pytest.mark.parametrize("n", [5, 6, 11, 12])
def test_simpson_weights(spark, n):
    y = [random.Random(n).random() for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(y)), "k int, y double")
    got = rows.agg(F.sum(F.col("y") * selectivity.simpson_weight(F.col("k"), n, 0.5))).first()[0]
    assert got == pytest.approx(simpson(y, 0.5))


def test_selectivity(spark):
    r = random.Random(1)
    groups = {"inside": [r.gauss(2.4, 0.2) for _ in range(50)], "wide": [r.uniform(1, 5) for _ in range(40)], "ties": [2.0, 2.0, 2.5, 3.0], "far": [4.9 + 0.001 * i for i in range(5)], "flat": [2.0] * 4}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("wide", None), ("ties", float("nan"))]
    x = np.arange(selectivity.grid_points(**GRID)) * 0.02 + 1
    v = np.min([a * x + b for a, b in LINES], 0)
    q = (v - v.min()) / (v.max() - v.min())
    q = q / simpson(q, 0.02)
    curve = selectivity.activity_curve(spark, LINES, **GRID)
    assert np.allclose([c.q for c in curve.orderBy("k").collect()], q)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {s.g: s for s in selectivity.selectivity(selectivity.densities(df, "g", "v", **GRID), curve, "g", high=4.0, **GRID).collect()}
    assert "flat" not in got
    for k, vs in groups.items():
        if k == "flat":
            continue
        q1, q3 = np.percentile(vs, [25, 75])
        w = min(np.std(vs, ddof=1), (q3 - q1) / 1.3489795003921634) * (len(vs) * 3 / 4) ** -0.2
        p = sum(np.exp(-(((x - a) / w) ** 2) / 2) for a in vs) / (len(vs) * w * math.sqrt(2 * math.pi))
        o, at = np.minimum(p, q)[(p != 0) & (q != 0)], x[(p != 0) & (q != 0)]
        wide = at[o > o.max() / 2]
        full = x[q > q.max() / 2]
        ratio = (wide[-1] - wide[0]) / (full[-1] - full[0])
        spec = 1 - ratio / 2 if wide[0] > full[0] and wide[-1] < full[-1] else ratio / 2
        want = (1 - abs(x[p.argmax()] - x[q.argmax()]) / 3, spec, simpson(p * q, 0.02))
        assert (got[k].selectivity, got[k].specificity, got[k].sensitivity) == pytest.approx(want, abs=1e-9), k


def test_no_overlap(spark):
    density = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.0), ("a", 2, 0.0)], "g string, k int, p double")
    curve = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 1.0)], "k long, x double, q double")
    s = selectivity.selectivity(density, curve, "g", low=0.0, high=2.0, end=2.0, step=1.0).first()
    assert (s.selectivity, s.specificity, s.sensitivity) == (0.0, 0.0, 0.0)


def clusters_of(vectors, most):
    """Merge the two nearest clusters, by the mean over all pairs of their points, until none are left; then cut."""
    apart = lambda u, v: sum(a != b for a, b in zip(u, v, strict=True)) / len(u)
    groups, steps = [[i] for i in range(len(vectors))], []
    states = [(0.0, [list(g) for g in groups])]
    while len(groups) > 1:
        mean = lambda a, b: round(sum(apart(vectors[i], vectors[j]) for i in a for j in b) / (len(a) * len(b)), 12)
        height, a, b = min((mean(groups[a], groups[b]), a, b) for a, b in itertools.combinations(range(len(groups)), 2))
        groups[a] += groups.pop(b)
        groups.sort(key=min)
        steps.append(height)
        states.append((height, [list(g) for g in groups]))
    # After all merges of a height: the first state with few enough clusters.
    for k, (h, g) in enumerate(states):
        last = k + 1 == len(states) or round(states[k + 1][0], 9) != round(h, 9) if k else not steps or round(steps[0], 9) > 0
        if last and len(g) <= most:
            return {i: number for number, members in enumerate(sorted(g, key=min), 1) for i in members}
    raise AssertionError


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_consensus(spark, most):
    r = random.Random(most)
    rows, vectors = [], {}
    for case in range(4):
        labels = [[r.randrange(3) for _ in range(4)] for _ in range(12)]
        points = [labels[r.randrange(12)] if r.random() < 0.6 else [r.randrange(2) for _ in range(4)] for _ in range(18)]
        vectors[case] = points
        rows += [(case, i, f"r{k}", v) for i, p in enumerate(points) for k, v in enumerate(p)]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "c long, i long, run string, label long").repartition(3)
    got = {}
    for x in consensus.consensus(df, "c", "i", "run", "label", most).collect():
        got.setdefault(x.c, {})[x.i] = x.cluster
    assert got == {c: clusters_of(v, most) for c, v in vectors.items()}


def test_consensus_takes_a_missing_label_for_one_of_its_own(spark):
    rows = [(1, 1, "a", 0), (1, 1, "b", 0), (1, 2, "a", 0), (1, 3, "a", 0), (1, 4, "a", 1), (1, 4, "b", 0)]
    got = {x.i: x.cluster for x in consensus.consensus(spark.createDataFrame(rows, "c long, i long, run string, label long"), "c", "i", "run", "label", 3).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3}
    assert consensus.consensus(spark.createDataFrame([], "c long, i long, run string, label long"), "c", "i", "run", "label", 3).count() == 0


def test_forward_selection(spark):
    r = random.Random(3)
    rows = []
    for _ in range(400):
        a, b = r.randrange(4), r.randrange(3)
        rows.append((a, a if r.random() < 0.9 else 0, b, r.randrange(5), None if r.random() < 0.1 else (a + b) % 3, 2 * a + (b > 1)))
    names = ["a", "copy", "b", "noise", "mixed", "target"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))

    def information(x, y):
        pairs = [(row[x], row[y]) for row in rows if row[x] is not None and row[y] is not None]
        p = lambda f: sum(map(f, pairs)) / len(pairs)
        return math.fsum(p(lambda z: z == c) * math.log(p(lambda z: z == c) / p(lambda z: z[0] == c[0]) / p(lambda z: z[1] == c[1])) for c in set(pairs))

    got = {(x.a, x.b): x.mi for x in selection.pairwise_information(df, names).collect()}
    assert got == {(names[i], names[j]): pytest.approx(information(i, j), abs=1e-8) for i, j in itertools.combinations(range(6), 2)}
    left, picked = list(range(5)), []
    while left:
        score = {i: information(i, 5) - (sum(information(i, j) for j in picked) / len(picked) if picked else 0) for i in left}
        best = max(left, key=lambda i: (round(score[i], 9), -i))
        if score[best] <= 0:
            break
        picked.append(best)
        left.remove(best)
    out = selection.forward_selection(df, names[:5], "target").orderBy("rank").collect()
    assert [x.feature for x in out] == [names[i] for i in picked] and len(picked) > 1
    assert selection.forward_selection(df, names[:5], "target", 1).count() == 1
