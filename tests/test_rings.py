"""Rings against all cycles of small graphs."""

import collections
import itertools
import random

import numpy as np
import pytest

from granula.operators import paths, rings


def plain(edges):
    """Sizes of cycles of three to six in which no two atoms are nearer by bonds than along the cycle."""
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    far = {}
    for s in near:
        far[s], front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in near[x] if far[s].setdefault(y, far[s][x] + 1) == far[s][x] + 1 and y not in front]
    found = collections.Counter()

    def walk(path):
        for y in near[path[-1]]:
            if y == path[0] and len(path) > 2 and path[1] < path[-1]:
                k = len(path)
                found[k] += all(far[path[i]][path[j]] == min(j - i, k - j + i) for i, j in itertools.combinations(range(k), 2))
            elif y > path[0] and y not in path and len(path) < 6:
                walk([*path, y])

    for s in sorted(near):
        walk([s])
    return {k: n for k, n in found.items() if n}


def both(frame, edges):
    return [(frame, a, b) for a, b in edges] + [(frame, b, a) for a, b in edges]


def lattice(cells, vectors, reach):
    points = [tuple(sum(n * v[k] for n, v in zip(at, vectors["cell"], strict=True)) + s[k] for k in range(3)) for at in itertools.product(*map(range, cells)) for s in vectors["base"]]
    return [(i, j) for (i, p), (j, q) in itertools.combinations(enumerate(points), 2) if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) < reach**2]


def test_rings(spark):
    root = 3**0.5
    sheet = lattice((3, 3, 1), {"cell": [(1.5, root / 2, 0), (1.5, -root / 2, 0), (0, 0, 1)], "base": [(0, 0, 0), (1, 0, 0)]}, 1.1)
    fcc = lattice((2, 2, 2), {"cell": [(1, 0, 0), (0, 1, 0), (0, 0, 1)], "base": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]}, 0.75)
    r = random.Random(4)
    graphs = [sheet, fcc, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (0, 3)], *[[e for e in itertools.combinations(range(14), 2) if r.random() < p] for p in (0.15, 0.25, 0.4)]]
    rows = [x for f, edges in enumerate(graphs) for x in both(f, edges)] + [(0, 1, 1), (1, 0, 1)] * 1
    got = collections.defaultdict(dict)
    for x in rings.rings(spark.createDataFrame(rows, "frame long, i long, j long")).collect():
        got[x.frame][x.size] = x.n
    want = {f: plain(edges) for f, edges in enumerate(graphs)}
    assert dict(got) == {f: w for f, w in want.items() if w}
    assert want[0] == {6: 4} and want[2] == {4: 2}
    assert want[1][3] > 50


@pytest.mark.parametrize("block,table", [(1, 0), (40, 1 << 26), (1 << 18, 0)])
def test_rings_by_blocks(block, table, monkeypatch):
    monkeypatch.setattr(paths, "_BLOCK", block)
    monkeypatch.setattr(rings, "_TABLE", table)
    r = random.Random(7)
    for p in (0.0, 0.1, 0.2, 0.3):
        edges = [(10 * a + 3, 10 * b + 3) for a, b in itertools.combinations(range(16), 2) if r.random() < p] + [(3, 3)]
        i, j = (np.array(x) for x in zip(*[e for a, b in edges for e in ((a, b), (b, a), (a, b))], strict=True))
        assert {k: n for k, n in rings._count(i, j).items() if n} == plain([e for e in edges if e[0] != e[1]])


def test_ring_paths_are_no_rows(spark):
    plan = rings.rings(spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "frame long, i long, j long"))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
