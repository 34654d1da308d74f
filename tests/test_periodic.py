"""Pairs over the faces of a cell against all images."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from granula.operators import neighbours as nb

ATOMS = "conf_id string, frame long, atom_id long, type_id int, surf int, x double, y double, z double"
REACH = 3.5


@pytest.mark.parametrize("sides", [(3.6, 3.6, 3.6), (7.1, 7.1, 7.1), (7.1, 11.0, 3.6), (25.0, 14.2, 10.6), (8.0, None, 12.0), (None, None, None)])
def test_pairs_over_faces_edges_and_corners(spark, sides):
    r = random.Random(str(sides))
    at = lambda: [r.uniform(0, s or 9.0) for s in sides]
    edge = [[0.05 if b == 0 else (s or 9.0) - 0.05 for b, s in zip(corner, sides, strict=True)] for corner in itertools.product((0, 1), repeat=3)]
    points = edge + [at() for _ in range(60)]
    rows = [("np", f, i, 1 + i % 2, i % 3 == 0, *p) for f in (0, 1) for i, p in enumerate(points)]
    atoms = spark.createDataFrame([(*x[:4], int(x[4]), *x[5:]) for x in rows], ATOMS).repartition(3)
    boxes = spark.createDataFrame([(0, *sides)], "frame long, lx double, ly double, lz double")
    got = [(p.i, p.j, round(p.d2, 9)) for p in nb.periodic_pairs(atoms, boxes, REACH, F.col("d2") <= REACH * REACH).collect()]
    want = []
    for (i, a), (j, b) in itertools.combinations(enumerate(points), 2):
        shifts = [(-s, 0, s) if s else (0,) for s in sides]
        d2 = min(sum((v - u + t) ** 2 for u, v, t in zip(a, b, shift, strict=True)) for shift in itertools.product(*shifts))
        if d2 <= REACH * REACH:
            want.append((i, j, round(d2, 9)))
    assert sorted(got) == want and len(got) == len({x[:2] for x in got})


def test_bonds_take_the_cutoff_of_their_types(spark):
    rows = [("np", 0, 0, 1, 0, 0.1, 5.0, 5.0), ("np", 0, 1, 1, 0, 9.5, 5.0, 5.0), ("np", 0, 2, 2, 1, 5.0, 0.0, 5.0), ("np", 0, 3, 2, 1, 5.0, 5.0, 5.0)]
    boxes = spark.createDataFrame([(0, 10.0, 10.0, 10.0)], "frame long, lx double, ly double, lz double")
    got = [(b.i, b.j, round(b.r, 6), round(b.dx, 6), b.ti, b.sj) for b in nb.half_bonds(spark.createDataFrame(rows, ATOMS), boxes=boxes).collect()]
    assert got == [(0, 1, 0.6, -0.6, 1, 0)] and math.isclose(got[0][2], 0.6)
    assert nb.half_bonds(spark.createDataFrame(rows, ATOMS), boxes=boxes.limit(0)).count() == 0
