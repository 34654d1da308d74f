"""Result files, global order, partial numbers, cluster tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.operators import neighbours as nb
from granula.operators import structure as st
from granula.sources import results, xyz

ATOMS = "conf_id string, frame long, atom_id long, type_id int, surf int, x double, y double, z double"


def test_mdout(spark, tmp_path):
    path = str(tmp_path / "MDout.csv")
    rows = spark.createDataFrame([("000001", 300.0, 1.0, -5.0, 2.0, -3.0), ("000002", 310.0, None, -6.0, 2.0, -4.0)], results.MDOUT)
    results.append_mdout(rows, path)
    results.append_mdout(rows.where("conf_id = '000001'").unionByName(rows.where("conf_id = '000001'")), path)
    assert sorted(map(tuple, results.read_mdout(spark, path).collect())) == [("000001", 300.0, 1.0, -5.0, 2.0, -3.0), ("000002", 310.0, None, -6.0, 2.0, -4.0)]


def test_analysis(spark, tmp_path):
    results.write_analysis({"od_A": spark.range(3), "od_B": spark.range(2).withColumn("a", F.array("id", "id"))}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "od_A.csv")).count() == 3
    assert {r.a for r in spark.read.option("header", True).csv(str(tmp_path / "od_B.csv")).collect()} == {"[0,0]", "[1,1]"}


@pytest.fixture(scope="module")
def structure(spark):
    rows = [("p", 1, "c", 1, "Au", 0.0, 0.0, 0.0), ("p", 1, "c", 2, "Co", 1.0, 0.0, 0.0), ("p", 2, "d", 1, "Au", 5.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "path string, frame int, comment string, atom_id int, element string, x double, y double, z double")


def test_clusters_and_boxes_as_structures(spark, structure, tmp_path):
    labels = spark.createDataFrame([(1, 1, 7), (2, 1, 8)], "frame int, atom_id int, cluster int")
    results.write_clusters(structure, labels, str(tmp_path / "c"))
    got = {(r.comment, r.atom_id, r.surf) for r in xyz.read_xyz(spark, str(tmp_path / "c")).collect()}
    assert got == {("c", 1, 7), ("c", 2, None), ("d", 1, 8)}
    boxes = spark.createDataFrame([("p", 1, 9.0, 9.0, 9.0, "bulk"), ("p", 1, 8.0, 9.0, 9.0, "surface"), ("p", 5, 1.0, 1.0, 1.0, "bulk")], "path string, frame int, x double, y double, z double, kind string")
    both = results.with_boxes(structure, boxes, F.col("kind")).collect()
    assert sorted((r.frame, r.atom_id, r.element) for r in both) == [(1, 1, "Au"), (1, 2, "Co"), (1, 3, "H"), (1, 4, "He"), (2, 1, "Au")]


def test_global_order_by_the_addition_theorem(spark):
    r = random.Random(2)
    rows = [("np", f, i, 1, 0, *(r.uniform(0, 6) for _ in range(3))) for f in range(2) for i in range(40)]
    half = nb.half_bonds(spark.createDataFrame(rows, ATOMS)).cache()
    got = {(q.frame, q.l): q.q for q in st.global_order(half).collect()}
    for f in range(2):
        u = np.array([(b.dx, b.dy, b.dz) for b in half.where(F.col("frame") == f).collect()])
        u /= np.linalg.norm(u, axis=1)[:, None]
        u = np.r_[u, -u]
        cos = np.clip(u @ u.T, -1, 1)
        for l in range(13):  # noqa: E741
            want = math.sqrt(max(0.0, np.polynomial.legendre.legval(cos, [0] * l + [1]).mean()))
            assert got[f, l] == pytest.approx(want, abs=3e-6 if l % 2 == 0 else 1e-6)
    cube = [("np", 0, k, 1, 0, *p) for k, p in enumerate([(0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (0.0, 3.0, 0.0), (0.0, 0.0, 3.0)])]
    known = {q.l: q.q for q in st.global_order(nb.half_bonds(spark.createDataFrame(cube, ATOMS))).collect()}
    assert known[0] == 1 and known[2] == 0 and known[4] == pytest.approx(0.763763, abs=1e-6) and known[6] == pytest.approx(0.353553, abs=1e-6)


def test_partial_numbers(spark):
    r = random.Random(5)
    rows = [("np", 0, i, 1 + i % 2, 0, *(r.uniform(0, 7) for _ in range(3))) for i in range(50)] + [("np", 0, 99, 1, 0, 90.0, 90.0, 90.0)]
    atoms = spark.createDataFrame(rows, ATOMS)
    bonds = nb.both_ways(nb.half_bonds(atoms)).cache()
    near = {}
    for b in bonds.collect():
        near.setdefault(b.i, []).append((b.j, f"{min(b.ti, b.tj)}{max(b.ti, b.tj)}"))
    got = {g.atom_id: (g.gcn11, g.gcn12, g.gcn22) for g in st.generalised_partial(atoms, bonds).collect()}
    for row in rows:
        want = tuple(sum(p == q for j, _ in near.get(row[2], []) for _, q in near[j]) / 12 for p in ("11", "12", "22"))
        assert got[row[2]] == pytest.approx(want, abs=1e-6)


def test_cluster_table_and_joins(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 4), (1, 5, 4), (2, 1, 1)], "frame int, atom_id int, cluster int")
    cn = spark.createDataFrame([(1, k, 2 * k) for k in range(1, 6)] + [(2, 1, 0)], "frame int, atom_id int, cn int")
    table = lambda **k: sorted(tuple(r) for r in st.cluster_table(labels, cn, **k).collect())
    assert table() == [(1, 1, 2, 3.0), (1, 3, 1, 6.0), (1, 4, 2, 9.0), (2, 1, 1, 0.0)]
    assert table(least=2) == [(1, 1, 2, 3.0), (1, 4, 2, 9.0)]
    assert table(largest_only=True) == [(1, 1, 2, 3.0), (2, 1, 1, 0.0)]
    types = spark.createDataFrame([(1, "Au")], "type_id int, element string")
    assert {(r.type_id, r.element) for r in st.named_types(spark.createDataFrame([(1,), (2,)], "type_id int"), types).collect()} == {(1, "Au"), (2, None)}
    names = spark.createDataFrame([("AuPt", "Pt20"), ("AuPt", "Au20"), ("CoPt", "Pt20")], "d string, n string")
    assert [tuple(r) for r in results.of_elements(names, "d", "n", "Au", "Pt").collect()] == [("AuPt", "Pt20")]
    points = spark.createDataFrame([(1, 5), (2, 6)], "id int, cluster int")
    scores = spark.createDataFrame([(1, 0.5, 9)], "id int, gamma double, cluster int")
    assert sorted(tuple(r) for r in st.labelled(points, scores, ["id"]).collect()) == [(1, 5, 0.5), (2, 6, None)]
