"""Atoms stay where they are dealt by frame: bonds and paths cross no shuffle of their own."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from granula.operators import cases, cleaning, ranges, selectivity, surface
from granula.plans import features

SF = "/root/testdata/sf0.001"
NAMES = ["angle_g3_2", "angle_g3_2_normalised", "angle_g3_normalised", "angle_g3_partial", "bonds_periodic", "chains", "q6_connectivity", "q6_histogram", "coord_hist", "coord_scope_avg", "gcn",
         "cone_surface", "torsion", "torsion_partials", "global_order", "curve_rebins", "angle_g3", "gcn_partial", "atom_angles", "per_atom_bond_stats", "facets", "curvature_histogram"]


def shuffle_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [[k.strip().split("#")[0] for k in keys.split(",")[:-1]] for keys in re.findall(r"Exchange hashpartitioning\((.*?)\), ", plan)]


@pytest.mark.parametrize("name", NAMES)
def test_bonds_cross_no_shuffle(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    keys = shuffle_keys(entry.queries()[name](spark, SF))
    assert keys and all(k[0] == "frame" and not {"cell", "kx", "i", "j", "k", "atom_id"} & set(k) for k in keys), keys


def test_rings_stay_in_their_frames(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    df = entry.queries()["shortest_rings"](spark, SF)
    keys = shuffle_keys(df)
    assert keys and all(k == ["frame"] for k in keys), keys
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Scan ExistingRDD" not in plan


def test_other_queries_plan_as_before(spark):
    queries = entry.queries()
    queries["atoms_counts"](spark, SF)
    assert spark.conf.get(entry._ALL_KEYS) == "false"
    queries["op10_mixing"](spark, SF)
    assert spark.conf.get(entry._ALL_KEYS) == "true"


def test_densities_and_moved_copies_stay_too(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    keys = shuffle_keys(entry.queries()["reaction_selectivity"](spark, SF))
    assert keys and all(k == ["frame"] for k in keys), keys


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_first_of_a_row_as_a_stable_sort(n):
    r = np.random.default_rng(n)
    d = r.integers(0, 5, (n, n)).astype(float)
    for k in range(1, min(n, 6) + 1):
        assert (cases._first(d, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()


def test_quantiles_meet_in_no_task(spark):
    rows = spark.createDataFrame([(float(i * i % 37),) for i in range(500)] + [(None,)], "v double")
    q = {"a": 0.25, "b": 0.5, "c": 0.9}
    want = rows.agg(*[F.percentile("v", p).alias(k) for k, p in q.items()]).first()
    assert ranges.quantiles(rows, "v", q).first() == want
    assert "percentile" not in cleaning.scale(rows, ["v"], "robust")._jdf.queryExecution().executedPlan().toString()
    assert ranges.quantiles(rows.where("v < 0"), "v", q).first().a is None


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9])
def test_rings_of_a_size_bend_at_once(n):
    r = np.random.default_rng(n)
    turn = np.arange(n) * 2 * np.pi / n
    u = np.concatenate([r.normal(size=(30, n, 3)), np.stack([np.cos(turn), np.sin(turn), 0 * turn], 1) + r.normal(size=(30, n, 3)) * 0.05])
    u /= np.linalg.norm(u, axis=2, keepdims=True)
    inward = r.normal(size=(60, 3))
    angles, curves = surface._bend(u, inward)
    for k in range(60):
        order, left = [0], list(range(1, n))
        while left:
            order.append(left.pop(int(np.argmax(u[k][left] @ u[k][order[-1]]))))
        v = u[k][order]
        w = np.roll(v, -1, 0)
        assert np.allclose(angles[k], np.degrees(np.arccos(np.clip((v * w).sum(1), -1, 1))))
        if n > 2:
            normals = np.cross(v, w)
            normals *= np.where(normals @ inward[k] > 0, -1, 1)[:, None] / np.linalg.norm(normals, axis=1)[:, None]
            mean = normals.mean(0)
            assert np.allclose(curves[k], np.degrees(np.arccos(np.clip(normals @ mean / np.linalg.norm(mean), -1, 1))), atol=0.1)  # cosines within 1e-6 of 1 are 1
    assert len(surface._facet(angles, curves)) == 60


def test_fits_are_selectivity_of_densities(spark):
    r = np.random.default_rng(3)
    rows = [(g, None if i == 7 else round(float(x), 1)) for g, n in (("a", 300), ("b", 2), ("c", 40)) for i, x in enumerate(r.normal(2.5, 0.5, n))] + [("one", 2.0)] * 3
    rows += [("flat", 2.0)] * 20 + [("flat", 3.0)] + [("nan", float("nan"))] * 2
    df = spark.createDataFrame(rows, "g string, v double")
    grid = {"low": 1.0, "end": 4.0, "step": 0.02}
    curve = selectivity.activity_curve(spark, [(1.0, 0.0), (-1.0, 5.0)], **grid)
    want = {x.g: x[1:] for x in selectivity.selectivity(selectivity.densities(df, "g", "v", **grid), curve, "g", high=4.0, **grid).collect()}
    got = {x.g: x[1:] for x in selectivity.fits(df, "g", "v", curve, high=4.0, **grid).collect()}
    assert got.keys() == want.keys() and "flat" in want and "one" not in want
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9), g


@pytest.mark.parametrize("name", ["gcn", "surf_gcn", "gcn_partial", "coord_hist", "coord_scope_avg", "reaction_selectivity"])
def test_bonds_are_found_once(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"ShuffledHashJoin \[frame#\d+L?, cell#", plan)) == 1


def test_measures_of_redundancy_read_one_shuffle(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    df = entry.queries()["redundant_frames"](spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # shows what is shared before it runs
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Once for all that atoms have, once for how many there are.
    assert len(re.findall("FileScan parquet", plan)) <= 2 and "InMemoryTableScan" not in plan
    assert len(re.findall(r"FlatMapGroupsInArrow .*, type_id#", plan)) == 1  # distances are counted once


def test_shared_rows(spark):
    rows = spark.createDataFrame([(k % 7, k, None if k % 3 else f"v{k}") for k in range(100)], "a long, b long, c string")
    got = ranges.shared(rows, "a", 100, 20)
    assert got.columns == rows.columns and got.rdd.getNumPartitions() >= 5
    assert sorted(got.collect(), key=lambda r: r.b) == rows.collect()
    assert got.where("b > 90 and c is not null").count() == rows.where("b > 90 and c is not null").count()


@pytest.mark.parametrize("n,k", [(1, 3), (2, 1), (63, 3), (64, 7), (200, 2), (130, 12)])
def test_distances_column_by_column(n, k):
    x = np.random.default_rng(n).uniform(0, 25, (n, k))
    x[n // 2] = x[0]
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for got in (cases._distances(x), np.stack([cases._rows(x)(j) for j in range(n)])):
        assert (got == want).all() if k < 8 else np.allclose(got, want, atol=1e-12)


def test_traces_of_peaks_step_by_step(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    queries = entry.queries()
    df = queries["sub_cluster_traces"](spark, SF)
    assert len(re.findall("FlatMapGroupsInArrow", df._jdf.queryExecution().sparkPlan().toString())) == 1
    points, found = features._settled(spark, SF)
    rows = points.join(found.withColumnRenamed("cluster", "of"), ["frame", "atom_id"])
    want = cases.sub_cluster_traces(rows, "frame", "atom_id", ["x", "y", "z"], "of", "gamma")
    assert df.columns == want.columns and sorted(df.collect()) == sorted(want.collect())
