"""The published dataset: names by rule, the pivot, derived columns."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from granula.operators import dataset

SF = "/root/testdata/sf0.001"
COUNTS = {"MM_TCN_3": 5, "N_atom_total": 10, "N_Ele1": 4, "N_Ele2": 6, "R_avg": 2.0, "Ele1M_SCN_1": 1, "Ele1M_SCN_3": 2, "Ele2M_SCN_7": 4, "Ele2M_SCN_8": 9, "Ele2M_SCN_9": 3}


def test_names():
    names = dataset.names()
    assert len(names) == len(set(names)) == 972
    groups = {"BL": 20, "BA1": 45, "BA2": 45, "BTneg": 85, "BTpos": 85, "frac": 3}
    for k, n in groups.items():
        assert sum(f"_{k}" in c for c in names) == n, k
    assert sum(c.startswith(("MM_", "Ele1M_", "Ele2M_")) and "CN_" in c for c in names) == 528
    assert sum(c.startswith("q6q6_") for c in names) == 69 and sum(c.startswith("Surf_") for c in names) == 45
    assert names[:8] == ["T", "P", "N_atom_total", "N_Ele1", "N_Ele2", "N_atom_bulk", "N_atom_surface", "Vol_bulk_pack"]
    assert names[-4:] == ["Potential_E", "Kinetic_E", "Total_E", "Formation_E"]
    at = names.index("Ele1Ele2Ele1Ele1_BTneg_avg")
    assert names[at : at + 6] == [f"Ele1Ele2Ele1Ele1_BTneg_{s}" for s in ("avg", "std", "max", "min", "num")] + ["Ele1Ele2Ele1Ele1_BTpos_avg"]
    assert names[names.index("Curve_171-180") + 1] == "MM_TCN_avg" and names[names.index("MM_SOGCN_avg") + 1] == "MM_TCN_0"


@pytest.fixture(scope="module")
def measured(spark):
    rows = [(f, k, float(v)) for f in (1, 2) for k, v in COUNTS.items()] + [(3, "R_avg", 1.0), (1, "no such feature", 7.0), (2, "S_100", None)]
    return dataset.wide(spark.createDataFrame(rows, "frame long, feature string, value double"), ("Curve_",))


def test_wide(measured):
    assert measured.columns == ["frame", *dataset.measured_names()]
    rows = {r.frame: r.asDict() for r in measured.collect()}
    assert rows[1]["MM_TCN_3"] == 5 and rows[1]["MM_TCN_4"] == 0 and rows[1]["MM_TCN_avg"] is None
    assert rows[3]["R_avg"] == 1 and rows[3]["N_bond"] == 0 and rows[2]["S_100"] == 0 and rows[2]["Curve_1-10"] is None


def test_published(spark, measured):
    md = spark.createDataFrame([(1, 300.0, 1.0, -5.0, 2.0, -3.0), (9, 1.0, 1.0, 1.0, 1.0, 1.0)], "frame long, T double, P double, Potential_E double, Kinetic_E double, Total_E double")
    row = dataset.published(measured, md, ("Au", "Co")).collect()
    assert len(row) == 1
    r = row[0].asDict()
    assert list(r) == ["frame", *dataset.names()]
    assert r["Surf_defects_Ele1"] == 3 and r["Surf_micros_Ele2"] == 4 and r["Surf_facets"] == 3 and r["Surf_facets_Ele1"] == 0
    volume = 4 * 0.196967 / 6.02214076e23 / (19320 / 1e30) + 6 * 0.058933 / 6.02214076e23 / (8900 / 1e30)
    assert r["Vol_bulk_pack"] == pytest.approx(volume) and r["Vol_sphere"] == pytest.approx(0.75 * 3.141592653589793 * 8)
    assert r["Surf_defects_bulk_pack_conc"] == pytest.approx(3 / volume) and r["Surf_micros_sphere_ratio"] == pytest.approx(0.4)
    assert r["Formation_E"] == pytest.approx(-3 + 4 * 3.93 + 6 * 4.41)


def test_empty(spark):
    none = spark.createDataFrame([], "frame long, feature string, value double")
    assert dataset.wide(none).count() == 0


def test_groups_share_their_bonds(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    plan = entry.queries()["dataset_long"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(re.findall(r"HashJoin \[frame#\w+, cell#", plan)) <= 14


def test_spread(spark):
    rows = [(1, 1, 2.0), (1, 1, 25.0), (1, 2, 2.0), (2, 2, 0.0)]
    df = spark.createDataFrame(rows, "frame long, type_id int, x double")
    got = dataset._spread(df, ["type_id"], {"X": (F.ceil("x"), F.col("x") * 2, 2)}, F.concat(F.coalesce(F.col("type_id").cast("string"), F.lit("all")), F.lit("_")))
    want = {(1, "all_X_2"): 2, (1, "1_X_2"): 1, (1, "2_X_2"): 1, (2, "all_X_0"): 1, (2, "2_X_0"): 1}
    want |= {(1, "all_X_avg"): round(29 / 3, 6), (1, "1_X_avg"): 13.5, (1, "2_X_avg"): 2, (2, "all_X_avg"): 0, (2, "2_X_avg"): 0}
    assert {(r.frame, r.feature): r.value for r in got.collect()} == want and got.count() == len(want)
