"""Every query of the catalogue against its SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from granula.plans import catalogue, features, more  # noqa: F401 - both add to the catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(rows):
    clean = lambda v: None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    cur = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert norm(map(tuple, got.select(*names).collect())) == norm(cur.fetchall())


def test_radial_distribution_of_full_reach(spark, db):
    assert {r.wave for r in catalogue.QUERIES["structure_factor_all"](spark, SF).select("wave").distinct().collect()} == set(range(1, 513))
    at = {}
    for r in catalogue.atoms(spark, SF).collect():
        at.setdefault(r.frame, []).append((r.x, r.y, r.z))
    want = {}
    for f, p in at.items():
        for k, a in enumerate(p):
            for b in p[k + 1 :]:
                m = math.floor(round(math.dist(a, b) / 0.08, 6) + 1.5)
                if 1 < m <= 120:
                    want[f, m] = want.get((f, m), 0) + 1
    assert {(r.frame, r.bin): r.n for r in catalogue.QUERIES["rdf_total_all"](spark, SF).collect()} == want
    assert max(m for _, m in want) == 120
