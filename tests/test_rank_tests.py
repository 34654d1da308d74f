"""Rank tests, distances and nearest-neighbour information against enumeration and known points."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.operators import alignment, information, rank_tests

PAIRS = "pair long, side int, bin long, v double"


def rows_of(pair, x, y):
    return [(pair, side, i, v) for side, vs in ((1, x), (2, y)) for i, v in enumerate(vs)]


def samples():
    r = random.Random(4)
    out = [([1.0, 2.0, 3.0, 4.0], [2.5, 3.5, 4.5, 5.5]), ([1.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0]), ([0.0, 0.0, 1.0], [0.0, 1.0, 1.0, 2.0, 7.0])]
    out += [([float(r.randint(0, 6)) for _ in range(r.randint(3, 9))], [float(r.randint(0, 8)) for _ in range(r.randint(3, 9))]) for _ in range(12)]
    out += [([r.random() for _ in range(6)], [r.random() + 0.4 for _ in range(6)]) for _ in range(6)]
    return out


def test_statistics_by_definition(spark):
    cases = samples()
    extra = [(0, 1, 99, None), (0, 2, 99, float("nan"))]
    df = spark.createDataFrame([r for k, (x, y) in enumerate(cases) for r in rows_of(k, x, y)] + extra, PAIRS).repartition(3)
    got = {r.pair: r for r in rank_tests.two_sample_tests(df).collect()}
    for k, (x, y) in enumerate(cases):
        g, pool, n1, n2 = got[k], x + y, len(x), len(y)
        n = n1 + n2
        if len(set(x)) == 1 or len(set(y)) == 1:
            assert g.ad is None and g.p_ks is None and g.cvm is None
            continue
        share = lambda s, v: sum(a <= v for a in s) / len(s)
        assert g.ks == pytest.approx(max(abs(share(x, v) - share(y, v)) for v in pool), abs=2e-6)
        rank = lambda v: sum(a < v for a in pool) + (sum(a == v for a in pool) + 1) / 2
        u = n1 * sum((rank(v) - i) ** 2 for i, v in enumerate(sorted(x), 1)) + n2 * sum((rank(v) - i) ** 2 for i, v in enumerate(sorted(y), 1))
        assert g.cvm == pytest.approx(u / (n1 * n2 * n) - (4 * n1 * n2 - 1) / (6 * n), abs=2e-6)
        total = 0.0
        for s in (x, y):
            for v in sorted(set(pool)):
                t = pool.count(v)
                b, m = sum(a < v for a in pool) + t / 2, sum(a < v for a in s) + s.count(v) / 2
                total += t / n * (n * m - b * len(s)) ** 2 / (b * (n - b) - n * t / 4) / len(s)
        r = 1 / n1 + 1 / n2
        h = sum(1 / i for i in range(1, n))
        gg = sum(1 / ((n - i) * j) for i in range(1, n - 1) for j in range(i + 1, n))
        cubic = [(4 * gg - 6) + (10 - 6 * gg) * r, (2 * gg - 4) * 4 + 16 * h + (2 * gg - 14 * h - 4) * r - 8 * h + 4 * gg - 6, (6 * h + 2 * gg - 2) * 4 + (4 * h - 4 * gg + 6) * 2 + (2 * h - 6) * r + 4 * h, (2 * h + 6) * 4 - 8 * h]
        variance = np.polyval(cubic, n) / ((n - 1) * (n - 2) * (n - 3))
        assert g.ad == pytest.approx(((n - 1) / n * total - 1) / math.sqrt(variance), abs=5e-6)


def test_exact_ks_p_by_enumeration(spark):
    r = random.Random(9)
    for n in (3, 4, 5, 6):
        pool = r.sample(range(100), 2 * n)
        df = spark.createDataFrame(rows_of(n, [float(v) for v in pool[:n]], [float(v) for v in pool[n:]]), PAIRS)
        g = rank_tests.two_sample_tests(df).first()
        far = total = 0
        for chosen in itertools.combinations(range(2 * n), n):
            steps = np.cumsum([1 if i in chosen else -1 for i in range(2 * n)])
            far += Fraction(int(abs(steps).max()), n) >= Fraction(round(g.ks * n), n)
            total += 1
        assert g.p_ks == pytest.approx(far / total, abs=2e-6)


def test_tabulated_points(spark):
    one = spark.range(1)
    at = lambda c: one.select(c.alias("p")).first().p
    for a, level in zip(rank_tests.AD_POINTS[1:-1], rank_tests.AD_LEVELS[1:-1], strict=True):
        assert at(rank_tests.ad_p(F.lit(a))) == pytest.approx(level, rel=0.06)
    assert (at(rank_tests.ad_p(F.lit(-1.0))), at(rank_tests.ad_p(F.lit(50.0)))) == (0.25, 0.001)
    n = 10**6  # so many that the statistic has its limit's mean and variance
    for x, p in ((0.34730, 0.10), (0.46136, 0.05), (0.74346, 0.01), (0.11888, 0.5)):
        assert at(rank_tests.cvm_p(F.lit(x), F.lit(n), F.lit(n))) == pytest.approx(p, abs=1e-4)
    for x, p in ((1.2238, 0.10), (1.3581, 0.05), (1.6276, 0.01)):
        assert at(rank_tests.ks_p(F.lit(x) * F.sqrt(F.lit(2.0 / n)), F.lit(n), F.lit(n + 1))) == pytest.approx(p, abs=2e-4)


def test_curve_distances(spark):
    r = random.Random(2)
    curves = {k: ([r.choice([0.0, r.random()]) for _ in range(20)], [r.choice([0.0, r.random()]) for _ in range(20)]) for k in range(5)}
    curves[5] = ([1.0] * 20, curves[0][0])
    curves[6] = (curves[0][0], curves[0][0])
    curves[7] = ([0.0] * 20, curves[0][0])
    df = spark.createDataFrame([x for k, (a, b) in curves.items() for x in rows_of(k, a, b)], PAIRS)
    got = {g.pair: g for g in rank_tests.curve_distances(df).collect()}
    for k in range(5):
        p, q = (np.array(c) / sum(c) for c in curves[k])
        entropy = lambda a, b: float(sum((x + 1e-127) * math.log((x + 1e-127) / (y + 1e-127)) for x, y in zip(a, b, strict=True)))
        want = (abs(np.sort(p) - np.sort(q)).mean(), math.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum() / 2), entropy(p, q), (entropy(p, (p + q) / 2) + entropy(q, (p + q) / 2)) / 2)
        assert (got[k].w1, got[k].hellinger, got[k].kl, got[k].js) == pytest.approx(want, abs=2e-6)
    assert got[5].w1 is None and got[7].kl is None and (got[6].w1, got[6].kl) == (0, 0)


def test_grid_and_pairs(spark):
    g = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.7), (4, 2, 1.0)], "frame long, bin long, g double")
    s = rank_tests.curve_samples(g, range(2, 4))
    assert sorted(tuple(r) for r in s.collect()) == [(1, 2, 0.5), (1, 3, 0.0), (2, 2, 0.0), (2, 3, 0.7), (4, 2, 1.0), (4, 3, 0.0)]
    assert sorted(tuple(r) for r in rank_tests.next_pairs(s).select("pair", "side", "bin", "v").collect()) == [(1, 1, 2, 0.5), (1, 1, 3, 0.0), (1, 2, 2, 0.0), (1, 2, 3, 0.7)]


def test_nearest_neighbour_information(spark):
    def plain(x, y, k=3):
        x, y, n = np.array(x) / (np.std(x) or 1), np.array(y) / (np.std(y) or 1), len(x)
        psi = lambda m: sum(1 / i for i in range(1, m)) - 0.5772156649015329
        k, total = min(k, n - 1), 0.0
        for i in range(n):
            radius = sorted(max(abs(x[i] - x[j]), abs(y[i] - y[j])) for j in range(n))[k]
            for v in (x, y):
                total += psi(sum(abs(v[i] - v[j]) < radius or v[i] == v[j] for j in range(n)))
        return max(0.0, psi(n) + psi(k) - total / n)

    r = random.Random(5)
    cases = {0: [(r.random(), r.random()) for _ in range(300)], 1: [(float(r.randint(0, 3)), float(r.randint(0, 3))) for _ in range(60)], 2: [(1.0, 2.0), (2.0, 1.0)], 3: [(x := r.random(), x * x) for _ in range(80)]}
    rows = [(k, *p) for k, v in cases.items() for p in v] + [(0, None, 1.0), (0, float("nan"), 2.0), (9, 1.0, 1.0)]
    got = {g.k: g for g in information.nearest_neighbour_information(spark.createDataFrame(rows, "k long, x double, y double"), ["k"], "x", "y").collect()}
    for k, v in cases.items():
        assert got[k].n == len(v) and got[k].mi == pytest.approx(plain(*zip(*v, strict=True)), abs=1e-9)
    assert got[9].mi == 0


def test_information_of_gaussians():
    r = np.random.default_rng(1)
    for rho in (0.0, 0.6, 0.9):
        x = r.normal(size=3000)
        y = rho * x + math.sqrt(1 - rho * rho) * r.normal(size=3000)
        assert information.nearest_information(x, y) == pytest.approx(-0.5 * math.log(1 - rho * rho), abs=0.06)


def test_redundancy_needs_every_measure(spark):
    names = [*alignment.REDUNDANT_BELOW, *alignment.REDUNDANT_ABOVE]
    good = [limit / 2 for limit in alignment.REDUNDANT_BELOW.values()] + [2 * limit for limit in alignment.REDUNDANT_ABOVE.values()]
    rows = [(0, *good)] + [(k + 1, *good[:k], bad, *good[k + 1 :]) for k in range(10) for bad in (None,)]
    rows += [(20 + k, *good[:k], float("nan"), *good[k + 1 :]) for k in range(10)] + [(40 + k, *good[:k], 1.5 * good[k] * 2 if k < 6 else good[k] / 4, *good[k + 1 :]) for k in range(10)]
    df = spark.createDataFrame(rows, "frame long, " + ", ".join(f"{c} double" for c in names))
    assert [r.frame for r in alignment.redundant_frames(df).where("redundant").collect()] == [0]
    with pytest.raises(ValueError, match="p_cvm"):
        alignment.redundant_frames(df.drop("p_cvm"))
