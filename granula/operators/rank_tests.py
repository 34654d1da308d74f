"""Two samples a pair of frames: rank tests with their p-values, and distances between curves.

A sample is what a curve takes on its grid, as the test of redundant frames uses it: the values of
g(r), not the radii. Ranks are pooled within a pair by windows over its distinct values, so ties
count with their middle rank, and each statistic is a sum over those values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granula.operators.ranges import shared

#: What is added to both shares before their ratio, as in 10e-128.
TINY = 10e-128
#: Significance levels of the k-sample Anderson-Darling test and the coefficients of its points for
#: m = k - 1: b0 + b1 / sqrt(m) + b2 / m.
AD_LEVELS = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)
AD_B0 = (0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085)
AD_B1 = (-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615)
AD_B2 = (-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154)
#: Critical points of two samples, and the quadratic in them that fits the logarithm of the level.
AD_POINTS = tuple(a + b + c for a, b, c in zip(AD_B0, AD_B1, AD_B2, strict=True))
AD_FIT = tuple(float(x) for x in np.polyfit(AD_POINTS, np.log(AD_LEVELS), 2))


def curve_samples(curves: DataFrame, bins: range, value: str = "g") -> DataFrame:
    """(frame, bin, v) with a row for every bin of the grid, 0 where a frame's curve has none."""
    grid = curves.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(bins.start).cast("long"), F.lit(bins.stop - 1).cast("long"))).alias("bin"))
    return grid.join(curves.select("frame", "bin", F.col(value).alias("v")), ["frame", "bin"], "left").fillna(0.0, ["v"])


def next_pairs(samples: DataFrame, n_atoms: int | None = None) -> DataFrame:
    """(pair, side, bin, v): each frame's sample as the first of its own pair and the second of the one before;
    pairs without both sides are left out. Frames do not meet in a join. With ``n_atoms``, how many atoms the frames have in
    all, pairs are dealt in a number of tasks that grows with it, in one shuffle for all who read them."""
    sides = F.array(F.struct(F.col("frame").alias("pair"), F.lit(1).alias("side")), F.struct((F.col("frame") - 1).alias("pair"), F.lit(2).alias("side")))
    both = samples.select("bin", "v", F.inline(sides))
    if n_atoms is not None:
        both = shared(both, "pair", n_atoms, 250_000)
    n = F.min("side").over(Window.partitionBy("pair")) + F.max("side").over(Window.partitionBy("pair"))
    return both.withColumn("__n", n).where("__n = 3").drop("__n")


def _over(n: Column, first: int, begin: Column, step) -> Column:
    """A fold over the whole numbers from ``first`` to ``n``."""
    return F.aggregate(F.when(n >= first, F.sequence(F.lit(first), n.cast("int"))).otherwise(F.array().cast("array<int>")), begin, step)


def ks_p(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p of the Kolmogorov-Smirnov statistic: exact for samples of one size, counting lattice
    paths that leave a band by reflection; else the limit law."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    n, h = n1, F.round(d * n1).cast("int")
    ratio = lambda m: F.exp(_over(m, 1, F.lit(0.0), lambda a, j: a + F.ln((n - m + j) / (n + j))))
    exact = _over(F.floor(n1 / F.greatest(h, F.lit(1))), 1, F.lit(0.0), lambda a, k: a - F.pow(F.lit(-1.0), k) * ratio(k * h))
    x = d * F.sqrt(n1 * n2 / (n1 + n2))
    limit = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a - F.pow(F.lit(-1.0), k) * F.exp(-2 * k * k * x * x))
    p = F.when((n1 == n2) & (h == 0) | (x < 0.04), 1.0).when(n1 == n2, 2 * exact).otherwise(2 * limit)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def _bessel_quarter(z: Column) -> Column:
    """exp(-z) * K_{1/4}(z), by the trapezoid rule on its integral over exp(-z cosh t) cosh(t / 4)."""
    step = 0.1
    return step * F.aggregate(F.sequence(F.lit(0), F.lit(150)), F.lit(0.0), lambda a, i: a + F.when(i == 0, 0.5).otherwise(1.0) * F.exp(-z * (1 + F.cosh(i * step))) * F.cosh(i * step / 4))


def cvm_p(t: Column, n1: Column, n2: Column) -> Column:
    """p of the Cramer-von Mises statistic by its limit law, after matching mean and variance."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    n, k = n1 + n2, n1 * n2
    mean = (1 + 1 / n) / 6
    variance = (n + 1) * (4 * k * n - 3 * (n1 * n1 + n2 * n2) - 2 * k) / (45 * n * n * 4 * k)
    x = 1 / F.lit(6.0) + (t - mean) / F.sqrt(45 * variance)

    def term(acc: Column, i: Column) -> Column:
        c = F.when(i == 0, 1.0).otherwise(acc["c"] * (i - 0.5) / i)
        q = F.pow(4.0 * i + 1, 2) / (16 * x)
        return F.struct(c.alias("c"), (acc["s"] + c * F.sqrt(4.0 * i + 1) * _bessel_quarter(q)).alias("s"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s")), term)["s"]
    return F.when(x < 0.003, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - series / (math.pi * F.sqrt(x))))


def ad_p(a: Column) -> Column:
    """p of the normalised two-sample Anderson-Darling statistic between the tabulated levels, kept within them."""
    inside = F.exp(AD_FIT[0] * a * a + AD_FIT[1] * a + AD_FIT[2])
    return F.when(a < min(AD_POINTS), max(AD_LEVELS)).when(a > max(AD_POINTS), min(AD_LEVELS)).otherwise(inside)


def _ad_scale(n: Column, n1: Column, n2: Column) -> Column:
    """Standard deviation of the Anderson-Darling sum of two samples."""
    sums = _over(n - 1, 2, F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("g")), lambda acc, i: F.struct((acc["h"] + 1 / (n + 1 - i)).alias("h"), (acc["g"] + (acc["h"] + 1 / (n + 1 - i)) / i).alias("g")))
    h, g, r, k = sums["h"] + 1, sums["g"], 1 / n1 + 1 / n2, 2
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * r
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * r - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * r + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    m = n.cast("double")
    return F.sqrt((a * m * m * m + b * m * m + c * m + d) / ((m - 1) * (m - 2) * (m - 3)))


def two_sample_tests(pairs: DataFrame) -> DataFrame:
    """Statistics and p-values of the k-sample Anderson-Darling (middle ranks), Kolmogorov-Smirnov and
    Cramer-von Mises tests between sides 1 and 2 of each pair.

    Columns pair, ad, p_ad, ks, p_ks, cvm, p_cvm. Nulls and NaN take no part. A pair in which either
    sample is constant has nulls in all six, as the tests say nothing then. Samples of a pair
    need four values together.
    """
    n = pairs.where("v is not null and not isnan(v)").groupBy("pair", "v").agg(F.count_if(F.col("side") == 1).alias("c1"), F.count_if(F.col("side") == 2).alias("c2"))
    w, all_ = Window.partitionBy("pair").orderBy("v"), Window.partitionBy("pair")
    n = n.withColumns({"l1": F.sum("c1").over(w), "l2": F.sum("c2").over(w), "n1": F.sum("c1").over(all_), "n2": F.sum("c2").over(all_)})
    n = n.withColumns({"n": F.col("n1") + F.col("n2"), "t": F.col("c1") + F.col("c2")}).withColumn("mid", F.col("l1") + F.col("l2") - F.col("t") / 2)
    n = n.select("pair", "v", *[F.col(x).cast("double").alias(x) for x in ("c1", "c2", "l1", "l2", "n1", "n2", "n", "t", "mid")])
    c = F.col
    spread = c("mid") * (c("n") - c("mid")) - c("n") * c("t") / 4
    ad = lambda s: F.try_divide(c("t") / c("n") * F.pow(c("n") * (c(f"l{s}") - c(f"c{s}") / 2) - c("mid") * c(f"n{s}"), 2), spread) / c(f"n{s}")
    squares = lambda x: x * (x + 1) * (2 * x + 1) / 6

    def offset(s: int) -> Column:
        """Squared differences between the pooled middle ranks of a side's rows and their own numbers."""
        last, number, rank = c(f"l{s}"), c(f"c{s}"), c("mid") + 0.5
        own = number * (2 * last - number + 1) / 2
        return number * rank * rank - 2 * rank * own + squares(last) - squares(last - number)

    sums = n.groupBy("pair", "n1", "n2").agg(
        F.sum(ad(1) + ad(2)).alias("ad"), F.max(F.abs(c("l1") / c("n1") - c("l2") / c("n2"))).alias("ks"), F.sum(c("n1") * offset(1) + c("n2") * offset(2)).alias("u"),
        F.count_if(c("c1") > 0).alias("d1"), F.count_if(c("c2") > 0).alias("d2"),
    ).where("n1 > 0 and n2 > 0").withColumn("n", c("n1") + c("n2"))
    k = c("n1") * c("n2")
    sums = sums.withColumns({"cvm": c("u") / (k * c("n")) - (4 * k - 1) / (6 * c("n")), "ad": ((c("n") - 1) / c("n") * c("ad") - 1) / _ad_scale(c("n"), c("n1"), c("n2"))})
    # Before the select that rounds, whose names would stand for the rounded statistics in it.
    sums = sums.withColumns({"p_ad": ad_p(c("ad")), "p_ks": ks_p(c("ks"), c("n1"), c("n2")), "p_cvm": cvm_p(c("cvm"), c("n1"), c("n2"))})
    told = (c("d1") > 1) & (c("d2") > 1) & (c("n") > 3)
    return sums.select("pair", *[F.when(told, F.round(c(x), 6)).alias(x) for x in ("ad", "p_ad", "ks", "p_ks", "cvm", "p_cvm")])


def curve_distances(pairs: DataFrame) -> DataFrame:
    """Distances between the two curves of each pair, both scaled to sum 1: w1 between the samples of their
    values, Hellinger, Kullback-Leibler and Jensen-Shannon bin by bin, with ``TINY`` added to both
    sides of a ratio.

    Columns pair, w1, hellinger, kl, js; curves of a pair have the same bins. A pair with a curve of
    sum 0 or of one value alone has nulls.
    """
    side = Window.partitionBy("pair", "side")
    s = pairs.withColumns({"s": F.try_divide(F.col("v"), F.sum("v").over(side)), "__same": F.max("v").over(side) == F.min("v").over(side)})
    s = s.withColumn("rank", F.row_number().over(side.orderBy("s")))
    one = lambda k: F.when(F.col("side") == k, F.col("s"))
    bad = F.max(F.col("__same") | F.col("s").isNull()).alias("bad")
    w1 = s.groupBy("pair", "rank").agg(F.abs(F.sum(one(1)) - F.sum(one(2))).alias("gap"), bad).groupBy("pair").agg(F.avg("gap").alias("w1"), F.max("bad").alias("bad"))
    both = s.groupBy("pair", "bin").agg(F.coalesce(F.sum(one(1)), F.lit(0.0)).alias("p"), F.coalesce(F.sum(one(2)), F.lit(0.0)).alias("q"))
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    entropy = lambda a, b: (a + TINY) * F.ln((a + TINY) / (b + TINY))
    rest = both.groupBy("pair").agg(
        (F.sqrt(F.sum(F.pow(F.sqrt(p) - F.sqrt(q), 2))) / math.sqrt(2)).alias("hellinger"), F.sum(entropy(p, q)).alias("kl"), (F.sum(entropy(p, m) + entropy(q, m)) / 2).alias("js")
    )
    out = w1.join(rest, "pair")
    return out.select("pair", *[F.when(~F.col("bad"), F.round(c, 8 if c == "w1" else 6)).alias(c) for c in ("w1", "hellinger", "kl", "js")])
