"""How well a cluster's atoms fit a reaction: densities on a grid against an activity curve.

Everything is columns on a grid of equal steps: the curve is the lower envelope of straight lines,
a cluster's density a sum of Gaussians over its distinct values, and integrals are Simpson weights.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds of the generalised coordination number, the end of its grid and the grid's step.
LOW, HIGH, END, STEP = 1.0, 14.0, 17.0, 0.001


def grid_points(low: float = LOW, end: float = END, step: float = STEP) -> int:
    return round((end - low) / step) + 1


def simpson_weight(k: Column, n: int, step: float) -> Column:
    """The weight of point ``k`` of ``n`` equally spaced ones; with an even number, the mean of leaving the last
    interval and of leaving the first to the trapezoid rule."""
    def odd(i: Column, m: int) -> Column:
        return F.when((i == 0) | (i == m - 1), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * step / 3

    if n % 2:
        return odd(k, n)
    first = F.when(k < n - 1, odd(k, n - 1)).otherwise(0.0) + F.when(k >= n - 2, step / 2).otherwise(0.0)
    last = F.when(k > 0, odd(k - 1, n - 1)).otherwise(0.0) + F.when(k <= 1, step / 2).otherwise(0.0)
    return (first + last) / 2


def activity_curve(spark: SparkSession, lines: list[tuple[float, float]], low: float = LOW, end: float = END, step: float = STEP) -> DataFrame:
    """(k, x, q): the least of the lines (slope, intercept) at each grid point, moved and scaled to [0, 1], then to area 1.
    A grid's worth of rows, so its window may be one task's."""
    n = grid_points(low, end, step)
    least = [F.lit(a) * F.col("x") + F.lit(b) for a, b in lines]
    rows = spark.range(n).select(F.col("id").alias("k"), (F.lit(low) + F.col("id") * step).alias("x")).withColumn("v", F.least(*least) if len(least) > 1 else least[0])
    every = Window.partitionBy()
    rows = rows.withColumn("u", (F.col("v") - F.min("v").over(every)) / (F.max("v").over(every) - F.min("v").over(every)))
    area = F.sum(F.col("u") * simpson_weight(F.col("k"), n, step)).over(every)
    return rows.select("k", "x", (F.col("u") / area).alias("q"))


def densities(rows: DataFrame, key: str, value: str, low: float = LOW, end: float = END, step: float = STEP) -> DataFrame:
    """(key, k, p): each group's Gaussian kernel density on the grid, of Silverman's width from the lesser of
    the deviation and the scaled range between quartiles (the deviation, where that range is 0).

    Values are counted first, so the grid meets distinct values and not rows. Nulls and NaN are left
    out; a group with fewer than two distinct values has no width and so no rows.
    """
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key, F.col(value).cast("double").alias("v"))
    s = good.groupBy(key).agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), (F.percentile("v", 0.75) - F.percentile("v", 0.25)).alias("iqr")).where("sd > 0")
    sigma = F.when(F.col("iqr") > 0, F.least("sd", F.col("iqr") / 1.3489795003921634)).otherwise(F.col("sd"))
    s = s.select(key, "n", (sigma * F.pow(F.col("n") * 3 / 4, F.lit(-0.2))).alias("w"))
    v = good.groupBy(key, "v").agg(F.count("*").alias("m")).join(s, key)
    v = v.select(key, "v", "m", "n", "w", F.explode(F.sequence(F.lit(0), F.lit(grid_points(low, end, step) - 1))).alias("k"))
    z = (F.lit(low) + F.col("k") * step - F.col("v")) / F.col("w")
    return v.groupBy(key, "k").agg(F.sum(F.col("m") * F.exp(-z * z / 2) / (F.col("n") * F.col("w") * math.sqrt(2 * math.pi))).alias("p"))


def selectivity(density: DataFrame, curve: DataFrame, key: str, low: float = LOW, high: float = HIGH, end: float = END, step: float = STEP) -> DataFrame:
    """(key, selectivity, specificity, sensitivity) of each group's density p towards the curve q.

    Selectivity falls with the distance of the two peaks (the first of equal ones), 0 at ``high`` - ``low``. Specificity
    compares widths at half of the maximum, of the lesser of both curves and of q: 1 less half
    their ratio if the former lies inside the latter, else half the ratio; 0 where nothing overlaps.
    Sensitivity is the integral of the product. The curve is a grid's worth of rows and is broadcast.
    """
    n = grid_points(low, end, step)
    both = density.join(F.broadcast(curve.withColumn("k", F.col("k").cast("int"))), "k")
    both = both.withColumn("o", F.when((F.col("p") != 0) & (F.col("q") != 0), F.least("p", "q")))
    every = Window.partitionBy(key)
    both = both.withColumns({"__o": F.max("o").over(every), "__q": F.max("q").over(every)})
    inside = lambda c, top: F.when(F.col(c) > F.col(top) / 2, F.col("x"))
    peak = lambda c: F.max_by("x", F.struct(c, -F.col("k")))
    g = both.groupBy(key).agg(
        peak("p").alias("xp"), peak("q").alias("xq"), F.min(inside("o", "__o")).alias("ol"), F.max(inside("o", "__o")).alias("oh"), F.min(inside("q", "__q")).alias("ql"), F.max(inside("q", "__q")).alias("qh"),
        F.sum(F.col("p") * F.col("q") * simpson_weight(F.col("k"), n, step)).alias("sensitivity"),
    )
    ratio = F.try_divide(F.col("oh") - F.col("ol"), F.col("qh") - F.col("ql")) / 2
    within = (F.col("ol") > F.col("ql")) & (F.col("oh") < F.col("qh"))
    return g.select(key, (1 - F.abs(F.col("xp") - F.col("xq")) / (high - low)).alias("selectivity"), F.coalesce(F.when(within, 1 - ratio).otherwise(ratio), F.lit(0.0)).alias("specificity"), "sensitivity")


def fits(rows: DataFrame, key: str, value: str, curve: DataFrame, low: float = LOW, high: float = HIGH, end: float = END, step: float = STEP) -> DataFrame:
    """:func:`selectivity` of the groups' :func:`densities`, whose grid stays in the task: a group comes as one row of
    its distinct values and leaves as its three numbers. The curve is a grid's worth of numbers, in ascending ``k``.
    """
    n = grid_points(low, end, step)
    grid = curve.select(F.struct("k", "x", "q", (F.col("q") * simpson_weight(F.col("k"), n, step)).alias("qs")).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("c"))
    v = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("m"))
    iqr = F.percentile("v", 0.75, F.col("m")) - F.percentile("v", 0.25, F.col("m"))
    groups = v.groupBy(key).agg(F.collect_list("v").alias("v"), F.collect_list("m").alias("m"), iqr.alias("iqr")).where(F.size("v") > 1)

    @F.arrow_udf("selectivity double, specificity double, sensitivity double")
    def fit(v: pa.Array, m: pa.Array, iqr: pa.Array, *curve: pa.Array) -> pa.Array:
        out = []
        x, q, qs = (c[0].values.to_numpy() for c in curve)  # alike in all rows
        half_q = x[q > q.max() / 2]
        ql, qh, xq = half_q.min(), half_q.max(), x[np.argmax(q)]
        for vs, ms, between in zip(v, m, iqr.to_numpy(), strict=True):
            values, counts, p = vs.values.to_numpy(), ms.values.to_numpy().astype(float), np.zeros(len(x))
            size = counts.sum()
            sd = math.sqrt(((values - values @ counts / size) ** 2) @ counts / (size - 1))
            width = (min(sd, between / 1.3489795003921634) if between > 0 else sd) * (size * 3 / 4) ** -0.2
            for k in range(0, len(x), 1024):  # blocks that stay in a core's cache
                for i in range(0, len(values), 32):
                    z = np.subtract.outer(x[k : k + 1024] / width, values[i : i + 32] / width)
                    z *= z
                    z *= -0.5
                    p[k : k + 1024] += np.exp(z, out=z) @ counts[i : i + 32]
            p /= size * width * math.sqrt(2 * math.pi)
            o = np.where((p != 0) & (q != 0), np.minimum(p, q), -np.inf)
            over = x[o > o.max() / 2] if o.max() > 0 else x[:0]
            specificity = 0.0
            if len(over) and qh > ql:
                ol, oh = over.min(), over.max()
                ratio = (oh - ol) / (qh - ql) / 2
                specificity = 1 - ratio if ol > ql and oh < qh else ratio
            out.append((1 - abs(x[np.argmax(p)] - xq) / (high - low), specificity, float(p @ qs)))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], pa.float64()) for k in range(3)], ["selectivity", "specificity", "sensitivity"])

    found = groups.join(F.broadcast(grid)).withColumn("f", fit("v", "m", "iqr", "c.x", "c.q", "c.qs"))
    return found.select(key, "f.*")
