"""Ordered series: rolling means, markers, peaks and tests over (key, order, value) tables.

Windows are partitioned by the series' key, so a series is one task's work and series are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def _w(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def depad(rows: DataFrame, key: str, order: str, same: str) -> DataFrame:
    """Rows of a series up to two before the first that repeats its predecessor's ``same``; all,
    if none does. ``order`` numbers the rows of a series from 1."""
    again = F.when(F.col(same) == F.lag(same).over(_w(key, order)), F.col(order))
    cut = F.min("__again").over(Window.partitionBy(key))
    return rows.withColumn("__again", again).withColumn("__cut", cut).where(f"__cut is null or {order} <= __cut - 2").drop("__again", "__cut")


def after_markers(rows: DataFrame, key: str, order: str, marker: Column, hit: Column, value: str, name: str) -> DataFrame:
    """The first row with ``hit`` after each ``marker``: its run's number from 1 and, as ``name``, the
    ``value`` of the row before it. Rows before the first marker belong to no run."""
    w = _w(key, order)
    runs = rows.withColumns({"__before": F.lag(value).over(w), "run": F.sum(F.when(marker, 1).otherwise(0)).over(w).cast("long"), "__hit": hit})
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy(order))
    return runs.where("__hit and run > 0").withColumn("__k", place).where("__k = 1").select(key, "run", order, F.round("__before", 6).alias(name))


def rolling_mean(rows: DataFrame, key: str, order: str, value: str, width: int, name: str = "mean") -> DataFrame:
    """Mean over ``width`` rows, only where there are so many."""
    w = _w(key, order).rowsBetween(1 - width, 0)
    out = rows.select(key, order, F.round(F.avg(value).over(w), 6).alias(name), F.count(F.lit(1)).over(w).alias("__n"))
    return out.where(F.col("__n") == width).drop("__n")


def block_mean(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """Mean of each block of ``width`` rows, blocks numbered from 0; ``order`` counts from 1."""
    block = F.floor((F.col(order) - 1) / width).alias("block")
    return rows.groupBy(key, block).agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))


def extrema(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows above or below both neighbours: kind 1 for maxima, -1 for minima."""
    w = _w(key, order)
    a, b, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    kind = F.when((x > a) & (x > b), 1).when((x < a) & (x < b), -1)
    return rows.withColumn("kind", kind).where("kind is not null").select(key, order, "kind", F.round(value, 6).alias("peak"))


def peak_drift(peaks: DataFrame, frame: str, at: str, most: int, within: float) -> DataFrame:
    """Whether the distances between the first ``most`` + 1 peaks of a frame are within ``within`` of
    those of the frame before; false if the frame before has a distance that this one lacks."""
    place = F.row_number().over(Window.partitionBy(frame).orderBy(at))
    gap = (F.col(at) - F.lag(at).over(Window.partitionBy(frame).orderBy(at))).alias("gap")
    gaps = peaks.select(frame, place.alias("k"), gap).where(F.col("k").between(2, most + 1))
    # A row goes to its own frame and to the next, so frames do not meet in a join.
    both = gaps.select(F.col("k"), F.inline(F.array(
        F.struct(F.col(frame).alias(frame), F.col("gap").cast("double").alias("now"), F.lit(None).cast("double").alias("before")),
        F.struct((F.col(frame) + 1).alias(frame), F.lit(None).cast("double").alias("now"), F.col("gap").cast("double").alias("before")),
    ))).groupBy(frame, "k").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    near = F.coalesce(F.abs(F.col("now") - F.col("before")) < within, F.col("before").isNull())
    return both.groupBy(frame).agg(F.bool_and(near).alias("steady"), F.count("now").alias("gaps")).where("gaps > 0")


def zscore_signals(rows: DataFrame, key: str, order: str, value: str, lag: int, threshold: float, influence: float = 1.0) -> DataFrame:
    """Rows more than ``threshold`` deviations off the mean of the window before: signal 1 or -1.

    Row i (from 0) is held against rows [i - 1 - lag, i - 1), the row at ``lag`` against [0, lag); the
    first ``lag`` rows and the last have no signal. A signal enters later windows as ``influence`` of
    itself and the rest of the filtered value before it: a recurrence, which streams each series
    in order, but for influence 1, where windows of the values do.
    """
    w = _w(key, order)
    if influence == 1:
        at, total = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(key))
        first, later = w.rowsBetween(-lag, -1), w.rowsBetween(-lag - 1, -2)
        stat = lambda f: F.when(F.col("__i") == lag, f(value).over(first)).otherwise(f(value).over(later))
        s = rows.withColumns({"__i": at, "__n": total}).withColumns({"__m": stat(F.avg), "__s": stat(F.stddev_pop)})
        s = s.where((F.col("__i") >= lag) & (F.col("__i") < F.col("__n") - 1) & (F.abs(F.col(value) - F.col("__m")) > threshold * F.col("__s")))
        return s.select(key, order, F.when(F.col(value) > F.col("__m"), 1).otherwise(-1).alias("signal"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        k, o, y = held.column(key), held.column(order), held.column(value).to_numpy().astype(float)
        turn = np.argsort(o.to_numpy(), kind="stable")
        y, filtered, hit, sign = y[turn], y[turn].copy(), [], []
        if len(y) > lag:
            mean, deviation = y[:lag].mean(), y[:lag].std()
            for i in range(lag, len(y) - 1):
                if abs(y[i] - mean) > threshold * deviation:
                    hit.append(turn[i])
                    sign.append(1 if y[i] > mean else -1)
                    filtered[i] = influence * y[i] + (1 - influence) * filtered[i - 1]
                mean, deviation = filtered[i - lag : i].mean(), filtered[i - lag : i].std()
        hit = pa.array(np.array(hit, np.int64))
        out = pa.table({key: k.take(hit), order: o.take(hit), "signal": pa.array(sign, pa.int32())})
        yield from out.to_batches()

    t = rows.select(key, order, value)
    schema = StructType([*t.select(key, order).schema.fields, StructField("signal", IntegerType())])
    return t.where(F.col(value).isNotNull()).groupBy(key).applyInArrow(scan, schema)


def welch(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """Welch's t, degrees of freedom and two-sided p between the last ``width`` rows of a series and
    the ``width`` before; series that are shorter, or constant in both, are left out."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    s = rows.withColumn("__b", back).where(F.col("__b") <= 2 * width)
    side = lambda f, late: f(F.when((F.col("__b") <= width) == F.lit(late), F.col(value)))
    g = s.groupBy(key).agg(*[side(f, late).alias(f"{n}{i}") for i, late in ((1, False), (2, True)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    g = g.where((F.col("n1") == width) & (F.col("n2") == width) & (a + b > 0)).select(
        key, ((F.col("m1") - F.col("m2")) / F.sqrt(a + b)).alias("t"),
        ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("df"),
    )

    def with_p(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p = two_sided_p(x.column("t").to_numpy(), x.column("df").to_numpy())
            yield pa.record_batch([*x.columns, pa.array(p)], [*x.schema.names, "p"])

    return g.mapInArrow(with_p, StructType([*g.schema.fields, StructField("p", DoubleType())]))


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's distribution, by integrating its density (Simpson, in the angle atan(t / sqrt(df)))."""
    theta = np.arctan2(np.abs(t), np.sqrt(df))
    n = 2000
    grid = np.linspace(0, 1, n + 1)[None, :]
    weights = np.where(np.arange(n + 1) % 2 == 1, 4.0, 2.0)
    weights[[0, -1]] = 1
    def area(lo, hi):
        x = lo[:, None] + (hi - lo)[:, None] * grid
        return (np.cos(x) ** (df[:, None] - 1) * weights).sum(1) * (hi - lo) / (3 * n)
    half = np.full_like(theta, np.pi / 2)
    return area(theta, half) / area(np.zeros_like(theta), half)


def segments(rows: DataFrame, key: str, order: str, peak: Column, value: str) -> DataFrame:
    """Series cut before each ``peak``: number, length and the row with the largest ``value`` of each segment."""
    part = F.sum(F.when(peak, 1).otherwise(0)).over(_w(key, order)).cast("long")
    s = rows.withColumn("segment", part)
    return s.groupBy(key, "segment").agg(F.count("*").alias("n"), F.max_by(order, F.struct(F.col(value), -F.col(order))).alias("at"), F.round(F.max(value), 6).alias("most"))


def separation(rows: DataFrame, key: str, order: str, value: str, low: float, high: float) -> DataFrame:
    """Where in the share (``low``, ``high``) of a series' rows ``value`` is largest, the first of ties:
    rows before it are one side, those from it on the other."""
    at = F.percent_rank().over(_w(key, order))
    s = rows.withColumn("__q", at).where(F.col("__q").between(low, high))
    return s.groupBy(key).agg(F.max_by(order, F.struct(F.col(value), -F.col(order))).alias("split"))


def spread_peaks(rows: DataFrame, key: str, order: str, value: str, k: int, h: float, kind: int = 2, similar: float = 0.01) -> DataFrame:
    """Peaks (key, order, s) by how far a row stands out of the ``k`` rows before and ``k`` - 1 behind.

    S1 is half the sum of the largest rises over each side, S2 of the rises' sums over ``k``, S3 of
    the rises over the sums of the sides' values over ``k``; the first and last row have 0. A peak has S
    above mean + ``h`` deviations of the positive S or, where a peak dominates (S that are not
    positive have a mean above -0.02 and a deviation below 0.02), above ``h`` / 20 of the highest. Where
    one dominates, every peak but a series' first goes if another S among the ``k`` rows before it
    and the ``k`` - 1 behind is within ``similar`` of its own. Of peaks closer than ``k`` to the one before the higher stays: a fold over a series' peaks.
    """
    w, x = _w(key, order), F.col(value)
    left, right = w.rowsBetween(-k, -1), w.rowsBetween(1, k - 1)
    rise = {
        1: lambda side: x - F.min(value).over(side),
        2: lambda side: (F.count(value).over(side) * x - F.sum(value).over(side)) / k,
        3: lambda side: x - F.sum(value).over(side) / k,
    }[kind]
    s = rows.select(key, order, F.coalesce((rise(left) + rise(right)) / 2, F.lit(0.0)).alias("s"))
    every, other = Window.partitionBy(key), F.when(F.col("s") <= 0, F.col("s"))
    up = F.when(F.col("s") > 0, F.col("s"))
    dominated = F.coalesce((F.avg(other).over(every) > -0.02) & (F.stddev_pop(other).over(every) < 0.02), F.lit(False))
    limit = F.when(dominated, F.max(up).over(every) * h / 20).otherwise(F.avg(up).over(every) + h * F.stddev_pop(up).over(every))
    near = F.collect_list("s").over(w.rowsBetween(-k, k - 1))
    s = s.withColumns({"__t": limit, "__d": dominated, "__near": near}).where(F.col("s") > F.col("__t"))
    alike = F.size(F.filter("__near", lambda v: (v >= F.col("s") - similar) & (v <= F.col("s") + similar))) > 1
    s = s.withColumn("__first", F.row_number().over(w) == 1).where(F.col("__first") | ~F.col("__d") | ~alike)
    peaks = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), "s"))).alias("p"))
    fold = F.expr(f"""aggregate(p, slice(p, 1, 0), (a, x) -> case when size(a) = 0 or x.at - element_at(a, -1).at >= {k} then concat(a, array(x))
        when x.s > element_at(a, -1).s then concat(slice(a, 1, size(a) - 1), array(x)) else a end)""")
    return peaks.select(key, F.explode(fold).alias("p")).select(key, F.col("p.at").alias(order), F.round("p.s", 6).alias("s"))


def early_stop(frames: DataFrame, key: str, order: str, redundant: str, most: int = 5) -> DataFrame:
    """``frames`` with ``seen``: whether a scan that skips the rest of a particle after more than
    ``most`` frames in a row without a redundant one gets as far as this frame."""
    w = _w(key, order)
    run = F.sum(F.col(redundant).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = frames.withColumn("__run", F.coalesce(run, F.lit(0)))
    streak = F.sum((~F.col(redundant)).cast("int")).over(Window.partitionBy(key, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("__over", (F.coalesce(streak, F.lit(0)) > most).cast("int"))
    return s.withColumn("seen", F.max("__over").over(w) == 0).drop("__run", "__over")


def steps(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row of a series with the number of the next (null for the last) and the change of ``value`` to it."""
    w = _w(key, order)
    return rows.select(key, order, F.lead(order).over(w).alias("next_no"), F.round(F.lead(value).over(w) - F.col(value), 6).alias("step"))


def welch_halves(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Welch's t and degrees of freedom between the first and the second half of each series."""
    half = F.ntile(2).over(_w(key, order))
    side = lambda f, h: f(F.when(F.col("__h") == h, F.col(value)))
    g = rows.withColumn("__h", half).groupBy(key).agg(*[side(f, h).alias(f"__{n}{h}") for h in (1, 2) for n, f in (("m", F.avg), ("v", F.var_samp))], *[F.count_if(F.col("__h") == h).alias(f"__n{h}") for h in (1, 2)])
    g = g.where("__n1 > 1 and __n2 > 1").withColumns({f"__s{h}": F.col(f"__v{h}") / F.col(f"__n{h}") for h in (1, 2)}).where("__s1 + __s2 > 0")
    s1, s2 = F.col("__s1"), F.col("__s2")
    df = (s1 + s2) * (s1 + s2) / (s1 * s1 / (F.col("__n1") - 1) + s2 * s2 / (F.col("__n2") - 1))
    return g.select(key, F.round((F.col("__m1") - F.col("__m2")) / F.sqrt(s1 + s2), 6).alias("t"), F.round(df, 4).alias("df"))


def density_overlap(rows: DataFrame, by: str, value: str, width: float, points: int = 100) -> DataFrame:
    """Bhattacharyya coefficient of each two groups' Gaussian kernel densities of ``width``, on a grid of
    ``points`` over the range of all values. Values are counted first, so the grid meets
    distinct values and not rows; groups meet on a grid point."""
    h = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ends = h.agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / (points - 1)).alias("w"))
    total = h.groupBy(by).agg(F.sum("n").alias("total"))
    g = h.join(F.broadcast(ends)).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    z = (F.col("lo") + F.col("w") * F.col("i") - F.col("v")) / width
    k = g.groupBy(by, "i").agg(F.max("w").alias("w"), (F.sum(F.col("n") * F.exp(-z * z / 2)) / (width * (2 * np.pi) ** 0.5)).alias("s"))
    d = k.join(total, by).select(by, "i", "w", (F.col("s") / F.col("total")).alias("p"))
    a, b = (d.select("i", "w", F.col(by).alias(f"type_{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    return a.join(b.drop("w"), "i").where("type_a < type_b").groupBy("type_a", "type_b").agg(F.round(F.sum(F.sqrt(F.col("pa") * F.col("pb")) * F.col("w")), 6).alias("bhattacharyya"))
