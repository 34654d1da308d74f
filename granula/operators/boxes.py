"""Box counting of balls around atoms, and the fit of a fractal dimension."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granula.operators.series import two_sided_p

#: Fixed value: space around a particle on each side.
MARGIN = 5.0


def student_95(df: int) -> float:
    """Two-sided 95 % point of Student's distribution, by halving."""
    low, high = 1.0, 13.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if two_sided_p(np.array([mid]), np.array([float(df)]))[0] > 0.05 else (low, mid)
    return low


def box_sizes(longest: float, shortest: float, n: int = 10) -> list[float]:
    """``n`` lengths from ``longest`` to ``shortest``, evenly on a log scale."""
    return [longest * (shortest / longest) ** (i / (n - 1)) for i in range(n)]


def touched_boxes(atoms: DataFrame, radius: Column, reach: float, lengths: list[float]) -> DataFrame:
    """(frame, size, magnification, bx, by, bz, surf, near, far): boxes that an atom's ball of ``radius``
    (``reach`` at most) may touch, with the squared distances from the atom to the box's nearest and
    farthest point.

    A frame lies in a cube of its largest extent and a margin on each side, cut into whole boxes of
    about each length. An atom is expanded to the boxes around it alone, so nothing is joined but a
    row a frame.
    """
    ext = atoms.groupBy("frame").agg(*[F.min(c).alias(f"o{c}") for c in "xyz"], F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("__e"))
    a = atoms.join(ext, "frame").withColumn("r", radius).withColumn("__w", F.col("__e") + 2 * MARGIN)
    a = a.withColumn("__len", F.explode(F.array(*[F.lit(x) for x in lengths])))
    m = F.greatest(F.lit(1), F.floor(F.col("__w") / F.col("__len"))).cast("int")
    a = a.withColumn("magnification", m).withColumn("size", F.col("__w") / F.col("magnification"))
    for c in "xyz":
        p = F.col(c) - F.col(f"o{c}") + MARGIN  # from the cube's corner
        lo = F.greatest(F.lit(0), F.floor((p - F.col("r")) / F.col("size"))).cast("int")
        hi = F.least(F.col("magnification") - 1, F.floor((p + F.col("r")) / F.col("size")).cast("int"))
        a = a.withColumn(f"b{c}", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
        low, high = F.col(f"b{c}") * F.col("size"), (F.col(f"b{c}") + 1) * F.col("size")
        near = F.greatest(low - p, p - high, F.lit(0.0))
        far = F.greatest(F.abs(p - low), F.abs(p - high))
        a = a.withColumns({f"__n{c}": near * near, f"__f{c}": far * far})
    near, far = (sum((F.col(f"__{k}{c}") for c in "xyz"), F.lit(0.0)) for k in "nf")
    return a.select("frame", "size", "magnification", "bx", "by", "bz", "surf", "r", near.alias("near"), far.alias("far")).where(F.col("near") < F.col("r") * F.col("r"))


def surface_boxes(atoms: DataFrame, radius: Column, reach: float, lengths: list[float]) -> DataFrame:
    """(frame, size, magnification, surface_boxes, bulk_boxes): a box belongs to the bulk if a bulk atom's
    ball touches it or any ball covers it, else to the surface if a surface atom's ball cuts it.
    Whichever comes first, the bulk wins, so one maximum a box decides."""
    t = touched_boxes(atoms, radius, reach, lengths)
    bulk = (F.col("surf") == 0) | (F.col("far") < F.col("r") * F.col("r"))
    box = t.groupBy("frame", "size", "magnification", "bx", "by", "bz").agg(F.bool_or(bulk).alias("bulk"))
    return box.groupBy("frame", "size", "magnification").agg(F.count_if(~F.col("bulk")).alias("surface_boxes"), F.count_if("bulk").alias("bulk_boxes"))


def ball_volume(atoms: DataFrame, radius: Column, reach: float, lengths: list[float]) -> DataFrame:
    """(frame, size, magnification, surf, bulk, overlap): boxes touched by balls of surface atoms only,
    of bulk atoms only, and of both."""
    t = touched_boxes(atoms, radius, reach, lengths)
    box = t.groupBy("frame", "size", "magnification", "bx", "by", "bz").agg(F.bool_or(F.col("surf") == 1).alias("s"), F.bool_or(F.col("surf") == 0).alias("b"))
    return box.groupBy("frame", "size", "magnification").agg(F.count_if(F.expr("s and not b")).alias("surf"), F.count_if(F.expr("b and not s")).alias("bulk"), F.count_if(F.expr("s and b")).alias("overlap"))


def trimmed_slope(counts: DataFrame, x: Column, y: Column, order: Column, least: int = 5, most: int = 64) -> DataFrame:
    """(frame, dimension, r2, points, low, high): the slope of y over x after trimming, points taken in
    ``order``, with its 95 % interval (null with ``most`` points and more).

    The last point goes until R2, to three digits, falls, and once more then; after that the first
    goes until it falls again, and the fit before that counts; so does the last fit when ``least``
    points are left. Points a frame are a parameter's worth, so its fits over all sub-ranges are one
    self-join of them, and the choice is a fold.
    """
    p = counts.select("frame", x.alias("x"), y.alias("y"), F.row_number().over(Window.partitionBy("frame").orderBy(order)).cast("int").alias("k")).where("x is not null and y is not null")
    last = p.groupBy("frame").agg(F.count("*").cast("int").alias("total"))
    ends = last.select("frame", "total", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("total") - least))).alias("lo"))
    ends = ends.select("*", F.explode(F.expr(f"case when lo + {least} <= total then sequence(lo + {least}, total) end")).alias("hi"))
    fits = ends.join(p, "frame").where("k between lo and hi").groupBy("frame", "total", "lo", "hi").agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"))
    table = fits.groupBy("frame", "total").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("lo", "hi"), F.struct(F.col("slope"), F.round("r2", 3).alias("r3"), F.col("r2"))))).alias("m"))
    zero = "named_struct('lo', 1, 'hi', total, 'tail', true, 'done', false, 'slope', 0D, 'r3', 0D, 'r2', 0D, 'n', 0)"
    get = "try_element_at(m, struct(s.lo, s.hi))"
    step = f"""case when s.done or s.hi - s.lo + 1 <= {least} then s
        when not s.tail and {get}.r3 < s.r3 then named_struct('lo', s.lo, 'hi', s.hi, 'tail', s.tail, 'done', true, 'slope', s.slope, 'r3', s.r3, 'r2', s.r2, 'n', s.n)
        when s.tail then named_struct('lo', s.lo, 'hi', s.hi - 1, 'tail', not ({get}.r3 < s.r3), 'done', false, 'slope', {get}.slope, 'r3', {get}.r3, 'r2', {get}.r2, 'n', s.hi - s.lo + 1)
        else named_struct('lo', s.lo + 1, 'hi', s.hi, 'tail', false, 'done', false, 'slope', {get}.slope, 'r3', {get}.r3, 'r2', {get}.r2, 'n', s.hi - s.lo + 1) end"""
    out = table.withColumn("s", F.expr(f"aggregate(sequence(1, 2 * total), {zero}, (s, i) -> {step})"))
    points = F.create_map(*[F.lit(x) for df in range(1, most - 1) for x in (df, student_95(df))])
    df = F.col("s.n") - 2
    half = F.try_element_at(points, df) * F.abs("s.slope") * F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.lit(1.0), F.col("s.r2")) - 1) / df)
    return out.select(
        "frame", F.round("s.slope", 6).alias("dimension"), F.round("s.r2", 6).alias("r2"), F.col("s.n").alias("points"),
        F.round(F.col("s.slope") - half, 6).alias("low"), F.round(F.col("s.slope") + half, 6).alias("high"),
    )
