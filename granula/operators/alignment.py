"""Frames laid over each other, and which of them repeat the one before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a frame may differ from the next at most to be redundant (mi and p-values: at least).
REDUNDANT_BELOW = {"rmsd": 0.05, "dimension_change": 0.01, "w1": 0.0001, "hellinger": 0.08, "kl": 0.25, "js": 0.005}
REDUNDANT_ABOVE = {"mi": 1.0, "p_ad": 0.05, "p_ks": 0.05, "p_cvm": 0.05}


def _eigenvalues(a: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, largest first, by the trigonometric formula."""
    p1 = a[0][1] * a[0][1] + a[0][2] * a[0][2] + a[1][2] * a[1][2]
    q = (a[0][0] + a[1][1] + a[2][2]) / 3
    d = [a[k][k] - q for k in range(3)]
    p = F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * p1) / 6)
    det = d[0] * (d[1] * d[2] - a[1][2] * a[1][2]) - a[0][1] * (a[0][1] * d[2] - a[1][2] * a[0][2]) + a[0][2] * (a[0][1] * a[1][2] - d[1] * a[0][2])
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0))))
    phi = F.acos(r) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return high, 3 * q - high - low, low


def aligned_rmsd(atoms: DataFrame) -> DataFrame:
    """Root mean square over the components between each frame and the next of its trajectory, the
    next turned onto it about its own centre (Kabsch), atoms matched by id.

    One join and one aggregation to 16 sums a frame pair; the best rotation enters by the singular
    values of the 3 x 3 covariance alone, so no frame meets in a task. Their own centres stay where
    they are, as the second frame is turned, not moved.
    """
    nxt = atoms.select("conf_id", (F.col("frame") - 1).alias("frame"), "atom_id", *[F.col(c).alias(f"{c}2") for c in "xyz"])
    both = atoms.select("conf_id", "frame", "atom_id", "x", "y", "z").join(nxt, ["conf_id", "frame", "atom_id"])
    one = [F.sum(c).alias(f"s{c}") for c in ("x", "y", "z", "x2", "y2", "z2")]
    square = F.sum(sum((F.col(c) * F.col(c) for c in ("x", "y", "z", "x2", "y2", "z2")), F.lit(0.0)))
    cross = [F.sum(F.col(f"{b}2") * F.col(a)).alias(f"c{b}{a}") for b in "xyz" for a in "xyz"]
    s = both.groupBy("conf_id", "frame").agg(F.count("*").alias("n"), square.alias("sq"), *one, *cross)
    n = F.col("n")
    s = s.select(
        "conf_id", "frame", "n", *[(F.col(f"c{b}{a}") - F.col(f"s{b}2") * F.col(f"s{a}") / n).alias(f"c{b}{a}") for b in "xyz" for a in "xyz"],
        (F.col("sq") - sum((F.col(f"s{c}") * F.col(f"s{c}") for c in ("x", "y", "z", "x2", "y2", "z2")), F.lit(0.0)) / n).alias("spread"),
        (sum(((F.col(f"s{c}") - F.col(f"s{c}2")) * (F.col(f"s{c}") - F.col(f"s{c}2")) for c in "xyz"), F.lit(0.0)) / n).alias("shift"),
    )
    c = [[F.col(f"c{b}{a}") for a in "xyz"] for b in "xyz"]
    s = s.withColumns({f"g{i}{j}": sum((c[k][i] * c[k][j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(i, 3)})
    e1, e2, e3 = _eigenvalues([[F.col(f"g{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)])
    det = c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])
    root = lambda e: F.sqrt(F.greatest(F.lit(0.0), e))
    s = s.withColumns({"__s1": root(e1), "__s2": root(e2), "__s3": root(e3) * F.when(det < 0, -1.0).otherwise(1.0)})
    square = F.col("spread") + F.col("shift") - 2 * (F.col("__s1") + F.col("__s2") + F.col("__s3"))
    return s.select("conf_id", "frame", F.round(F.sqrt(F.greatest(F.lit(0.0), square) / (3 * n)), 5).alias("rmsd"), "n")


def is_redundant(measures: list[str]) -> Column:
    """Whether a frame repeats the next by every one of ``measures``; a missing value or NaN is no
    repetition. Spark takes NaN for more than any number, hence the guards."""
    out = F.lit(True)
    for c in measures:
        x = F.col(c).cast("double")
        holds = x < REDUNDANT_BELOW[c] if c in REDUNDANT_BELOW else x > REDUNDANT_ABOVE[c]
        out = out & F.coalesce(~F.isnan(x) & holds, F.lit(False))
    return out


def redundant_frames(rows: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """``rows`` with ``redundant``, by all ten measures that have a limit, or by those named.

    A measure without a column or without a limit is an error, as leaving it out would make more
    frames redundant without a word.
    """
    measures = [*REDUNDANT_BELOW, *REDUNDANT_ABOVE] if measures is None else measures
    if missing := [c for c in measures if c not in rows.columns or c not in REDUNDANT_BELOW | REDUNDANT_ABOVE]:
        raise ValueError(f"no column or no limit for {', '.join(missing)}")
    return rows.withColumn("redundant", is_redundant(measures))


def drop_redundant(rows: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of frames that are not redundant."""
    return rows.join(frames.where("redundant").select(*keys), keys, "left_anti")
