"""Mutual information of two continuous columns by distances to nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that are compared with all others at once.
_BLOCK = 256


def digamma(n: np.ndarray) -> np.ndarray:
    """Digamma of whole numbers from 1 on: harmonic numbers less Euler's constant."""
    top = int(n.max(initial=1))
    return (np.r_[0.0, np.cumsum(1 / np.arange(1, top + 1))] - np.euler_gamma)[n - 1]


def nearest_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """The first estimator of Kraskov, Stoegbauer and Grassberger, in nats, not below 0.

    Both columns are scaled to unit variance. A point's radius is the distance in the larger
    coordinate to its k-th neighbour; neighbours nearer than that in one column are counted there, the point
    itself and points with the same value included.
    """
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return 0.0
    x, y = (v / (v.std() or 1.0) for v in (x, y))
    total = 0.0
    for s in range(0, n, _BLOCK):
        apart = [np.abs(v[s : s + _BLOCK, None] - v) for v in (x, y)]
        radius = np.partition(np.maximum(*apart), k, axis=1)[:, k, None]
        for d in apart:
            total += digamma(((d < radius) | (d == 0)).sum(1)).sum()
    return max(0.0, float(digamma(np.array([n]))[0] + digamma(np.array([k]))[0] - total / n))


def nearest_neighbour_information(rows: DataFrame, keys: list[str], x: str, y: str, k: int = 3) -> DataFrame:
    """(keys, n, mi): mutual information of ``x`` and ``y`` in each group.

    Rows with a null or NaN in either are left out; groups of one row have 0. A group's rows meet in
    one task and are compared in blocks of 256 rows, so memory grows with a group's size and time with its
    square: groups are frames or cases, not whole tables.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        a, b = (t.column(c).to_numpy().astype(float) for c in ("__x", "__y"))
        cells = [pa.array([t.column(c)[0].as_py()], t.schema.field(c).type) for c in keys]
        yield pa.record_batch([*cells, pa.array([len(a)], pa.int64()), pa.array([nearest_information(a, b, k)])], [*keys, "n", "mi"])

    pairs = rows.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x is not null and __y is not null and not isnan(__x) and not isnan(__y)")
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rows.select(*keys).dtypes), "n long", "mi double"])
    return pairs.groupBy(*keys).applyInArrow(measure, schema)
