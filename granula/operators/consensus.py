"""One clustering from many: average linkage over how often points fall together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_linkage(distance: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of weighted points by mean distance, in order; a < b, the merged cluster keeps a.

    The nearest of the later points is remembered a row, so a merge looks at one column and renews
    only rows that pointed to it. Of equal distances (to 12 digits) the least a, then b counts.
    """
    d, sizes, n = np.round(distance.astype(float), 12), sizes.astype(float).copy(), len(distance)
    d[np.tril_indices(n)] = np.inf
    near, least = (d.argmin(1), d.min(1)) if n else (None, None)
    out = []
    for _ in range(n - 1):
        a = int(least.argmin())
        b = int(near[a])
        out.append((a, b, float(least[a])))
        row = lambda i: np.minimum(d[i], d[:, i])
        merged = np.round((sizes[a] * row(a) + sizes[b] * row(b)) / (sizes[a] + sizes[b]), 12)
        sizes[a] += sizes[b]
        d[b], d[:, b], least[b] = np.inf, np.inf, np.inf
        merged[b] = np.inf
        d[a, a + 1 :], d[:a, a] = merged[a + 1 :], merged[:a]
        stale = np.flatnonzero(((near == a) | (near == b)) & np.isfinite(least))
        for i in np.union1d(stale, [a]):
            near[i], least[i] = d[i].argmin(), d[i].min()
        closer = np.flatnonzero((d[:a, a] < least[:a]) | ((d[:a, a] == least[:a]) & (near[:a] > a)))
        near[closer], least[closer] = a, d[closer, a]
    return out


def cut(merges: list[tuple[int, int, float]], n: int, most: int) -> np.ndarray:
    """A label a point after all merges up to the least height that leaves ``most`` clusters at most; merges of one
    height, to nine digits, happen together."""
    up = np.arange(n)

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    left, last = n, None
    for a, b, h in merges:
        h = round(h, 9)
        if left <= most and h != last:
            break
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
        left, last = left - 1, h
    return np.array([find(x) for x in range(n)])


def consensus(labels: DataFrame, case: str, ident: str, run: str, label: str, clusters: int) -> DataFrame:
    """(case, ident, cluster): at most ``clusters`` clusters of each case's points from the labels of many runs.

    Two points are as far apart as the share of runs that part them; clusters merge by mean distance
    (average linkage) and are cut as :func:`cut` says. Points with one label in every run are
    one weighted point: they are grouped by their labels first, so what meets in a task is a case's
    distinct combinations of labels and not its points. Clusters are numbered from 1 in the order
    of their least ``ident``. A run without a label for a point counts as a label of its own
    (null); of repeated rows the least label counts.
    """
    one = labels.groupBy(case, ident, run).agg(F.min(label).alias("l"))
    runs = one.groupBy(case).agg(F.array_sort(F.collect_set(run)).alias("runs"))
    each = one.groupBy(case, ident).agg(F.map_from_entries(F.collect_list(F.struct(F.col(run), F.col("l").cast("string")))).alias("m"))
    vectors = each.join(runs, case).select(case, ident, F.expr("transform(runs, r -> coalesce(try_element_at(m, r), ''))").alias("v"))
    points = vectors.groupBy(case, "v").agg(F.count("*").alias("n"), F.min(ident).cast("long").alias("least"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("least")
        lists = t.column("v").to_pylist()
        v = np.array(lists, dtype=object)
        apart = np.zeros((len(v), len(v)))
        for k in range(v.shape[1]):
            apart += v[:, k, None] != v[None, :, k]
        root = cut(average_linkage(apart / max(1, v.shape[1]), t.column("n").to_numpy()), len(v), clusters)
        _, number = np.unique(root, return_inverse=True)
        yield from pa.table({case: t.column(case), "v": pa.array(lists, pa.list_(pa.string())), "cluster": pa.array(number + 1, pa.int32())}).to_batches()

    kind = points.schema[case].dataType.simpleString()
    found = points.groupBy(case).applyInArrow(link, f"`{case}` {kind}, v array<string>, cluster int")
    return vectors.join(found, [case, "v"]).select(case, ident, "cluster")
