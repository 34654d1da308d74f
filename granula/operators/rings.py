"""Rings of the bond graph that no path shortens, from shortest paths within a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granula.operators import paths

#: Pairs of atoms of a frame up to which a table says of each whether it is among some.
_TABLE = 1 << 26


def _among(keys: np.ndarray, n: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether pairs of ``n`` atoms, x * n + y, are among sorted ``keys``."""
    if n * n <= _TABLE:
        table = np.zeros(n * n, bool)
        table[keys] = True
        return lambda x, y: table[x * n + y]

    def look(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, x * n + y)
        return keys[np.minimum(at, len(keys) - 1)] == x * n + y

    return look


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, count): rows by ``key``, and where the rows of each key lie in that order."""
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)[: len(key)])
    return order, start, np.diff(np.append(start, len(key)))


def _pairs(order: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each two rows of one key, in both orders and a bounded number at a time."""
    run = np.repeat(np.arange(len(count)), count)
    for b in paths.blocks(count[run]):
        row, other = paths.ranges(start[run[b]], count[run[b]])
        yield order[b[row]], order[other]


def _count(i: np.ndarray, j: np.ndarray) -> dict[int, int]:
    """Rings by size of the graph with edges i-j (both directions; repeated ones and those of an atom with itself count for nothing)."""
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    n = len(ids)
    edges = np.unique(at[: len(i)] * n + at[len(i) :])
    x, y = np.divmod(edges, n)
    x, y, edges = x[x != y], y[x != y], edges[x != y]
    out = dict.fromkeys((3, 4, 5, 6), 0)
    if not len(x):
        return out
    count = np.bincount(x, minlength=n)
    start = np.cumsum(count) - count

    def on(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, neighbour) for each neighbour of the atom of each row."""
        of, place = paths.ranges(start[row], count[row])
        return of, y[place]

    bonded = _among(edges, n)
    # All that is one or two bonds away, a bounded number of paths at a time.
    near = [edges]
    for b in paths.blocks(count[y]):
        of, c = on(y[b])
        near.append(np.unique(x[b][of] * n + c))
    near = _among(np.unique(np.concatenate(near)), n)
    ways = np.bincount(x, count[y], n)
    for some in paths.blocks(np.bincount(x, ways[y], n).astype(np.int64)):
        # From the least atom a over b to c.
        of, b = on(some)
        a = some[of]
        a, b = a[a < b], b[a < b]
        of, c = on(b)
        a, b = a[of], b[of]
        a, b, c = (v[c > a] for v in (a, b, c))
        closed = bonded(a, c)
        out[3] += int((closed & (b < c)).sum())
        a, b, c = (v[~closed] for v in (a, b, c))
        order, begin, size = _runs(a * n + c)
        for u, v in _pairs(order, begin, size):
            u, v = u[b[u] < b[v]], v[b[u] < b[v]]
            out[4] += int((~bonded(b[u], b[v])).sum())
        # On to d: of five, it is the end of another way from a; of six, three bonds from a.
        of, d = on(c)
        of, d = of[d > a[of]], d[d > a[of]]
        further = of[c[of] < d], d[c[of] < d]
        ends = (a * n + c)[order[begin]]
        if len(ends):
            key = a[further[0]] * n + further[1]
            found = np.searchsorted(ends, key)
            hit = ends[np.minimum(found, len(ends) - 1)] == key
            one, end, found = further[0][hit], further[1][hit], found[hit]
            for k in paths.blocks(size[found]):
                row, place = paths.ranges(begin[found[k]], size[found[k]])
                u, v, d_ = one[k][row], order[place], end[k][row]
                out[5] += int(((b[u] != b[v]) & ~bonded(b[u], d_) & ~bonded(b[v], c[u]) & ~bonded(b[u], b[v])).sum())
        far = ~near(a[of], d)
        of, d = of[far], d[far]
        a, b, c = a[of], b[of], c[of]
        for u, v in _pairs(*_runs(a * n + d)):
            u, v = u[c[u] < c[v]], v[c[u] < c[v]]
            p, q, c_, g = b[u], b[v], c[u], c[v]
            out[6] += int(((p != q) & ~bonded(c_, g) & ~bonded(p, q) & ~near(p, g) & ~near(q, c_)).sum())
    return out


def rings(bonds: DataFrame) -> DataFrame:
    """(frame, size, n): rings of three to six atoms in which any two atoms are as far apart by bonds as they are
    along the ring, each counted once. ``bonds`` (frame, i, j) hold both directions.

    A ring of 2m atoms is two shortest paths of m bonds between opposite atoms, one of 2m + 1 an atom and a
    bond opposite it; its least atom comes first, so it is met once. Paths are many times the bonds, so they are no rows: each frame's
    bonds are one group, whose paths are followed by arrays from some atoms after the other. Repeated bonds count once, bonds of an atom
    with itself not at all; a size without a ring has no row.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (i, j) = paths.columns(batches, ["i", "j"])
        found = {k: m for k, m in _count(i, j).items() if m}
        yield from paths.rows_of(t, {"size": np.array(list(found), np.int32), "n": np.array(list(found.values()), np.int64)})

    b = bonds.where("i <> j").select("frame", "i", "j")
    return b.groupBy("frame").applyInArrow(count, f"frame {b.schema['frame'].dataType.simpleString()}, size int, n long")
