"""Angles along the bonds of a frame, counted where the frame is, and numbers of its atoms that take several looks at the bonds.

A frame's paths of two and three bonds are by far more than its bonds, so they are no rows: Spark groups the bonds by frame, and
arrays of one frame's paths, a bounded number at a time, are counted in its task. Only counts, or a row an atom, leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths that are held at once.
_BLOCK = 1 << 18
#: Coefficients by falling power of 16 times the m-th derivative of the Legendre polynomial P6.
_P6 = [{6: 231, 4: -315, 2: 105, 0: -5}, {5: 1386, 3: -1260, 1: 210}, {4: 6930, 2: -3780, 0: 210}, {3: 27720, 1: -7560}, {2: 83160, 0: -7560}, {1: 166320}, {0: 166320}]
#: Angles are rounded to whole degrees after six decimals; half of the last decimal.
_ROUND = 0.5 + 5e-7


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the columns of two arrays (3, n)."""
    return np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])


def ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row the ``count`` places from its ``start`` on."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) + np.repeat(start - (np.cumsum(count) - count), count)


def by_end(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, count): rows by their atom ``at``, one of ``n``."""
    count = np.bincount(at, minlength=n)
    return np.argsort(at, kind="stable"), np.cumsum(count) - count, count


def blocks(count: np.ndarray) -> Iterator[np.ndarray]:
    """All rows in runs whose ``count`` comes to about as much as is held at once."""
    total = np.cumsum(count)
    cuts = np.searchsorted(total, np.arange(_BLOCK, total[-1] if len(total) else 0, _BLOCK))
    return (b for b in np.split(np.arange(len(count)), np.unique(cuts)) if len(b))


def columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> tuple[pa.Table, list[np.ndarray]]:
    t = pa.Table.from_batches(list(batches))
    return t, [t.column(c).to_numpy() for c in names]


def rows_of(t: pa.Table, values: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``values`` behind the frame of ``t``, whose rows are of one frame."""
    n = len(next(iter(values.values())))
    if n:
        yield from pa.table({"frame": t.column("frame").take(pa.array(np.zeros(n, np.int64))), **values}).to_batches()


def _turns(v: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of planes with normals ``v`` (3, n) through two bonds each: which are none, as the bonds are in line, and how far the others
    are turned, in degrees, about the middle bond from ``first`` over ``second``, both perpendicular to it."""
    flat = (np.abs(v[0]) < 0.1) & (np.abs(v[1]) <= 0.1) & (np.abs(v[2]) <= 0.1)
    return flat, np.degrees(np.arctan2((v * second).sum(0), (v * first).sum(0)))


def _count(i: np.ndarray, j: np.ndarray, u: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
    """(kinds, kinds, 361): directed paths i-j-k-l with j < k by ``kind`` of the bonds at their ends (as they are passed) and whole
    degrees from -180 on. ``u`` (3, n) are the bonds' unit vectors.

    About its middle bond each end's plane has an angle of its own; a path's dihedral angle is the difference of two.
    """
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    begin, end = at[: len(i)], at[len(i) :]
    coming, coming_start, coming_count = by_end(end, len(ids))
    going, going_start, going_count = by_end(begin, len(ids))
    middle = np.flatnonzero(i < j)
    out = np.zeros(kinds * kinds * 361, np.int64)
    for b in blocks(coming_count[begin[middle]] * going_count[end[middle]]):
        b = middle[b]
        axis = u[:, b]
        aside = np.eye(3)[:, np.abs(axis).argmin(0)]
        first = cross(axis, aside)
        first /= np.sqrt((first * first).sum(0))
        second = cross(axis, first)
        ends = []
        for order, start, count, of, other, before in ((coming, coming_start, coming_count, begin, begin, True), (going, going_start, going_count, end, end, False)):
            row, place = ranges(start[of[b]], count[of[b]])
            edge = order[place]
            far = other[edge]
            apart = far != (end if before else begin)[b][row]
            row, edge, far = row[apart], edge[apart], far[apart]
            v = cross(u[:, edge], axis[:, row]) if before else cross(axis[:, row], u[:, edge])
            flat, turn = _turns(v, first[:, row], second[:, row])
            ends.append((row[~flat], far[~flat], turn[~flat], kind[edge[~flat]]))
        (row, i_, alpha, k_in), (other_row, l_, beta, k_out) = ends
        n = np.bincount(other_row, minlength=len(b))
        left, right = ranges((np.cumsum(n) - n)[row], n[row])
        whole = i_[left] != l_[right]
        left, right = left[whole], right[whole]
        deg = alpha[left] - beta[right]
        deg -= 360 * np.rint(deg / 360)
        bins = np.copysign(np.floor(np.abs(deg) + _ROUND), deg).astype(np.int64)
        out += np.bincount((k_in[left] * kinds + k_out[right]) * 361 + bins + 180, minlength=len(out))
    return out.reshape(kinds, kinds, 361)


def _halves(n: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(bins, counts) of each half of counts (..., 361); 0 and 180 count in both."""
    ends = n[..., :1] + n[..., -1:]
    return {"neg": (np.arange(-180, 1), np.concatenate([ends, n[..., 1:181]], -1)), "pos": (np.arange(181), np.concatenate([n[..., 180:360], ends], -1))}


def _angles(i: np.ndarray, j: np.ndarray, d: np.ndarray, r: np.ndarray, kind: np.ndarray, kinds: int, last: np.ndarray, lasts: int, second: bool) -> np.ndarray:
    """(kinds, lasts, 181): angles in whole degrees, 0 counted as 1, by the ``kind`` of one bond and what is ``last`` of the other: at each
    atom between its bonds to j < k, or (``second``) at i between the bond to j and the way on to k, another atom than i. ``d`` (3, n) are the bonds."""
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    begin, end = at[: len(i)], at[len(i) :]
    order, start, count = by_end(begin, len(ids))
    turn = end if second else begin
    out = np.zeros(kinds * lasts * 181, np.int64)
    for b in blocks(count[turn]):
        row, place = ranges(start[turn[b]], count[turn[b]])
        one, two = b[row], order[place]
        some = end[two] != begin[one] if second else end[one] < end[two]
        one, two = one[some], two[some]
        a, c = d[:, one], d[:, two]
        if second:
            c = a + c
            far = np.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
            some = (r[one] > 0) & (far > 0)
            one, two, a, c, far = one[some], two[some], a[:, some], c[:, some], far[some]
            cos = (a[0] * c[0] + a[1] * c[1] + a[2] * c[2]) / (r[one] * far)
        else:
            cos = a[0] * c[0] + a[1] * c[1] + a[2] * c[2]
        deg = np.degrees(np.arccos(np.clip(cos, -1, 1)))
        bins = np.maximum(1, np.floor(deg + _ROUND)).astype(np.int64)
        out += np.bincount((kind[one] * lasts + last[two]) * 181 + bins, minlength=len(out))
    return out.reshape(kinds, lasts, 181)


def _unit(t: list[np.ndarray]) -> np.ndarray:
    *d, r = t
    return np.stack([x / r for x in d])


def _rows(kind: str, types: list[np.ndarray | None], n: np.ndarray, s1: np.ndarray, bins: np.ndarray | None = None, s2: np.ndarray | None = None, most: np.ndarray | None = None, least: np.ndarray | None = None) -> pa.Table:
    """Rows of :func:`sums` of one kind; what is not given is null."""
    long = len(n)
    column = lambda x, of: pa.nulls(long, of) if x is None else pa.array(x.astype(of.to_pandas_dtype()), of)
    out = {"kind": pa.array([kind] * long, pa.string())} | {c: column(x, pa.int32()) for c, x in zip(("ti", "tj", "tk", "tl"), [*types, *[None] * (4 - len(types))], strict=True)}
    return pa.table(out | {"bin": column(bins, pa.int64()), "n": column(n, pa.int64())} | {c: column(x, pa.float64()) for c, x in (("s1", s1), ("s2", s2), ("most", most), ("least", least))})


_ROWS = "kind string, ti int, tj int, tk int, tl int, bin long, n long, s1 double, s2 double, most double, least double"


def _degree_rows(kind: str, types: list[np.ndarray], bins: np.ndarray, n: np.ndarray) -> pa.Table:
    """Number, sum, sum of squares and extremes of whole degrees ``bins`` by rows ``n`` of counts, none of them empty."""
    some = n > 0
    return _rows(kind, types, n.sum(1), n @ bins, None, n @ (bins * bins), bins[len(bins) - 1 - some[:, ::-1].argmax(1)], bins[some.argmax(1)])


def _length_rows(ti: np.ndarray, tj: np.ndarray, r: np.ndarray) -> pa.Table:
    low, high = np.minimum(ti, tj), np.maximum(ti, tj)
    order = np.lexsort((high, low))
    low, high, r = low[order], high[order], r[order]
    start = np.flatnonzero(np.append(True, (np.diff(low) != 0) | (np.diff(high) != 0))[: len(r)])
    by = lambda f, x: f.reduceat(x, start) if len(start) else x
    return _rows("BL", [low[start], high[start]], np.diff(np.append(start, len(r))), by(np.add, r), None, by(np.add, r * r), by(np.maximum, r), by(np.minimum, r))


def _angle_rows(i: np.ndarray, j: np.ndarray, ti: np.ndarray, tj: np.ndarray, d: np.ndarray, r: np.ndarray, kinds: tuple[str, ...]) -> list[pa.Table]:
    types, at = np.unique(np.concatenate([ti, tj]), return_inverse=True)
    last = at[len(i) :]
    pairs, kind = np.unique(at[: len(i)] * len(types) + last, return_inverse=True)
    a, b = (types[x] for x in np.divmod(pairs, len(types)))
    found = []
    if "BA2" in kinds:
        n = _angles(i, j, d, r, kind, len(pairs), last, len(types), True)
        p, q = np.nonzero(n.any(2))
        found.append(_degree_rows("BA2", [a[p], b[p], types[q]], np.arange(181), n[p, q]))
    far = r > 0
    i, j, last, kind, u = i[far], j[far], last[far], kind[far], d[:, far] / r[far]
    if "BA1" in kinds:
        n = _angles(i, j, u, r[far], kind, len(pairs), last, len(types), False)
        p, q = np.nonzero(n.any(2))
        found.append(_degree_rows("BA1", [a[p], b[p], types[q]], np.arange(181), n[p, q]))
    if "BT" in kinds:
        n = _count(i, j, u, kind, len(pairs))
        for half, (bins, c) in _halves(n).items():
            p, q = np.nonzero(c.any(2))
            along = zip([a[p], b[p], a[q], b[q]], [b[q], a[q], b[p], a[p]], strict=True)  # from both ends
            found.append(_degree_rows(f"BT{half}", [np.concatenate(x) for x in along], bins, np.tile(c[p, q], (2, 1))))
    return found


def _histogram_rows(kind: str, groups: list[np.ndarray | None], bins: np.ndarray, values: np.ndarray) -> pa.Table:
    """Atoms, and the sum of their ``values``, by ``groups`` (None: none) and bin."""
    keys = [np.zeros_like(bins) if g is None else g for g in groups] + [bins]
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    start = np.flatnonzero(np.append(True, np.any([np.diff(k) != 0 for k in keys], axis=0))[: len(order)])
    *of, bins = (k[start] for k in keys)
    return _rows(kind, [None if g is None else x for g, x in zip(groups, of, strict=True)], np.diff(np.append(start, len(order))), np.add.reduceat(values[order].astype(float), start) if len(start) else values, bins)


def _atom_rows(kind: np.ndarray, surf: np.ndarray, begin: np.ndarray, end: np.ndarray, d: np.ndarray, r: np.ndarray, threshold: float) -> list[pa.Table]:
    n = len(kind)
    up = lambda x: np.ceil(x).astype(np.int64)
    cn, gcn = _generalised(begin, end, n, 12)
    gcn = _six(gcn)
    inner, outer = (surf[begin] == 1) & (surf[end] == 1), surf == 1
    own, gown = _generalised(begin[inner], end[inner], n, None)
    gown = _six(gown)
    far = r > 0
    q6q6 = _alike(begin[far], end[far], d[:, far] / r[far], n, threshold)
    t, s = kind, surf
    return [
        _histogram_rows("CN", [t, s], cn, cn), _histogram_rows("GCN", [t, s], up(gcn), np.rint(gcn * 12)), _histogram_rows("q6q6", [None, s], q6q6, q6q6),
        _histogram_rows("SOCN", [t[outer], None], own[outer], own[outer]), _histogram_rows("SOGCN", [t[outer], None], up(gown)[outer], np.rint(gown * 1e6)[outer]),
    ]


def _six(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def sums(bonds: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(frame, kind, ti, tj, tk, tl, bin, n, s1, s2, most, least): number, sum, sum of squares and extremes of angles along the ``bonds`` (both
    directions), in whole degrees, by the types on the way; a combination may have several rows. ``bin`` is null.

    Kinds: BA1, angles at an atom between neighbours j < k by its type and theirs; BA2, angles at i between j and k over i-j-k, k other than i; BT,
    dihedral angles over i-j-k-l as BTneg and BTpos (:func:`dihedral_histogram`). Bonds of length zero have no direction.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (i, j, ti, tj, *d, r) = columns(batches, ["i", "j", "ti", "tj", "dx", "dy", "dz", "r"])
        found = pa.concat_tables(_angle_rows(i, j, ti, tj, np.stack(d), r, kinds))
        yield from rows_of(t, {c: found.column(c) for c in found.column_names})

    b = bonds.select("frame", "i", "j", "ti", "tj", "dx", "dy", "dz", "r")
    return b.groupBy("frame").applyInArrow(add, f"frame {b.schema['frame'].dataType.simpleString()}, {_ROWS}")


def all_sums(atoms: DataFrame, half: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows as of :func:`sums` of all kinds, from one look at the bonds, ``half`` of which hold each once; further kinds are

    * BL, bond lengths by unordered types;
    * CN and GCN, atoms by type, surface flag and bin: neighbours, and the neighbours' numbers of neighbours over 12, rounded up; s1 is the sum of the
      neighbours, and of twelfths;
    * SOCN and SOGCN, surface atoms by type, likewise with neighbours on the surface alone, over the largest number of them; s1 of SOGCN is in millionths;
    * q6q6, atoms by surface flag (as ``tj``): neighbours with a like sixth-order bond-orientation vector (:func:`alike`).
    """
    def add(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, turn = np.unique(a.column("atom_id").to_numpy(), return_index=True)
        kind, surf = (a.column(c).to_numpy()[turn] for c in ("type_id", "surf"))
        i, j, *d, r = (b.column(c).to_numpy() for c in ("i", "j", "dx", "dy", "dz", "r"))
        i, j, d = np.searchsorted(ids, i), np.searchsorted(ids, j), np.stack(d)
        found = [_length_rows(kind[i], kind[j], r)]
        i, j, d, r = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, -d], 1), np.concatenate([r, r])
        found += [*_angle_rows(i, j, kind[i], kind[j], d, r, ("BA1", "BA2", "BT")), *_atom_rows(kind, surf, i, j, d, r, threshold)]
        out = pa.concat_tables(found)
        return out.add_column(0, "frame", a.column("frame").take(pa.array(np.zeros(out.num_rows, np.int64))))

    a = atoms.select("frame", "atom_id", F.col("type_id").cast("int").alias("type_id"), F.col("surf").cast("int").alias("surf"))
    b = half.select(F.col("frame").alias("of"), "i", "j", "dx", "dy", "dz", "r")
    return a.groupBy("frame").cogroup(b.groupBy("of")).applyInArrow(add, f"frame {a.schema['frame'].dataType.simpleString()}, {_ROWS}")


def _harmonics(u: np.ndarray) -> np.ndarray:
    """(13, n): the real harmonics of order 6 of unit vectors (3, n)."""
    x, y, z = u
    powers = [np.ones_like(z)]
    for _ in range(6):
        powers.append(powers[-1] * z)
    terms, re, im = [], np.ones_like(z), np.zeros_like(z)
    for m, poly in enumerate(_P6):
        norm = math.sqrt((2 if m else 1) * math.factorial(6 - m) / math.factorial(6 + m)) / 16
        p = sum(powers[e] * float(c) for e, c in poly.items()) * norm
        terms += [p * re, p * im] if m else [p * re]
        re, im = re * x - im * y, re * y + im * x
    return np.stack(terms)


def _alike(begin: np.ndarray, end: np.ndarray, u: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """How many neighbours of each of ``n`` atoms have a mean harmonic vector that points the same way."""
    order, start, count = by_end(begin, n)
    some = count > 0
    q = np.zeros((13, n))
    if len(order):
        q[:, some] = np.add.reduceat(_harmonics(u)[:, order], start[some], axis=1)
    length = np.sqrt((q * q).sum(0))
    q /= np.where(length > 0, length, 1)
    same = np.round(np.einsum("kn,kn->n", q[:, begin], q[:, end]), 9) > threshold
    return np.bincount(begin[same], minlength=n)


def _generalised(begin: np.ndarray, end: np.ndarray, n: int, largest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, their numbers of neighbours over ``largest``, or over the largest of them) of each of ``n`` atoms."""
    own = np.bincount(begin, minlength=n)
    cn, total, most = np.bincount(end, minlength=n), np.bincount(end, own[begin], n), np.zeros(n)
    np.maximum.at(most, end, own[begin])
    return cn, total / (np.maximum(most, 1) if largest is None else float(largest))


def alike(bonds: DataFrame, threshold: float) -> DataFrame:
    """(frame, atom_id, q6q6): neighbours of each atom with bonds that have a sixth-order bond-orientation vector pointing the same way;
    bonds (both directions) of length zero are left out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (i, j, *d) = columns(batches, ["i", "j", "dx", "dy", "dz", "r"])
        ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        yield from rows_of(t, {"atom_id": ids, "q6q6": _alike(at[: len(i)], at[len(i) :], _unit(d), len(ids), threshold)})

    b = bonds.where("r > 0").select("frame", "i", "j", "dx", "dy", "dz", "r")
    of = lambda c: b.schema[c].dataType.simpleString()
    return b.groupBy("frame").applyInArrow(count, f"frame {of('frame')}, atom_id {of('i')}, q6q6 long")


def dihedral_histogram(bonds: DataFrame) -> DataFrame:
    """(frame, half, bin, n): directed paths i-j-k-l of ``bonds`` (both directions) by their angle in whole degrees; 0 and 180
    count in both halves. A path has the same angle from both ends, so it is found from the one with j < k and counted twice."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (i, j, *d) = columns(batches, ["i", "j", "dx", "dy", "dz", "r"])
        n = 2 * _count(i, j, _unit(d), np.zeros(len(i), np.int64), 1)[0, 0]
        found = [(half, bins[c > 0], c[c > 0]) for half, (bins, c) in _halves(n).items()]
        half = np.repeat([h for h, _, _ in found], [len(b) for _, b, _ in found])
        yield from rows_of(t, {"half": pa.array(half.tolist(), pa.string()), "bin": np.concatenate([b for _, b, _ in found]).astype(np.int32), "n": np.concatenate([c for _, _, c in found])})

    b = bonds.where("r > 0").select("frame", "i", "j", "dx", "dy", "dz", "r")
    return b.groupBy("frame").applyInArrow(count, f"frame {b.schema['frame'].dataType.simpleString()}, half string, bin int, n long")
