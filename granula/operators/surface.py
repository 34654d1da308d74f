"""Which atoms are at the surface, how it bends there, and what facet it is."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.operators import neighbours as nb
from granula.operators.paths import ranges


def sphere_points(n: int = 3000) -> np.ndarray:
    """``n`` points of a spiral over the unit sphere, evenly spread."""
    c = np.linspace(-1, 1, n)
    step = np.zeros(n)
    step[1:-1] = 3.6 / np.sqrt(n * (1 - c[1:-1] ** 2))
    phi = np.mod(np.cumsum(step), 2 * math.pi)
    phi[-1] = 0
    s = np.sqrt(np.maximum(0, 1 - c * c))
    return np.stack([s * np.cos(phi), s * np.sin(phi), c], 1)


#: Cells along an edge of each of the six faces of a cube around an atom, for directions.
_CELLS = 32


def _cells(u: np.ndarray) -> np.ndarray:
    """The cell (of 6 * _CELLS ** 2) that each direction (n, 3) is in, by where it leaves the cube."""
    axis = np.abs(u).argmax(1)
    rows = np.arange(len(u))
    most = u[rows, axis]
    at = [np.clip(((u[rows, (axis + k) % 3] / np.abs(most) + 1) * (_CELLS / 2)).astype(np.int64), 0, _CELLS - 1) for k in (1, 2)]
    return ((2 * axis + (most > 0)) * _CELLS + at[0]) * _CELLS + at[1]


@cache
def _reached(cone: float, points: int) -> tuple[np.ndarray, np.ndarray]:
    """(surely, possibly): for each cell of directions the points that are within ``cone`` degrees of all, of any direction in it, as bits."""
    edge = np.linspace(-1, 1, _CELLS + 1)
    lo, hi, mid = edge[:-1], edge[1:], (edge[:-1] + edge[1:]) / 2
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)

    def directions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of all faces, in the order of :func:`_cells`."""
        out = np.empty((3, 2, len(a), len(b), 3))
        for axis in range(3):
            for side in (0, 1):
                out[axis, side, ..., axis] = 2 * side - 1
                out[axis, side, ..., (axis + 1) % 3] = a[:, None]
                out[axis, side, ..., (axis + 2) % 3] = b
        return unit(out).reshape(-1, 3)

    centre = directions(mid, mid)
    # The farthest a direction of a cell can be from its centre is a corner.
    off = np.max([np.arccos(np.clip((centre * directions(a, b)).sum(1), -1, 1)) for a in (lo, hi) for b in (lo, hi)], axis=0) + 1e-7
    p, limit = sphere_points(points).T, math.radians(cone)
    bits = np.zeros((2, len(centre), -(-points // 64) * 8), np.uint8)
    for k in range(0, len(centre), 512):
        angle = np.arccos(np.clip(centre[k : k + 512] @ p, -1, 1))
        for n, near in enumerate((angle <= limit - off[k : k + 512, None], angle <= limit + off[k : k + 512, None])):
            packed = np.packbits(near, axis=1)
            bits[n, k : k + 512, : packed.shape[1]] = packed
    return bits[0].view(np.uint64), bits[1].view(np.uint64)


def _exposed(u: np.ndarray, start: np.ndarray, cone: float, points: int) -> np.ndarray:
    """Whether some of the points on a sphere around each of several atoms, whose directions ``u`` (n, 3) begin at ``start``, is farther than
    ``cone`` degrees from all of them.

    Cells of directions settle most atoms: one is exposed if a point is out of reach of all its cells, and not if all points are in reach
    of some cell wherever the direction is in it. The others are worked out point by point.
    """
    surely, possibly = _reached(cone, points)
    every = np.zeros(surely.shape[1] * 8, np.uint8)
    every[: -(-points // 8)] = np.packbits(np.ones(points, bool))
    every = every.view(np.uint64)
    cell = _cells(u)
    out = (np.bitwise_or.reduceat(possibly[cell], start, axis=0) != every).any(1)
    ends = np.append(start, len(u))
    open_ = np.flatnonzero(~out)
    if len(open_):
        row, at = ranges(start[open_], np.diff(ends)[open_])
        first = np.flatnonzero(np.append(True, np.diff(row) > 0))
        open_ = open_[(np.bitwise_or.reduceat(surely[cell[at]], first, axis=0) != every).any(1)]
    p, limit = sphere_points(points).T, math.cos(math.radians(cone))
    for k in open_:
        out[k] = (u[ends[k] : ends[k + 1]] @ p).max(0).min() < limit
    return out


def cone_surface(atoms: DataFrame, cone: float = 45.0, points: int = 3000, block: int = 256) -> DataFrame:
    """(frame, atom_id, surface): 1 if some direction from the atom has no neighbour of the extended
    shell within ``cone`` degrees; atoms without neighbours are at the surface.

    A task takes ``block`` atoms of a frame with their bonds, so large frames are spread; the points
    are a parameter's worth of numbers made in each task.
    """
    bonds = nb.both_ways(nb.half_bonds(atoms, 2.0)).where("r > 0").select("frame", "i", *[(F.col(f"d{c}") / F.col("r")).alias(c) for c in "xyz"])

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i = t.column("i").to_numpy()
        turn = np.argsort(i, kind="stable")
        i, u = i[turn], np.stack([t.column(c).to_numpy() for c in "xyz"], 1)[turn]
        ids, start = np.unique(i, return_index=True)
        frame = t.column("frame")[0].as_py()
        yield pa.record_batch([pa.array(np.full(len(ids), frame)), pa.array(ids), pa.array(_exposed(u, start, cone, points).astype(np.int32))], ["frame", "atom_id", "surface"])

    found = bonds.withColumn("b", F.expr(f"i div {block}")).groupBy("frame", "b").applyInArrow(flags, "frame long, atom_id long, surface int")
    return atoms.select("frame", "atom_id").join(found, ["frame", "atom_id"], "left").fillna(1, ["surface"])


def _ring(u: np.ndarray) -> np.ndarray:
    """Order of the unit vectors of each of several rings (rings, members, 3): from the first, always on to the
    nearest that is left, the first of equal ones."""
    rings, n, _ = u.shape
    every, cos = np.arange(rings), np.einsum("rik,rjk->rij", u, u)
    order, left = np.zeros((rings, n), np.int64), np.ones((rings, n), bool)
    left[:, 0] = False
    for k in range(1, n):
        order[:, k] = np.argmax(np.where(left, cos[every, order[:, k - 1]], -np.inf), 1)
        left[every, order[:, k]] = False
    return order


def _bend(u: np.ndarray, inward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of several rings of one size (angles between ring members, angles between the mean normal and
    those of adjacent pairs) in degrees."""
    v = np.take_along_axis(u, _ring(u)[:, :, None], 1)
    w = np.roll(v, -1, 1)
    angles = np.degrees(np.arccos(np.clip((v * w).sum(2), -1, 1)))
    if u.shape[1] < 3:
        return angles, np.zeros(angles.shape)
    normals = np.cross(v, w)
    size = np.linalg.norm(normals, axis=2)
    some = size > 0
    normals /= np.where(some, size, 1)[:, :, None]
    normals[np.einsum("rik,rk->ri", normals, inward) > 0] *= -1
    mean = normals.sum(1) / np.maximum(some.sum(1), 1)[:, None]
    length = np.linalg.norm(mean, axis=1)
    dot = np.einsum("rik,rk->ri", normals, mean / np.where(length > 0, length, 1)[:, None])
    dot[np.abs(dot - 1) < 1e-6] = 1
    return angles, np.where(some, np.degrees(np.arccos(np.clip(dot, -1, 1))), 0.0)


def _facet(angles: np.ndarray, curves: np.ndarray) -> np.ndarray:
    """For each of several rings of one size 1: 100, 2: 111, 3: 110, 4: 311, 0: none, by ring size, curvature and angles."""
    n, between = angles.shape[1], lambda lo, hi: ((angles >= lo) & (angles <= hi)).all(1)
    flat, bent = (curves <= 15).all(1), (curves >= 15).all(1)
    if n == 4:
        return np.where(flat & between(70, 110), 1, 0)
    if n == 6:
        return np.where(between(40, 80), np.where(bent, 3, np.where(flat, 2, 0)), 0)
    if n == 5:
        near = ((angles > 50) & (angles < 70)).sum(1), ((angles > 80) & (angles < 100)).sum(1)
        return np.where(bent & (near[0] == 3) & (near[1] == 2), 4, 0)
    return np.zeros(len(angles), np.int64)


def curvature(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(frame, atom_id, curve, facet) of the surface atoms (surf = 1): the mean angle in degrees between
    the ring's mean normal and the normals of its adjacent pairs, 0 with fewer than three surface
    neighbours, and the facet class. A row's work is bounded by an atom's neighbours."""
    ring = F.array_sort(F.collect_list(F.when((F.col("si") == 1) & (F.col("sj") == 1), F.struct("j", *[(F.col(f"d{c}") / F.col("r")).alias(c) for c in "xyz"]))))
    rows = bonds.where("si = 1 and r > 0").groupBy("frame", F.col("i").alias("atom_id")).agg(ring.alias("ring"), *[F.sum(f"d{c}").alias(c) for c in "xyz"])

    def bend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inward = np.stack([b.column(c).to_numpy() for c in "xyz"], 1)
            inward /= np.maximum(np.linalg.norm(inward, axis=1, keepdims=True), 1e-300)
            curve, facet = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            ring = b.column("ring")
            members, count = ring.flatten(), np.diff(ring.offsets.to_numpy())
            u, start = np.stack([members.field(c).to_numpy() for c in "xyz"], 1), np.cumsum(count) - count
            for n in np.unique(count[count > 1]).tolist():  # all atoms with rings of one size at once
                rows = np.flatnonzero(count == n)
                angles, curves = _bend(u[start[rows, None] + np.arange(n)], inward[rows])
                curve[rows], facet[rows] = curves.mean(1), _facet(angles, curves)
            yield pa.record_batch([b.column("frame"), b.column("atom_id"), pa.array(curve), pa.array(facet)], ["frame", "atom_id", "curve", "facet"])

    found = rows.mapInArrow(bend, "frame long, atom_id long, curve double, facet int")
    return atoms.where("surf = 1").select("frame", "atom_id").join(found, ["frame", "atom_id"], "left").fillna(0.0, ["curve"]).fillna(0, ["facet"])


def whole_degrees() -> Column:
    """Curvature in whole degrees, 0 counted as 1."""
    return F.greatest(F.lit(1), F.floor(F.col("curve") + 0.5)).cast("int")


def curvature_histogram(curves: DataFrame) -> DataFrame:
    """Surface atoms by whole degrees of curvature, 0 counted as 1."""
    return curves.groupBy("frame", whole_degrees().alias("bin")).agg(F.count("*").alias("n"))


def facet_counts(curves: DataFrame) -> DataFrame:
    """Surface atoms of each frame on 100, 111, 110 and 311 facets."""
    return curves.groupBy("frame").agg(*[F.count_if(F.col("facet") == k).alias(f"f{name}") for k, name in ((1, "100"), (2, "111"), (3, "110"), (4, "311"))])
