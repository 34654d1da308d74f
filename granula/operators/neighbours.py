"""Neighbour pairs by a cell grid: an equality join on cells, then the exact distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cut-off radii by unordered type pair, in angstrom.
CUTOFFS = {(1, 1): 3.5, (1, 2): 3.4, (2, 2): 3.3}
#: The cell itself and the 13 neighbours that come after it; the other 13 see it as theirs.
_HALF = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]


def cutoff(ti: Column, tj: Column) -> Column:
    low, high = F.least(ti, tj), F.greatest(ti, tj)
    out = F.lit(None).cast("double")
    for (a, b), r in CUTOFFS.items():
        out = F.when((low == a) & (high == b), F.lit(r)).otherwise(out)
    return out


def grid_pairs(atoms: DataFrame, reach: float, within: Column) -> DataFrame:
    """Unordered pairs i < j of a frame for which ``within`` (over ti, tj, d2) holds; no pair
    farther apart than ``reach`` may satisfy it. Columns frame, i, j, ti, tj, si, sj, dx, dy, dz, d2.

    Each atom stands in one cell and is looked for in half of the cells around, so the join is
    on equality of (frame, cell) and every pair is met once. Box edges need no images as long as
    the buffer around the particle is at least ``reach``.
    """
    n = [F.floor(F.col(c) / reach).cast("long") for c in "xyz"]
    cell = F.shiftleft(n[0], 42) + F.shiftleft(n[1], 21) + n[2]
    sides = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("atom_id", "type_id", "surf", "x", "y", "z")]
    a = atoms.select("frame", *sides("a"), cell.alias("cell"))
    steps = F.array(*[F.lit((i << 42) + (j << 21) + k) for i, j, k in _HALF])
    b = atoms.select("frame", *sides("b"), cell.alias("own"), F.explode(steps).alias("step")).withColumn("cell", F.col("own") - F.col("step"))
    # The side that is not expanded is the one to hash; a frame's cell is small.
    pairs = a.hint("shuffle_hash").join(b, ["frame", "cell"]).where((F.col("step") != 0) | (F.col("atom_id_a") < F.col("atom_id_b")))
    swap = F.col("atom_id_a") > F.col("atom_id_b")
    pick = lambda c, first: F.when(swap == F.lit(not first), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    out = pairs.select(
        "frame", pick("atom_id", True).alias("i"), pick("atom_id", False).alias("j"), pick("type_id", True).alias("ti"), pick("type_id", False).alias("tj"),
        pick("surf", True).alias("si"), pick("surf", False).alias("sj"), *[(pick(c, False) - pick(c, True)).alias(f"d{c}") for c in "xyz"],
    ).withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return out.where(within)


def _wrap(at: Column, n: Column, size: Column) -> Callable[[Column], Column]:
    return lambda k: F.when(size.isNull(), at + k).otherwise(F.pmod(at + k, n))


def periodic_pairs(atoms: DataFrame, boxes: DataFrame, reach: float, within: Column) -> DataFrame:
    """As :func:`grid_pairs`, between each atom and the nearest image of the other.

    ``boxes`` has a row a frame: frame, lx, ly, lz, the lengths of its cell from 0 on; a null length
    is no period. Atoms lie in their cell. A length is cut into whole cells, none narrower than
    ``reach``, whose numbers wrap around; where there are fewer than three, a cell's two neighbours
    are one and the same, or itself, so the cells to look in are made distinct and no pair is met
    twice. A difference of half a length and more goes to the image on the other side. Frames
    without a row in ``boxes`` have no pairs.
    """
    # A row a frame: Spark broadcasts it while it is small and shuffles it once it is not.
    placed = atoms.join(boxes.select("frame", *[F.col(f"l{c}").cast("double").alias(f"l{c}") for c in "xyz"]), "frame")
    own, around = [], []
    for c in "xyz":
        size = F.col(f"l{c}")
        n = F.greatest(F.lit(1), F.floor(size / reach)).cast("long")
        at = F.when(size.isNull(), F.floor(F.col(c) / reach)).otherwise(F.least(n - 1, F.greatest(F.lit(0), F.floor(F.col(c) / size * n)))).cast("long")
        wrapped = F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), _wrap(at, n, size))
        own.append(at.alias(f"k{c}"))
        around.append(F.array_distinct(wrapped).alias(f"n{c}"))
    sides = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("atom_id", "type_id", "surf", "x", "y", "z")]
    a = placed.select("frame", *sides("a"), *own)
    b = placed.select("frame", *sides("b"), "lx", "ly", "lz", *around)
    for c in "xyz":
        b = b.withColumn(f"k{c}", F.explode(f"n{c}"))
    pairs = a.hint("shuffle_hash").join(b, ["frame", "kx", "ky", "kz"]).where("atom_id_a < atom_id_b")
    ends = {"i": "atom_id_a", "j": "atom_id_b", "ti": "type_id_a", "tj": "type_id_b", "si": "surf_a", "sj": "surf_b"}
    d = [F.col(f"{c}_b") - F.col(f"{c}_a") for c in "xyz"]
    near = [F.when(F.col(f"l{c}").isNull(), x).otherwise(x - F.expr(f"cast(2 * ({c}_b - {c}_a) / l{c} AS long)") * F.col(f"l{c}")).alias(f"d{c}") for c, x in zip("xyz", d, strict=True)]
    out = pairs.select("frame", *[F.col(c).alias(name) for name, c in ends.items()], *near)
    return out.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).where(within)


def half_bonds(atoms: DataFrame, scale2: float = 1.0, boxes: DataFrame | None = None) -> DataFrame:
    """Each bond once: distance at most the pair's cut-off, its square scaled by ``scale2``; with ``boxes``
    (:func:`periodic_pairs`) to the nearest image."""
    c = cutoff(F.col("ti"), F.col("tj"))
    reach, within = max(CUTOFFS.values()) * scale2**0.5 + 1e-9, F.col("d2") <= c * c * scale2
    pairs = grid_pairs(atoms, reach, within) if boxes is None else periodic_pairs(atoms, boxes, reach, within)
    return pairs.withColumn("r", F.sqrt("d2"))


def both_ways(half: DataFrame) -> DataFrame:
    """Each bond from both ends."""
    turn = F.array(
        F.struct("i", "j", "ti", "tj", "si", "sj", "dx", "dy", "dz"),
        F.struct(*[F.col(b).alias(a) for a, b in (("i", "j"), ("j", "i"), ("ti", "tj"), ("tj", "ti"), ("si", "sj"), ("sj", "si"))], *[(-F.col(c)).alias(c) for c in ("dx", "dy", "dz")]),
    )
    return half.select("frame", "r", F.explode(turn).alias("e")).select("frame", "e.*", "r")


def in_local_box(atoms: DataFrame, half: float) -> DataFrame:
    """(frame, atom_id, n): how many other atoms lie in the cube of edge 2 * ``half`` around each surface
    atom; surface atoms without any are left out."""
    near = (F.abs("dx") <= half) & (F.abs("dy") <= half) & (F.abs("dz") <= half)
    pairs = grid_pairs(atoms, half + 1e-9, near)
    ends = pairs.select("frame", F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("si").alias("s")), F.struct(F.col("j").alias("a"), F.col("sj").alias("s")))).alias("e"))
    return ends.where("e.s = 1").groupBy("frame", F.col("e.a").alias("atom_id")).agg(F.count("*").alias("n"))
