"""Starting structures as tables of atoms: lattice shapes, alloys, layers, core and shell."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from granula.operators import neighbours as nb

#: Fixed value: empty space around a particle, half of it on each side.
VACUUM = 40.0
GOLDEN = (1 + math.sqrt(5)) / 2


def _grid(spark: SparkSession, reach: int, odd: bool = False) -> DataFrame:
    """Face-centred cubic sites in half lattice constants, up to ``reach`` on each axis: those of an
    even sum, or of an odd one if the centre is to lie between atoms."""
    n = 2 * reach + 1
    axis = spark.range(n * n).select((F.expr(f"id div {n}") - reach).alias("i"), (F.expr(f"id % {n}") - reach).alias("j"))
    k = F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))).alias("k")
    return axis.select("i", "j", k).where(F.pmod(F.col("i") + F.col("j") + F.col("k"), F.lit(2)) == int(odd))


def _placed(sites: DataFrame, half: float) -> DataFrame:
    return sites.select(*[(F.col(c) * half).alias(x) for c, x in zip("ijk", "xyz", strict=True)])


def octahedron(spark: SparkSession, length: int, cutoff: int, lattice: float) -> DataFrame:
    """(x, y, z) of an octahedron of ``length`` atoms an edge, ``cutoff`` layers off each corner: with
    length = 2 * cutoff + 1 a cuboctahedron, with 3 * cutoff + 1 a regular truncated octahedron."""
    r = length - 1
    i, j, k = (F.abs(c) for c in "ijk")
    return _placed(_grid(spark, r, bool(r % 2)).where((i + j + k <= r) & (F.greatest(i, j, k) <= r - cutoff)), lattice / 2)


def cube(spark: SparkSession, layers: int, lattice: float) -> DataFrame:
    """A cube with ``layers`` layers on each side of the central atom."""
    return _placed(_grid(spark, layers), lattice / 2)


def rhombic_dodecahedron(spark: SparkSession, layers: int, lattice: float) -> DataFrame:
    """A body bounded by 110 and 100 planes, ``layers`` from the centre."""
    two = [F.abs(F.col(a)) + F.abs(F.col(b)) for a, b in ("ij", "jk", "ik")]
    return _placed(_grid(spark, layers).where(F.greatest(*two) <= layers), lattice / 2)


def tetrahedron(spark: SparkSession, edge: int, lattice: float) -> DataFrame:
    """A tetrahedron of ``edge`` atoms an edge: whole combinations of its four corners."""
    n = edge - 1
    upto = lambda c: F.sequence(F.lit(0), c)
    t = spark.range(1).select(F.explode(upto(F.lit(n))).alias("a")).select("a", F.explode(upto(n - F.col("a"))).alias("b"))
    t = t.select("a", "b", F.explode(upto(n - F.col("a") - F.col("b"))).alias("c")).withColumn("d", n - F.col("a") - F.col("b") - F.col("c"))
    a, b, c, d = (F.col(x) for x in "abcd")
    half = lattice / 4
    return t.select(((a - b - c + d) * half).alias("x"), ((-b + a - d + c) * half).alias("y"), ((a - c + b - d) * half).alias("z"))


def icosahedron(spark: SparkSession, shells: int, lattice: float) -> DataFrame:
    """An icosahedron: a central atom and ``shells`` - 1 shells around it, each its corners and what
    lies evenly between them. The corners are 12 fixed directions."""
    corners = [(0, s, t * GOLDEN) for s in (-1, 1) for t in (-1, 1)]
    corners = [p[k:] + p[:k] for p in corners for k in range(3)]
    c = np.array(corners) / math.sqrt(1 + GOLDEN**2)
    dist = np.linalg.norm(c[:, None] - c[None], axis=2)
    near = (dist > 0) & (dist < 1.2)
    edges = [(i, j) for i in range(12) for j in range(i) if near[i, j]]
    faces = [(i, j, k) for i, j in edges for k in range(j) if near[i, k] and near[j, k]]
    # A site is u a + v b + w c with u + v + w the shell's number: corners, edges and faces as one table.
    parts = [((i,), "1") for i in range(12)] + [(e, "2") for e in edges] + [(f, "3") for f in faces]
    rows = [(len(p), *c[p[0]].tolist(), *c[p[min(1, len(p) - 1)]].tolist(), *c[p[-1]].tolist()) for p, _ in parts]
    t = spark.createDataFrame(rows, "kind int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    t = t.select("*", F.explode(F.sequence(F.lit(1), F.lit(max(shells - 1, 1)))).alias("n")).where(F.lit(shells > 1))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("u")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("u"))).alias("v")).withColumn("w", F.col("n") - F.col("u") - F.col("v"))
    t = t.where("(kind = 1 and u = n) or (kind = 2 and w = 0 and u > 0 and v > 0) or (kind = 3 and u > 0 and v > 0 and w > 0)")
    # Radial spacing such that neighbours along a radius are a lattice constant over the root of 2 apart.
    step = lattice / math.sqrt(2)
    out = t.select(*[((F.col("u") * F.col(f"a{x}") + F.col("v") * F.col(f"b{x}") + F.col("w") * F.col(f"c{x}")) * step).alias(x) for x in "xyz"])
    return out.unionByName(spark.range(1).select(*[F.lit(0.0).alias(x) for x in "xyz"]))


def decahedron(spark: SparkSession, edge: int, lattice: float) -> DataFrame:
    """A pentagonal bipyramid of ``edge`` atoms an edge: around an axis of ``edge`` atoms, ring r has 5 r
    columns of ``edge`` - r atoms."""
    b = lattice / math.sqrt(2)
    r = spark.range(edge).select(F.col("id").cast("int").alias("r"))
    col = r.select("r", F.explode(F.when(F.col("r") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), 5 * F.col("r") - 1))).alias("m"))
    t = col.select("r", "m", F.explode(F.sequence(F.lit(0), edge - 1 - F.col("r"))).alias("k"))
    side = F.expr("(m - pmod(m, greatest(r, 1))) / greatest(r, 1)")
    part = F.expr("pmod(m, greatest(r, 1)) / greatest(r, 1)")
    at = lambda f: (1 - part) * f(side * (2 * math.pi / 5)) + part * f((side + 1) * (2 * math.pi / 5))
    radius = F.col("r") * (b * math.sqrt(3) / 2)
    return t.select((radius * at(F.cos)).alias("x"), (radius * at(F.sin)).alias("y"), ((F.col("k") - (edge - 1 - F.col("r")) / 2) * b).alias("z"))


def in_vacuum(atoms: DataFrame, by: str, vacuum: float = VACUUM) -> DataFrame:
    """Particles moved so that half of ``vacuum`` lies before their least coordinates."""
    w = Window.partitionBy(by)
    return atoms.withColumns({c: F.col(c) - F.min(c).over(w) + vacuum / 2 for c in "xyz"})


def random_alloy(atoms: DataFrame, by: str, order: str, percent: float, seed: int, chance: str | None = None) -> DataFrame:
    """``atoms`` with ``second``: 1 where an atom becomes the second element. Atoms in ``order`` draw
    uniformly (above 1 - percent / 100, or below the column ``chance``); as many as are too many or
    too few are then turned at random, weighed by ``chance`` if given, so the count is exact.

    The draws are numpy's legacy stream, which stays the same over versions; a particle is one group.
    """
    names = atoms.columns

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        t = t.take(pa.array(np.argsort(t.column(order).to_numpy(), kind="stable")))
        n, random = t.num_rows, np.random.RandomState(seed)
        p = t.column(chance).to_numpy() if chance else None
        second = random.rand(n) < p if chance else random.rand(n) > (100 - percent) / 100
        change = int(second.sum()) - round(percent / 100 * n)
        among = np.flatnonzero(second if change > 0 else ~second)
        if change:
            weights = p[among] / p[among].sum() if chance and p[among].sum() > 0 else None
            # The correction has a stream of its own from the same seed.
            turned = np.random.RandomState(seed).choice(among, abs(change), replace=False, p=weights)
            second[turned] = change < 0
        yield from t.select(names).append_column("second", pa.array(second.astype(np.int32))).to_batches()

    return atoms.groupBy(by).applyInArrow(draw, StructType([*atoms.schema.fields, StructField("second", IntegerType())]))


def thread_position(atoms: DataFrame, by: str, axes: str = "xyz") -> DataFrame:
    """``atoms`` with ``chance``: how far out an atom lies on the lines through it along ``axes``, 0 in the
    middle and 1 at an end; 1 if it is the end of any line. Three windows over (particle, line)."""
    out = atoms
    for c in axes:
        others = [x for x in "xyz" if x != c]
        w = Window.partitionBy(by, *[F.round(x, 3) for x in others])
        half = (F.max(F.round(c, 3)).over(w) - F.min(F.round(c, 3)).over(w)) / 2
        off = F.abs(F.round(c, 3) - (F.max(F.round(c, 3)).over(w) + F.min(F.round(c, 3)).over(w)) / 2)
        out = out.withColumns({f"__h{c}": F.round(half, 3), f"__p{c}": F.when(F.round(half, 3) != 0, off / half).otherwise(off)})
    end = F.lit(False)
    for c in axes:
        end = end | (F.round(f"__p{c}", 3) == 1) | (F.col(f"__h{c}") == 0)
    mean = sum((F.col(f"__p{c}") for c in axes), F.lit(0.0)) / len(axes)
    return out.withColumn("chance", F.when(end, 1.0).otherwise(mean)).drop(*[f"__{k}{c}" for k in "hp" for c in axes])


def radial_position(atoms: DataFrame, by: str) -> DataFrame:
    """``atoms`` with ``chance``: distance from the particle's centre over that of its outermost atom."""
    w = Window.partitionBy(by)
    d2 = sum(((F.col(c) - F.avg(c).over(w)) * (F.col(c) - F.avg(c).over(w)) for c in "xyz"), F.lit(0.0))
    out = atoms.withColumn("__d", F.round(F.sqrt(d2), 3))
    return out.withColumn("chance", F.coalesce(F.try_divide("__d", F.max("__d").over(w)), F.lit(0.0))).drop("__d")


def layered(atoms: DataFrame, lattice: float, axes: str = "y", vacuum: float = VACUUM) -> DataFrame:
    """``atoms`` with ``second``: 1 in every layer a whole number of lattice constants from the edge along
    any of ``axes`` (one axis: L1_0, two: L1_2)."""
    hit = F.lit(False)
    for c in axes:
        m = F.round(F.pmod(F.round(c, 3) - vacuum / 2, F.lit(lattice)), 3)
        hit = hit | (m == 0) | (m == round(lattice, 3))
    return atoms.withColumn("second", hit.cast("int"))


def without_overlap(core: DataFrame, shell: DataFrame, radius: Callable[[Column], Column], reach: float) -> DataFrame:
    """Core and shell as one particle, shell atoms nearer to a core atom than the sum of both radii left
    out. ``radius`` maps a type column to radii; no sum of two is above ``reach``. Both (frame, atom_id, type_id,
    x, y, z); the result has ``part`` ('core', 'shell') too."""
    both = core.withColumn("part", F.lit("core")).unionByName(shell.withColumn("part", F.lit("shell")))
    tagged = both.withColumns({"surf": (F.col("part") == "shell").cast("int"), "atom_id": F.col("atom_id") * 2 + (F.col("part") == "shell").cast("int")})
    # In the pairs si and sj say which atom is the shell's.
    pairs = nb.grid_pairs(tagged, reach, F.lit(True))
    reach2 = radius(F.col("ti")) + radius(F.col("tj"))
    near = pairs.where("si <> sj").where(F.col("d2") < reach2 * reach2)
    gone = near.select("frame", F.when(F.col("si") == 1, F.col("i")).otherwise(F.col("j")).alias("atom_id")).distinct()
    left = tagged.join(gone, ["frame", "atom_id"], "left_anti")
    return left.withColumn("atom_id", F.expr("atom_id div 2")).drop("surf")

