"""Structural descriptors over atoms and bonds; every function maps DataFrames to a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granula.operators import paths


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def atom_counts(atoms: DataFrame) -> DataFrame:
    n = lambda cond: F.count_if(cond)
    return atoms.groupBy("frame").agg(F.count("*").alias("natoms"), F.sum("surf").cast("long").alias("nsurf"), n(F.col("type_id") == 1).alias("n1"), n(F.col("type_id") == 2).alias("n2"))


def cell_bounds(atoms: DataFrame, buffer: float = 10.0) -> DataFrame:
    """Range of each axis over a whole trajectory, the box edge (range + buffer) and the mid-point."""
    out = atoms.groupBy("conf_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return out.withColumns({f"l{c}": r6(F.col(f"max_{c}") - F.col(f"min_{c}") + buffer) for c in "xyz"} | {f"mid_{c}": r6((F.col(f"max_{c}") + F.col(f"min_{c}")) / 2) for c in "xyz"})


def coordination(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Neighbours of each atom, all and by unordered type pair; isolated atoms have 0."""
    low, high = F.least("ti", "tj"), F.greatest("ti", "tj")
    n = bonds.groupBy("frame", F.col("i").alias("atom_id")).agg(
        F.count("*").alias("cn"), *[F.count_if((low == a) & (high == b)).alias(f"cn{a}{b}") for a, b in ((1, 1), (1, 2), (2, 2))]
    )
    return atoms.select("frame", "atom_id", "type_id", "surf").join(n, ["frame", "atom_id"], "left").fillna(0, ["cn", "cn11", "cn12", "cn22"])


def generalised(atoms: DataFrame, bonds: DataFrame, largest: int | None = 12) -> DataFrame:
    """Sum of the neighbours' coordination numbers over 12, or over their largest one. Each of the ``bonds``, which
    hold both directions, takes the number of the end it starts from to the other, so they are found once."""
    cn = bonds.select("frame", "j", F.count("*").over(Window.partitionBy("frame", "i")).alias("cn"))
    over = F.lit(float(largest)) if largest else F.max("cn").cast("double")
    g = cn.groupBy("frame", F.col("j").alias("atom_id")).agg(F.count("*").alias("cn"), (F.sum("cn") / over).alias("gcn"))
    return atoms.select("frame", "atom_id", "type_id", "surf").join(g, ["frame", "atom_id"], "left").select("frame", "atom_id", "type_id", "surf", F.coalesce("cn", F.lit(0)).cast("long").alias("cn"), r6(F.coalesce("gcn", F.lit(0.0))).alias("gcn"))


def coordination_histogram(gcn: DataFrame) -> DataFrame:
    """Atoms by scope (all, bulk, surface), type (null: all) and bin, for cn and ceil(gcn); one
    expansion by grouping sets in place of a pass for each block."""
    rows = gcn.select("frame", "type_id", "surf", F.explode(F.array(F.struct(F.lit("cn").alias("kind"), F.col("cn").alias("bin")), F.struct(F.lit("gcn").alias("kind"), F.ceil("gcn").alias("bin")))).alias("e")).select("frame", "type_id", "surf", "e.*")
    return rows.groupingSets([["frame", "kind", "bin"], ["frame", "kind", "bin", "type_id"], ["frame", "kind", "bin", "surf"], ["frame", "kind", "bin", "type_id", "surf"]], "frame", "kind", "bin", "type_id", "surf").agg(F.count("*").alias("n"))


def coordination_means(gcn: DataFrame) -> DataFrame:
    return gcn.groupingSets([["frame"], ["frame", "type_id"], ["frame", "surf"], ["frame", "type_id", "surf"]], "frame", "type_id", "surf").agg(r6(F.avg("cn")).alias("avg_cn"), r6(F.sum(F.round(F.col("gcn") * 12)) / (12 * F.count("*"))).alias("avg_gcn"))


def bond_lengths(half: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and number of bonds; all and by unordered types."""
    rows = half.select("frame", F.least("ti", "tj").alias("t1"), F.greatest("ti", "tj").alias("t2"), "r")
    return rows.groupingSets([["frame"], ["frame", "t1", "t2"]], "frame", "t1", "t2").agg(r6(F.avg("r")).alias("avg_r"), r6(F.stddev_pop("r")).alias("std_r"), r6(F.max("r")).alias("max_r"), r6(F.min("r")).alias("min_r"), F.count("*").alias("n"))


def bond_fractions(half: DataFrame) -> DataFrame:
    n = half.groupBy("frame", F.least("ti", "tj").alias("t1"), F.greatest("ti", "tj").alias("t2")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("frame"))
    return n.select("frame", "t1", "t2", "n", r6(F.col("n") / total).alias("fraction"))


def atom_bond_lengths(bonds: DataFrame) -> DataFrame:
    return bonds.groupBy("frame", F.col("i").alias("atom_id"), "tj").agg(r6(F.avg("r")).alias("avg_r"), r6(F.max("r")).alias("max_r"), r6(F.min("r")).alias("min_r"), F.count("*").alias("n"))


def distance_histogram(atoms: DataFrame, step: float, points: int, block: int = 512) -> DataFrame:
    """(frame, t1, t2, bin, n): pairs of a frame by unordered types and distance, bin = int(r / step + 1.5)
    from 2 to ``points``.

    All pairs within a reach of many cells would cross a join for nothing but their count, so each
    frame is one Arrow group, its pairs are counted there ``block`` rows at a time, and only bins leave.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x, kind = np.stack([t.column(c).to_numpy() for c in "xyz"], 1), t.column("type_id").to_numpy()
        turn = np.argsort(kind, kind="stable")
        x, kind = x[turn], kind[turn]
        kinds, of = np.unique(kind, return_inverse=True)
        n = np.zeros((len(kinds), len(kinds), points + 1), np.int64)
        for i in range(0, len(x), block):
            d2 = sum((x[i : i + block, c, None] - x[None, i:, c]) ** 2 for c in range(3))
            at = np.floor(np.round(np.sqrt(d2) / step, 6) + 1.5).astype(np.int64)
            rows, columns = np.nonzero((at > 1) & (at <= points) & (np.arange(at.shape[1]) > np.arange(at.shape[0])[:, None]))
            key = (of[i + rows] * len(kinds) + of[i + columns]) * (points + 1) + at[rows, columns]
            n += np.bincount(key, minlength=n.size).reshape(n.shape)
        a, b, bins = np.nonzero(n)
        yield pa.record_batch([pa.array(np.full(len(a), t.column("frame")[0].as_py())), pa.array(kinds[a].astype(np.int32)), pa.array(kinds[b].astype(np.int32)), pa.array(bins), pa.array(n[a, b, bins])], ["frame", "t1", "t2", "bin", "n"])

    return atoms.select("frame", F.col("type_id").cast("int").alias("type_id"), "x", "y", "z").groupBy("frame").applyInArrow(count, "frame long, t1 int, t2 int, bin long, n long")


def rdf(histogram: DataFrame, counts: DataFrame, step: float, density: float) -> DataFrame:
    """Radial distribution, total (types null) and by unordered types, from ``distance_histogram``."""
    n = histogram.groupingSets([["frame", "bin"], ["frame", "bin", "t1", "t2"]], "frame", "bin", "t1", "t2").agg(F.sum("n").alias("n"))
    k = (F.col("bin") - 1) * F.lit(step)
    return n.join(counts.select("frame", "natoms"), "frame").select("frame", "t1", "t2", "bin", "n", r6(F.col("n") / (F.lit(2 * math.pi * step * density) * F.col("natoms") * k * k)).alias("g"))


def structure_factor(g: DataFrame, step: float, points: int, density: float, waves: int) -> DataFrame:
    """Sine transform of the total radial distribution, as a sum over bins; wave 0 is undefined."""
    total = g.where("t1 is null").select("frame", "bin", "g")
    frames = total.select("frame").distinct()
    grid = frames.select("frame", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(points).cast("long"))).alias("bin"))
    full = grid.join(total, ["frame", "bin"], "left").select("frame", "bin", (F.coalesce("g", F.lit(0.0)) - 1).alias("h"))
    size = 2 * waves - 2
    c = 4 * math.pi * density * step**2 / (2 * math.pi / (step * size))
    terms = full.select("frame", "bin", "h", F.explode(F.sequence(F.lit(1), F.lit(waves - 1))).alias("wave"))
    term = (F.col("bin") - 1) * F.col("h") * F.sin(F.lit(2 * math.pi / size) * (F.col("bin") - 1) * F.col("wave"))
    return terms.groupBy("frame", "wave").agg(F.round(1 + F.lit(c) / F.first("wave") * F.sum(term), 4).alias("s"))


def degrees_bin(cos: Column) -> Column:
    """Nearest whole degree of an angle, 0 counted as 1."""
    deg = r6(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    return F.greatest(F.lit(1), F.floor(deg + 0.5)).cast("int")


def first_shell_angles(bonds: DataFrame) -> DataFrame:
    """Angles at each atom between two neighbours j < k (frame, ti, tj, tk, bin)."""
    bonds = bonds.where("r > 0")  # atoms at one place have no direction
    a = bonds.select("frame", "i", "ti", "j", "tj", *[(F.col(f"d{c}") / F.col("r")).alias(f"a{c}") for c in "xyz"])
    b = bonds.select("frame", "i", F.col("j").alias("k"), F.col("tj").alias("tk"), *[(F.col(f"d{c}") / F.col("r")).alias(f"b{c}") for c in "xyz"])
    dot = F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz")
    return a.join(b.hint("shuffle_hash"), ["frame", "i"]).where("j < k").select("frame", "ti", "tj", "tk", degrees_bin(dot).alias("bin"))


def second_shell_angles(bonds: DataFrame) -> DataFrame:
    """Angles at i between j and k over paths i-j-k, k other than i."""
    a = bonds.select("frame", "i", "ti", "j", "tj", *[F.col(f"d{c}").alias(f"a{c}") for c in "xyz"], F.col("r").alias("ra"))
    b = bonds.select("frame", F.col("i").alias("j"), F.col("j").alias("k"), F.col("tj").alias("tk"), *[F.col(f"d{c}").alias(f"b{c}") for c in "xyz"])
    p = a.join(b.hint("shuffle_hash"), ["frame", "j"]).where("k <> i").withColumns({f"c{c}": F.col(f"a{c}") + F.col(f"b{c}") for c in "xyz"})
    dot = F.col("ax") * F.col("cx") + F.col("ay") * F.col("cy") + F.col("az") * F.col("cz")
    rc = F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy") + F.col("cz") * F.col("cz"))
    p = p.withColumns({"dot": dot, "rc": rc}).where("ra > 0 and rc > 0")
    return p.select("frame", "ti", "tj", "tk", degrees_bin(F.try_divide("dot", F.col("ra") * F.col("rc"))).alias("bin"))


def angle_histogram(angles: DataFrame) -> DataFrame:
    return angles.groupBy("frame", "bin").agg(F.count("*").alias("n"))


def angle_stats(angles: DataFrame) -> DataFrame:
    return angles.groupingSets([["frame"], ["frame", "ti", "tj", "tk"]], "frame", "ti", "tj", "tk").agg(r6(F.avg("bin")).alias("avg_deg"), r6(F.stddev_pop("bin")).alias("std_deg"), F.max("bin").alias("max_deg"), F.min("bin").alias("min_deg"), F.count("*").alias("n"))


def torsions(bonds: DataFrame) -> DataFrame:
    """Histogram of dihedral angles over directed paths i-j-k-l; 0 and 180 count in both halves."""
    return paths.dihedral_histogram(bonds)


def torsion_statistics(bonds: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and number of the dihedral angles of each half, in whole
    degrees; all, and by the four types along the path."""
    types = ["ti", "tj", "tk", "tl"]
    s = paths.sums(bonds, ("BT",)).withColumn("half", F.substring("kind", 3, 3)).groupingSets([["frame", "half"], ["frame", *types, "half"]], "frame", *types, "half")
    s = s.agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max("most").cast("int").alias("max_deg"), F.min("least").cast("int").alias("min_deg"))
    return s.select("frame", *types, "half", *[r6(c).alias(f"{k}_deg") for k, c in zip(("avg", "std"), moments(), strict=True)], "max_deg", "min_deg", "n")


def moments() -> tuple[Column, Column]:
    """Mean and population deviation from number, sum and sum of squares in columns n, s1 and s2."""
    mean = F.col("s1") / F.col("n")
    return mean, F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean))


def surface_geometry(atoms: DataFrame) -> DataFrame:
    """Radii of surface atoms from the particle's unweighted centre: range, mean, sample
    deviation, and bias-corrected skewness and excess kurtosis."""
    centre = atoms.groupBy("frame").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    d = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    r = atoms.where("surf = 1").join(centre, "frame").select("frame", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("r"))
    s = r.groupBy("frame").agg(F.count("*").alias("n"), F.min("r").alias("rmin"), F.max("r").alias("rmax"), F.avg("r").alias("ravg"), F.stddev_samp("r").alias("rstd"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"))
    n = F.col("n").cast("double")
    skew = F.expr("try_divide(sqrt(n * (n - 1D)), n - 2D)") * F.col("g1")
    kurt = F.expr("try_divide(n - 1D, (n - 2D) * (n - 3D))") * ((n + 1) * F.col("g2") + 6)
    return s.select("frame", "n", r6("rmin").alias("rmin"), r6("rmax").alias("rmax"), r6(F.col("rmax") - F.col("rmin")).alias("rdif"), r6("ravg").alias("ravg"), r6("rstd").alias("rstd"), r6(skew).alias("rskew"), r6(kurt).alias("rkurt"))


def bond_order(atoms: DataFrame, bonds: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Neighbours whose sixth-order bond-orientation vector points the same way.

    The 13 real harmonics of order 6 are polynomials of the unit bond vector: a mean an atom, its norm, and a dot
    product a bond, all of a frame at once.
    """
    return atoms.select("frame", "atom_id").join(paths.alike(bonds, threshold), ["frame", "atom_id"], "left").fillna(0, ["q6q6"])


def structural_units(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Census of (type, neighbours of each type) and its share in the frame."""
    n = bonds.groupBy("frame", F.col("i").alias("atom_id")).agg(F.count_if(F.col("tj") == 1).alias("n1"), F.count_if(F.col("tj") == 2).alias("n2"))
    u = atoms.select("frame", "atom_id", "type_id").join(n, ["frame", "atom_id"], "left").fillna(0, ["n1", "n2"]).groupBy("frame", "type_id", "n1", "n2").agg(F.count("*").alias("n"))
    return u.withColumn("pct", r6(100 * F.col("n") / F.sum("n").over(Window.partitionBy("frame"))))


def box_counts(atoms: DataFrame, sizes: list[float]) -> DataFrame:
    """Boxes of each edge length that hold an atom centre."""
    rows = atoms.select("frame", "x", "y", "z", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    box = [F.floor(F.col(c) / F.col("size")).alias(f"b{c}") for c in "xyz"]
    return rows.select("frame", "size", *box).distinct().groupBy("frame", "size").agg(F.count("*").alias("boxes"))


def box_dimension(counts: DataFrame) -> DataFrame:
    """Slope of log10 boxes over log10 of the inverse edge, with its fit."""
    x, y = -F.log10("size"), F.log10("boxes")
    return counts.select("frame", x.alias("x"), y.alias("y")).groupBy("frame").agg(r6(F.regr_slope("y", "x")).alias("dimension"), r6(F.regr_r2("y", "x")).alias("r2"), r6(F.regr_intercept("y", "x")).alias("intercept"))


def rmsd_next(atoms: DataFrame) -> DataFrame:
    """Root mean square over components between a frame and the next of its trajectory, atoms matched by id."""
    nxt = atoms.select("conf_id", (F.col("frame") - 1).alias("frame"), "atom_id", *[F.col(c).alias(f"{c}2") for c in "xyz"])
    d = [F.col(c) - F.col(f"{c}2") for c in "xyz"]
    return atoms.join(nxt, ["conf_id", "frame", "atom_id"]).groupBy("conf_id", "frame").agg(r6(F.sqrt(F.sum(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / (3 * F.count("*")))).alias("rmsd"), F.count("*").alias("n"))


def _as_slices(rows: np.ndarray, columns: np.ndarray) -> tuple:
    """An index of the cells at ascending ``rows`` and ``columns``: slices where they follow each other without a gap."""
    if all(len(p) and (np.diff(p) == 1).all() for p in (rows, columns)):
        return tuple(slice(p[0], p[-1] + 1) for p in (rows, columns))
    return np.ix_(rows, columns)


def lindemann(atoms: DataFrame, window: int | None = None, block: int = 256) -> DataFrame:
    """Index of each atom against all others of its trajectory: mean over partners of the relative
    fluctuation of their distance, over all frames, or as ``frame`` over those up to ``window`` before and
    behind, for the frames that have so many on both sides. A partner counts for the frames that
    have both; partners at distance zero throughout have none.

    Sums of pairs are kept where they arise: a group has ``block`` atoms of a trajectory and all their
    partners, so what is shuffled grows with atoms times blocks, not with pairs of atoms.
    """
    t = atoms.select("conf_id", "frame", "atom_id", "x", "y", "z")
    blocks = t.select("conf_id", F.expr(f"atom_id div {block}").alias("block")).distinct()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = pa.Table.from_batches(list(batches))
        frame, ids, x = h.column("frame").to_numpy(), h.column("atom_id").to_numpy(), np.stack([h.column(c).to_numpy() for c in "xyz"], 1)
        known = np.unique(ids)
        own = np.flatnonzero(known // block == h.column("block")[0].as_py())
        out_frame, out_id, out = [], [], []
        total = lambda: tuple(np.zeros((len(own), len(known))) for _ in range(3))
        held: list[tuple] = []

        def add(to: tuple, cells: tuple, r: np.ndarray, d2: np.ndarray) -> None:
            for sums, more in zip(to, (1, r, d2), strict=True):
                sums[cells] += more

        def close(at: int, n: np.ndarray, s: np.ndarray, s2: np.ndarray) -> None:
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = s / n
                v = np.sqrt(np.maximum(0, s2 / n - mean * mean)) / mean
            v[np.arange(len(own)), own] = np.nan
            good = np.isfinite(v)
            some = np.flatnonzero(good.any(1))
            out_frame.append(np.full(len(some), at))
            out_id.append(known[own[some]])
            out.append(np.where(good, v, 0).sum(1)[some] / good.sum(1)[some])

        everything = total() if window is None else None
        frames = np.unique(frame)
        for k, f in enumerate(frames):
            rows = np.flatnonzero(frame == f)
            rows = rows[np.argsort(ids[rows])]
            place = np.searchsorted(known, ids[rows])
            mine = rows[np.isin(place, own)]
            d2 = np.subtract.outer(x[mine, 0], x[rows, 0])
            d2 *= d2
            for c in (1, 2):
                d = np.subtract.outer(x[mine, c], x[rows, c])
                d *= d
                d2 += d
            cells = _as_slices(np.searchsorted(own, np.searchsorted(known, ids[mine])), place)
            if window is None:
                add(everything, cells, np.sqrt(d2), d2)
            else:
                held = [*held, (cells, np.sqrt(d2), d2)][-2 * window - 1 :]
                if len(held) == 2 * window + 1:
                    sums = total()
                    for one in held:
                        add(sums, *one)
                    close(int(frames[k - window]), *sums)
        if window is None:
            close(0, *everything)
        conf = h.column("conf_id").take(pa.array(np.zeros(sum(map(len, out)), np.int64)))
        columns = {"conf_id": conf, "frame": np.concatenate([np.empty(0, np.int64), *out_frame]), "atom_id": np.concatenate([np.empty(0, np.int64), *out_id]), "lindemann": np.round(np.concatenate([np.empty(0), *out]), 6)}
        yield from pa.table(columns).to_batches()

    kind = t.schema["conf_id"].dataType.simpleString()
    found = t.join(blocks, "conf_id").groupBy("conf_id", "block").applyInArrow(index, f"conf_id {kind}, frame long, atom_id long, lindemann double")
    return found if window is not None else found.drop("frame")


def lindemann_means(atoms: DataFrame, index: DataFrame) -> DataFrame:
    """Mean index of a trajectory's atoms, all (type null) and by the type they have in its first frame."""
    kinds = atoms.groupBy("conf_id", "atom_id").agg(F.min_by("type_id", "frame").alias("type_id"))
    keys = [c for c in ("conf_id", "frame") if c in index.columns]
    return index.join(kinds, ["conf_id", "atom_id"]).groupingSets([keys, [*keys, "type_id"]], *keys, "type_id").agg(F.round(F.avg("lindemann"), 5).alias("lindemann"), F.count("*").alias("n"))


def surface_sites(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Surface atoms of each frame by their neighbours within the surface: defects (1 to 3), micro
    sites (4 to 7), facet sites (9 to 11), and each number over all atoms of the frame."""
    scn = bonds.where("si = 1 and sj = 1").groupBy("frame", F.col("i").alias("atom_id")).agg(F.count("*").alias("scn"))
    sites = {"defects": (1, 3), "micros": (4, 7), "facets": (9, 11)}
    n = scn.groupBy("frame").agg(*[F.count_if(F.col("scn").between(*ends)).alias(name) for name, ends in sites.items()])
    all_ = atoms.groupBy("frame").agg(F.count("*").alias("natoms"))
    out = all_.join(n, "frame", "left").fillna(0, list(sites))
    return out.withColumns({f"{name}_ratio": r6(F.col(name) / F.col("natoms")) for name in sites})


def rebin(histogram: DataFrame, width: int = 10) -> DataFrame:
    """Histogram of 1-degree bins from 1 on, summed over runs of ``width`` bins (numbered from 0)."""
    return histogram.groupBy("frame", F.floor((F.col("bin") - 1) / width).alias("part")).agg(F.sum("n").alias("n"))


def mean_bonds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Mean bond length (null without bonds) and number of bonds of each atom."""
    n = bonds.groupBy("frame", F.col("i").alias("atom_id")).agg(r6(F.avg("r")).alias("avg_r"), F.count("*").alias("cn"))
    return atoms.select("frame", "atom_id").join(n, ["frame", "atom_id"], "left").fillna(0, ["cn"])


def under_surface(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bulk atoms of each frame that have a neighbour in the surface; frames without one are left out."""
    near = bonds.where("si = 0 and sj = 1").select("frame", F.col("i").alias("atom_id"))
    return atoms.select("frame", "atom_id").join(near, ["frame", "atom_id"], "left_semi").groupBy("frame").agg(F.count("*").alias("n"))


def unit_tracking(atoms: DataFrame, bonds: DataFrame, templates: list[tuple[int, int, int]]) -> DataFrame:
    """The last template (type, neighbours of type 1, of type 2), counted from 1, that an atom matches;
    0 without any. Templates are a short list, so they are a column expression."""
    n = bonds.groupBy("frame", F.col("i").alias("atom_id")).agg(F.count_if(F.col("tj") == 1).alias("n1"), F.count_if(F.col("tj") == 2).alias("n2"))
    a = atoms.select("frame", "atom_id", "type_id").join(n, ["frame", "atom_id"], "left").fillna(0, ["n1", "n2"])
    hits = [F.when((F.col("type_id") == t) & (F.col("n1") == x) & (F.col("n2") == y), k).otherwise(0) for k, (t, x, y) in enumerate(templates, 1)]
    return a.select("frame", "atom_id", F.greatest(F.lit(0), *hits).alias("template"))


def calinski_harabasz(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Number of clusters and of vectors, and the ratio of the spread between clusters to that within.
    Only sums by label and dimension are shuffled; vectors without a label are left out."""
    x = vectors.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    c = x.groupBy("label", "d").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("w"))
    g = c.groupBy("d").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    away = F.col("m") - F.col("g")
    k = c.join(g, "d").groupBy("label").agg(F.max("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * away * away).alias("b"))
    between, within = F.sum("b") / (F.count("*") - 1), F.sum("w") / (F.sum("n") - F.count("*"))
    return k.agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), r6(F.try_divide(between, within)).alias("calinski_harabasz"))


def atom_angles(bonds: DataFrame) -> DataFrame:
    """Mean, extremes and number of the angles in degrees between an atom's neighbours."""
    bonds = bonds.where("r > 0")
    unit = [(F.col(f"d{c}") / F.col("r")) for c in "xyz"]
    a = bonds.select("frame", "i", "j", *[u.alias(f"a{c}") for u, c in zip(unit, "xyz", strict=True)])
    b = bonds.select("frame", "i", F.col("j").alias("k"), *[u.alias(f"b{c}") for u, c in zip(unit, "xyz", strict=True)])
    dot = F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz")
    deg = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    out = a.join(b.hint("shuffle_hash"), ["frame", "i"]).where("j < k").select("frame", F.col("i").alias("atom_id"), deg.alias("d"))
    return out.groupBy("frame", "atom_id").agg(F.round(F.avg("d"), 4).alias("avg_deg"), F.round(F.max("d"), 4).alias("max_deg"), F.round(F.min("d"), 4).alias("min_deg"), F.count("*").alias("n"))


def normalised_angles(angles: DataFrame) -> DataFrame:
    """Histogram of angles, all and by ordered types, each count over the number of all angles of the frame."""
    n = angles.groupingSets([["frame", "bin"], ["frame", "ti", "tj", "tk", "bin"]], "frame", "ti", "tj", "tk", "bin").agg(F.count("*").alias("n"))
    total = F.sum(F.when(F.col("ti").isNull(), F.col("n"))).over(Window.partitionBy("frame"))
    return n.withColumn("fraction", F.round(F.col("n") / total, 9))


def radial_distances(atoms: DataFrame) -> DataFrame:
    """Distance of each atom from the mid-point of its trajectory's range."""
    mid = cell_bounds(atoms).select("conf_id", *[((F.col(f"max_{c}") + F.col(f"min_{c}")) / 2).alias(f"m{c}") for c in "xyz"])
    d = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    return atoms.join(mid, "conf_id").select("frame", "atom_id", r6(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("radius"))


def bond_order_histogram(atoms: DataFrame, order: DataFrame, most: int = 20) -> DataFrame:
    """Atoms by their number of like-oriented neighbours (over ``most``: one more), all and by surface flag."""
    t = atoms.select("frame", "atom_id", "surf").join(order, ["frame", "atom_id"]).select("frame", "surf", F.least("q6q6", F.lit(most + 1)).cast("int").alias("bin"))
    return t.groupingSets([["frame", "bin"], ["frame", "surf", "bin"]], "frame", "surf", "bin").agg(F.count("*").alias("n"))


#: Avogadro's number, cubic angstroms in a cubic centimetre.
_AVOGADRO, _A3 = 6.02214076e23, 1e24


def volumes(atoms: DataFrame, materials: dict[int, tuple[float, float]]) -> DataFrame:
    """Volume of each frame in cubic angstroms: packed as in bulk, from (molar mass, density) by type, and as
    a sphere of the mean surface radius (3/4 pi r^3: the published features have it so)."""
    n = atoms.groupBy("frame").agg(*[F.count_if(F.col("type_id") == t).alias(f"n{t}") for t in materials])
    packed = sum((F.col(f"n{t}") * F.lit(m / _AVOGADRO) / F.lit(rho / _A3) for t, (m, rho) in materials.items()), F.lit(0.0))
    centre = atoms.groupBy("frame").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    d = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    r = atoms.where("surf = 1").join(centre, "frame").groupBy("frame").agg(F.avg(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("r"))
    return n.join(r, "frame").select("frame", F.round(packed, 4).alias("vol_bulk_pack"), F.round(F.lit(3 / 4 * math.pi) * F.pow("r", F.lit(3.0)), 4).alias("vol_sphere"))


def surface_sites_by_type(atoms: DataFrame, bonds: DataFrame, volume: DataFrame) -> DataFrame:
    """Defect, micro and facet sites of each type, over the frame's atoms and over ``volume`` (frame, volume)."""
    scn = bonds.where("si = 1 and sj = 1").groupBy("frame", F.col("i").alias("atom_id")).agg(F.count("*").alias("scn"))
    sites = {"defects": (1, 3), "micros": (4, 7), "facets": (9, 11)}
    t = atoms.select("frame", "atom_id", "type_id").join(scn, ["frame", "atom_id"], "left")
    n = t.groupBy("frame", "type_id").agg(*[F.count_if(F.col("scn").between(*ends)).alias(k) for k, ends in sites.items()])
    total = atoms.groupBy("frame").agg(F.count("*").alias("natoms")).join(volume, "frame")
    out = n.join(total, "frame")
    return out.select("frame", "type_id", *[x for k in sites for x in (F.col(k), r6(F.col(k) / F.col("natoms")).alias(f"{k}_ratio"), F.round(F.col(k) / F.col("volume"), 9).alias(f"{k}_conc"))])


def formation_energy(rows: DataFrame, energy: str, counts: dict[str, float]) -> DataFrame:
    """``rows`` with formation_energy: ``energy`` less each count column times its bulk energy an atom."""
    bulk = sum((F.col(c) * F.lit(e) for c, e in counts.items()), F.lit(0.0))
    return rows.withColumn("formation_energy", F.col(energy) - bulk)


def bond_length_information(bonds: DataFrame, width: float) -> DataFrame:
    """Mutual information in nats between the mean bond lengths of a frame's atoms and the next frame's,
    in bins of ``width``; atoms matched by id."""
    l = bonds.groupBy("frame", F.col("i").alias("atom_id")).agg(F.floor(F.avg("r") / width).alias("a"))  # noqa: E741
    n = l.join(l.select((F.col("frame") - 1).alias("frame"), "atom_id", F.col("a").alias("b")), ["frame", "atom_id"]).groupBy("frame", "a", "b").agg(F.count("*").alias("n"))
    w = lambda *c: F.sum("n").over(Window.partitionBy("frame", *c)).cast("double")
    t = n.withColumns({"t": w(), "na": w("a"), "nb": w("b")})
    return t.groupBy("frame").agg(F.round(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))), 5).alias("mi"))


def coordination_divergence(cn: DataFrame) -> DataFrame:
    """Distances between the coordination histograms of types 1 and 2, each scaled to sum 1: Euclidean,
    Hellinger and Kullback-Leibler with the least positive share added to the second."""
    w = Window.partitionBy("frame")
    n = cn.groupBy("frame", "cn").agg(*[F.count_if(F.col("type_id") == t).alias(f"n{t}") for t in (1, 2)])
    h = n.withColumns({"p": F.try_divide(F.col("n1"), F.sum("n1").over(w)), "q": F.try_divide(F.col("n2"), F.sum("n2").over(w))})
    h = h.withColumn("e", F.min(F.when(F.col("q") > 0, F.col("q"))).over(w))
    root = F.sqrt("p") - F.sqrt("q")
    return h.groupBy("frame").agg(
        r6(F.sqrt(F.sum((F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))))).alias("euclid"), r6(F.sqrt(F.sum(root * root)) / math.sqrt(2)).alias("hellinger"),
        r6(F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / (F.col("q") + F.col("e")))).otherwise(0.0))).alias("kl"),
    )


def feature_row(cn: DataFrame, half: DataFrame, most: int = 20) -> DataFrame:
    """A wide row a frame: numbers of atoms, atoms by coordination number 0 to ``most`` (all and by type),
    its mean, and mean bond lengths (all and by unordered types). Two aggregations and a join on the frame."""
    t = lambda k: F.lit(True) if not k else F.col("type_id") == k
    name = lambda k: f"ele{k}" if k else "t"
    w = cn.groupBy("frame").agg(
        F.count("*").alias("n_atom_total"), *[F.count_if(t(k)).alias(f"n_ele{k}") for k in (1, 2)],
        *[F.count_if(t(k) & (F.col("cn") == n)).alias(f"{name(k)}_cn_{n}") for k in (0, 1, 2) for n in range(most + 1)], r6(F.avg("cn")).alias("avg_cn"),
    )
    low, high = F.least("ti", "tj"), F.greatest("ti", "tj")
    b = half.groupBy("frame").agg(r6(F.avg("r")).alias("bond_avg"), *[r6(F.avg(F.when((low == x) & (high == y), F.col("r")))).alias(f"bond_avg_{x}{y}") for x, y in ((1, 1), (1, 2), (2, 2))])
    return w.join(b, "frame", "left")


def merge_measured(measured: DataFrame, features: DataFrame, key: str = "conf_id", last: tuple[str, ...] = ()) -> DataFrame:
    """Measured values and features of the same configuration as one row, the columns in ``last`` at the end."""
    out = measured.join(features, key)
    return out.select(*[c for c in out.columns if c not in last], *last)


def exposed_faces(tetrahedra: DataFrame) -> DataFrame:
    """(frame, a, b, c): triangles that are a face of exactly one of the tetrahedra (frame, p0, p1, p2, p3)."""
    corners = [("p0", "p1", "p2"), ("p0", "p1", "p3"), ("p0", "p2", "p3"), ("p1", "p2", "p3")]
    faces = tetrahedra.select("frame", F.explode(F.array(*[F.array_sort(F.array(*f)) for f in corners])).alias("f"))
    return faces.groupBy("frame", "f").agg(F.count("*").alias("n")).where("n = 1").select("frame", *[F.col("f")[k].alias(x) for k, x in enumerate("abc")])


def generalised_partial(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Sum of the neighbours' partial coordination numbers over 12, by unordered type pair. ``bonds`` hold both directions."""
    low, high, w = F.least("ti", "tj"), F.greatest("ti", "tj"), Window.partitionBy("frame", "i")
    cn = bonds.select("frame", "j", *[F.count_if((low == a) & (high == b)).over(w).alias(f"cn{a}{b}") for a, b in ((1, 1), (1, 2), (2, 2))])
    g = cn.groupBy("frame", F.col("j").alias("atom_id")).agg(*[(F.sum(f"cn{p}") / 12).alias(f"gcn{p}") for p in ("11", "12", "22")])
    return atoms.select("frame", "atom_id").join(g, ["frame", "atom_id"], "left").select("frame", "atom_id", *[r6(F.coalesce(f"gcn{p}", F.lit(0.0))).alias(f"gcn{p}") for p in ("11", "12", "22")])


def harmonics(l: int) -> list[str]:  # noqa: E741
    """The real harmonics of order ``l`` of a unit vector x, y, z as SQL, scaled so that their squares sum to 1."""
    out = []
    for m in range(l + 1):
        scale = math.sqrt((2 if m else 1) * math.factorial(l - m) / math.factorial(l + m))
        poly = np.polynomial.polynomial.polyder(np.polynomial.legendre.leg2poly([0] * l + [1]), m) if m else np.polynomial.legendre.leg2poly([0] * l + [1])
        in_z = " + ".join(f"({scale * c:.17e}) * power(z, {k})" for k, c in enumerate(poly.tolist()) if c)
        turn = [(math.comb(m, k) * (-1) ** (k // 2), m - k, k) for k in range(m + 1)]
        for odd in (0, 1) if m else (0,):
            out.append(f"({in_z}) * ({' + '.join(f'({c:.6e}) * power(x, {a}) * power(y, {b})' for c, a, b in turn if b % 2 == odd)})")
    return out


def global_order(half: DataFrame, most: int = 12) -> DataFrame:
    """(frame, l, q): the length of the mean harmonic vector of order l over all bonds of a frame, l from 0 to ``most``.

    A bond counts from both its ends, so odd orders are 0 and even ones come from each bond once;
    one aggregation a frame. Bonds of length zero have no direction and are left out.
    """
    unit = half.where("r > 0").select("frame", *[(F.col(f"d{c}") / F.col("r")).alias(c) for c in "xyz"])
    terms = {l: harmonics(l) for l in range(0, most + 1, 2)}
    means = unit.groupBy("frame").agg(*[F.avg(F.expr(t)).alias(f"q{l}_{k}") for l, ts in terms.items() for k, t in enumerate(ts)])
    length = {l: r6(F.sqrt(sum((F.col(f"q{l}_{k}") * F.col(f"q{l}_{k}") for k in range(len(ts))), F.lit(0.0)))) for l, ts in terms.items()}
    rows = [F.struct(F.lit(l).alias("l"), length.get(l, F.lit(0.0)).alias("q")) for l in range(most + 1)]
    return means.select("frame", F.inline(F.array(*rows)))


def named_types(atoms: DataFrame, types: DataFrame) -> DataFrame:
    """``atoms`` with the element of their type; ``types`` (type_id, element) has a row a type. A type without one is null."""
    return atoms.join(types.select("type_id", "element"), "type_id", "left")


def cluster_table(labels: DataFrame, cn: DataFrame, least: int = 1, largest_only: bool = False) -> DataFrame:
    """(frame, cluster, size, mean_cn) of clusters (frame, atom_id, cluster) of ``least`` atoms and more, or of each
    frame's largest alone (of equal ones the least label)."""
    t = labels.join(cn.select("frame", "atom_id", "cn"), ["frame", "atom_id"]).groupBy("frame", "cluster").agg(F.count("*").alias("size"), r6(F.avg("cn")).alias("mean_cn"))
    t = t.where(F.col("size") >= least)
    if not largest_only:
        return t
    first = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("size"), "cluster"))
    return t.withColumn("__k", first).where("__k = 1").drop("__k")


def labelled(points: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """Cluster points with the scores of the same point; a point without scores keeps nulls. Columns that both have come from ``points``."""
    return points.join(scores.drop(*[c for c in points.columns if c not in key]), key, "left")
