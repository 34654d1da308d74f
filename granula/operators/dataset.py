"""The published dataset: features as long rows (frame, feature, value), one pivot to 972 named columns.

Every group of features is a function from atoms or bonds to long rows, so groups are computed
independently of each other and of the order of columns; names and order come from one rule.
"""

from __future__ import annotations

import math
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granula.operators import paths, surface
from granula.operators import structure as st
from granula.operators.ranges import dealt

#: Names of the scopes of coordination, of statistics, of facets and of lattice classes.
SCOPES = ("T", "B", "S", "SO")
STATS = ("avg", "std", "max", "min", "num")
FACETS = ("100", "111", "110", "311")
LATTICES = ("FCC", "HCP", "ICOS", "DECA")
SITES = {"defects": (1, 2, 3), "micros": (4, 5, 6, 7), "facets": (9, 10, 11)}
ENERGIES = ("Potential_E", "Kinetic_E", "Total_E", "Formation_E")
#: Molar mass (kg/mol), density (kg/m3) and energy an atom in bulk (eV) of the elements.
ELEMENTS = {"Au": (0.196967, 19320, -3.93), "Pt": (0.195084, 21450, -5.77), "Pd": (0.10642, 12023, -3.91), "Co": (0.058933, 8900, -4.41)}
_MOST = 20


def _types(n: int) -> list[str]:
    """All of ``n`` atoms, then every ordered choice of their types."""
    return ["M" * n, *("".join(f"Ele{t}" for t in c) for c in product((1, 2), repeat=n))]


def _coordination_names(prefix: str) -> list[str]:
    kinds = [f"{prefix}_{s}{k}" for k in ("CN", "GCN") for s in SCOPES]
    return [*(f"{k}_avg" for k in kinds), *(f"{k}_{n}" for k in kinds for n in range(_MOST + 1))]


def measured_names() -> list[str]:
    """Features that come from atoms and bonds, in the published order."""
    out = ["N_atom_total", "N_Ele1", "N_Ele2", "N_atom_bulk", "N_atom_surface"]
    out += [f"R_{k}" for k in ("min", "max", "diff", "avg", "std", "skew", "kurt")] + [f"S_{k}" for k in FACETS]
    out += [f"Curve_{10 * k + 1}-{10 * k + 10}" for k in range(18)]
    out += [n for p in ("MM", "Ele1M", "Ele2M") for n in _coordination_names(p)]
    out += [f"{p}_BL_{s}" for p in ("MM", "Ele1Ele1", "Ele1Ele2", "Ele2Ele2") for s in STATS]
    out += [f"{p}_frac" for p in ("Ele1Ele1", "Ele1Ele2", "Ele2Ele2")] + ["N_bond"]
    out += [f"{p}_{k}_{s}" for k in ("BA1", "BA2") for p in _types(3) for s in STATS]
    out += [f"{p}_BT{h}_{s}" for p in _types(4) for h in ("neg", "pos") for s in STATS]
    out += [f"q6q6_{s}_avg" for s in "TBS"] + [f"q6q6_{s}_{n}" for s in "TBS" for n in [*range(_MOST + 1), f"{_MOST}+"]]
    return out + list(LATTICES)


def site_names() -> list[str]:
    volumes = [f"_{v}_{k}" for v in ("bulk_pack", "sphere") for k in ("conc", "ratio")]
    return [f"Surf_{s}{e}{v}" for s in SITES for e in ("_Ele1", "_Ele2", "") for v in ("", *volumes)]


def names() -> list[str]:
    """The 972 columns of the published dataset, energies last."""
    measured = measured_names()
    at = measured.index("R_min")
    return ["T", "P", *measured[:at], "Vol_bulk_pack", "Vol_sphere", *measured[at:], *site_names(), *ENERGIES]


def _long(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Named columns of a row a frame as rows (frame, feature, value)."""
    each = [F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in values.items()]
    return rows.select("frame", F.inline(F.array(*each)))


def count_features(atoms: DataFrame) -> DataFrame:
    c = F.col
    return _long(st.atom_counts(atoms), {"N_atom_total": c("natoms"), "N_Ele1": c("n1"), "N_Ele2": c("n2"), "N_atom_bulk": c("natoms") - c("nsurf"), "N_atom_surface": c("nsurf")})


def radius_features(atoms: DataFrame) -> DataFrame:
    return _long(st.surface_geometry(atoms), {f"R_{k}": F.col(f"r{v}") for k, v in {"min": "min", "max": "max", "diff": "dif", "avg": "avg", "std": "std", "skew": "skew", "kurt": "kurt"}.items()})


def surface_features(curves: DataFrame) -> DataFrame:
    """Facets, and curvature in steps of ten degrees, of surface atoms with their curvature; both from one pass over ``curves``."""
    low = 10 * F.floor((surface.whole_degrees() - 1) / 10) + 1
    n = curves.groupBy("frame", low.cast("int").alias("low")).agg(F.count("*").alias("n"), *[F.count_if(F.col("facet") == k).alias(f"f{name}") for k, name in enumerate(FACETS, 1)])
    one = lambda name, value: F.struct(name.alias("feature"), value.cast("double").alias("value"))
    steps = F.collect_list(one(F.concat(F.lit("Curve_"), "low", F.lit("-"), F.col("low") + 9), F.col("n")))
    s = n.groupBy("frame").agg(steps.alias("steps"), *[F.sum(f"f{k}").alias(f"f{k}") for k in FACETS])
    return s.select("frame", F.inline(F.concat("steps", F.array(*[one(F.lit(f"S_{k}"), F.col(f"f{k}")) for k in FACETS]))))


def _prefix(t: Column) -> Column:
    return F.when(t.isNull(), "MM").otherwise(F.concat(F.lit("Ele"), t, F.lit("M")))


def _spread(rows: DataFrame, groups: list[str], kinds: dict[str, tuple[Column, Column, int]], prefix: Column, most: int = _MOST) -> DataFrame:
    """How often each number up to ``most`` occurs, and the mean, of each of ``kinds`` (its number, what is averaged, how many times
    its unit), in a frame by all subsets of ``groups`` (left out: null). The mean comes from the sums of the numbers' rows,
    so ``rows`` are computed once."""
    each = [F.struct(F.lit(k).alias("kind"), F.lit(unit).alias("unit"), bin_.cast("long").alias("bin"), v.cast("double").alias("v")) for k, (bin_, v, unit) in kinds.items()]
    e = rows.select("frame", *groups, F.inline(F.array(*each)))
    sets = [["frame", "kind", "unit", "bin", *g] for n in range(len(groups) + 1) for g in combinations(groups, n)]
    h = e.groupingSets(sets, "frame", "kind", "unit", "bin", *groups).agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    bins = F.collect_list(F.when(F.col("bin") <= most, F.struct(F.col("bin").cast("string").alias("of"), F.col("n").cast("double").alias("value"))))
    m = h.groupBy("frame", "kind", *groups).agg(bins.alias("bins"), st.r6(F.sum("v") / (F.first("unit") * F.sum("n"))).alias("mean"))
    values = F.concat("bins", F.array(F.struct(F.lit("avg").alias("of"), F.col("mean").alias("value"))))
    return m.select("frame", F.concat(prefix, F.col("kind"), F.lit("_")).alias("name"), F.inline(values)).select("frame", F.concat("name", "of").alias("feature"), "value")


def _scope(surf: Column) -> Column:
    return F.when(surf.isNull(), "T").when(surf == 0, "B").otherwise("S")


def _of_types(columns: list[str]) -> Column:
    all_ = F.lit("M" * len(columns))
    return F.when(F.col(columns[0]).isNull(), all_).otherwise(F.concat(*[x for c in columns for x in (F.lit("Ele"), F.col(c))]))


def _groups(kind: Column) -> Column:
    """By which types (null: all) a row of :func:`granula.operators.paths.all_sums` counts: numbers of atoms by all subsets of type and surface
    flag, numbers on the surface by type or not, q6q6 by surface flag or not, lengths and angles by all types on the way or none."""
    of = [F.col(c) for c in ("ti", "tj", "tk", "tl")]
    none = F.lit(None).cast("int")
    by = lambda *c: F.struct(*[x.alias(k) for k, x in zip(("ti", "tj", "tk", "tl"), [*c, *[none] * (4 - len(c))], strict=True)])
    return F.when(kind.isin("CN", "GCN"), F.array(by(), by(of[0]), by(none, of[1]), by(of[0], of[1]))).otherwise(F.array(by(), by(*of)))


def bond_features(atoms: DataFrame, half: DataFrame, n_atoms: int | None = None) -> DataFrame:
    """All that takes bonds, from one look at them:

    * histograms and means of coordination numbers, plain and generalised, of all, bulk and surface atoms, and of surface atoms among themselves;
      numbers over 20 have no column;
    * numbers of like-oriented neighbours of all, bulk and surface atoms;
    * bond lengths, shares of pairs of types and the number of bonds;
    * angles between first neighbours (BA1) and over second ones (BA2), and dihedral angles by half (BT), all and by ordered types.

    Sums leave a frame's task; they are put together here, all rows of a frame in one task, whose share stays the same with
    ``n_atoms``, how many atoms there are.
    """
    kind, n, t = F.col("kind"), F.col("n").cast("double"), ["ti", "tj", "tk", "tl"]
    s = paths.all_sums(atoms, half)
    s = s.repartition("frame") if n_atoms is None else dealt(s, "frame", n_atoms, 250_000)
    s = s.select("frame", "kind", "bin", "n", "s1", "s2", "most", "least", F.inline(_groups(kind)))
    s = s.withColumn("bin", F.when(kind == "q6q6", F.least("bin", F.lit(_MOST + 1))).otherwise(F.col("bin"))).groupBy("frame", "kind", *t, "bin")
    s = s.agg(*[f(c).alias(c) for c, f in (("n", F.sum), ("s1", F.sum), ("s2", F.sum), ("most", F.max), ("least", F.min))])
    one = lambda name, value: F.struct(name.alias("feature"), value.cast("double").alias("value"))
    bins = F.collect_list(F.when((F.col("bin") <= _MOST) | (kind == "q6q6"), one(F.when(F.col("bin") > _MOST, F.lit(f"{_MOST}+")).otherwise(F.col("bin").cast("string")), n)))
    s = s.groupBy("frame", "kind", *t).agg(bins.alias("bins"), *[f(c).alias(c) for c, f in (("n", F.sum), ("s1", F.sum), ("s2", F.sum), ("most", F.max), ("least", F.min))])
    s = s.withColumn("total", F.max(F.when((kind == "BL") & F.col("ti").isNull(), F.col("n"))).over(Window.partitionBy("frame")))
    mean, spread = st.moments()
    unit = F.when(kind == "GCN", 12).when(kind == "SOGCN", 1000000).otherwise(1)
    numbers = F.concat("bins", F.array(one(F.lit("avg"), st.r6(F.col("s1") / (unit * F.col("n"))))))
    scope = F.when(kind.startswith("SO"), F.lit("")).otherwise(_scope(F.col("tj")))
    values = {"avg": st.r6(mean), "std": st.r6(spread), "max": st.r6("most"), "min": st.r6("least"), "num": n}
    statistics = F.array(*[one(F.lit(k), v) for k, v in values.items()])
    of = F.when(kind == "BL", _of_types(["ti", "tj"])).when(kind.startswith("BA"), _of_types(["ti", "tj", "tk"])).otherwise(_of_types(t))
    before = F.when(kind == "q6q6", F.concat(F.lit("q6q6_"), scope)).when(kind.endswith("CN"), F.concat(_prefix(F.col("ti")), F.lit("_"), scope, kind)).otherwise(F.concat(of, F.lit("_"), kind))
    # All bonds have no share, in its place is their number.
    share = F.when(kind == "BL", F.array(F.when(F.col("ti").isNull(), one(F.lit("N_bond"), n)).otherwise(one(F.concat(of, F.lit("_frac")), st.r6(n / F.col("total"))))))
    every = F.transform(F.when(kind.isin("q6q6") | kind.endswith("CN"), numbers).otherwise(statistics), lambda x: one(F.concat(F.col("before"), F.lit("_"), x["feature"]), x["value"]))
    return s.withColumn("before", before).select("frame", F.inline(F.concat(every, F.coalesce(share, F.array().cast("array<struct<feature:string,value:double>>")))))


def features_long(atoms: DataFrame, half: DataFrame, curves: DataFrame | None = None, n_atoms: int | None = None) -> DataFrame:
    """(frame, feature, value) of every group; ``half`` has each bond once, ``n_atoms`` is how many atoms there are.

    Without ``curves`` (:func:`granula.operators.surface.curvature`) facets and curvature have no rows.
    """
    out = count_features(atoms).unionByName(radius_features(atoms)).unionByName(bond_features(atoms, half, n_atoms))
    return out if curves is None else out.unionByName(surface_features(curves))


def is_count(name: str) -> bool:
    """Whether a feature counts something, so that no row for it means 0 and not unknown."""
    last = name.rsplit("_", 1)[-1]
    return name.startswith(("N_", "S_", "Curve_")) or last.rstrip("+").isdigit() or last == "num"


def wide(features: DataFrame, unknown: tuple[str, ...] = ()) -> DataFrame:
    """A row a frame with a column for each measured feature, by one pivot over the names given beforehand.

    Counts without a row are 0, other features null; so are all whose name begins with one of
    ``unknown``, for groups that were not computed. Names that no column has are left out; of a name
    repeated in a frame any value stays.
    """
    every = measured_names()
    rows = features.groupBy("frame").pivot("feature", every).agg(F.first("value"))
    filled = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) if is_count(c) and not c.startswith(unknown) else F.col(f"`{c}`")
    return rows.select("frame", *[filled(c).alias(c) for c in every])


def derived(rows: DataFrame, elements: tuple[str, str]) -> DataFrame:
    """``rows`` with volumes and surface sites from their own columns: sites of a kind are surface atoms with
    the kind's coordination numbers; their total is the sum over the types."""
    c = lambda name: F.col(f"`{name}`")
    packed = sum((c(f"N_Ele{k}") * F.lit(ELEMENTS[e][0] / 6.02214076e23) / F.lit(ELEMENTS[e][1] / 1e30) for k, e in enumerate(elements, 1)), F.lit(0.0))
    rows = rows.withColumns({"Vol_bulk_pack": packed, "Vol_sphere": F.lit(3 / 4 * math.pi) * c("R_avg") * c("R_avg") * c("R_avg")})
    rows = rows.withColumns({f"Surf_{s}_Ele{k}": sum((c(f"Ele{k}M_SCN_{n}") for n in numbers), F.lit(0.0)) for s, numbers in SITES.items() for k in (1, 2)})
    parts = {f"Surf_{s}_Ele{k}_{v}_{x}": F.try_divide(c(f"Surf_{s}_Ele{k}"), c(f"Vol_{v}") if x == "conc" else c("N_atom_total")) for s in SITES for k in (1, 2) for v in ("bulk_pack", "sphere") for x in ("conc", "ratio")}
    rows = rows.withColumns(parts)
    ends = ["", *(f"_{v}_{x}" for v in ("bulk_pack", "sphere") for x in ("conc", "ratio"))]
    return rows.withColumns({f"Surf_{s}{e}": c(f"Surf_{s}_Ele1{e}") + c(f"Surf_{s}_Ele2{e}") for s in SITES for e in ends})


def published(measured: DataFrame, simulated: DataFrame, elements: tuple[str, str], key: str = "frame") -> DataFrame:
    """The dataset's rows: ``key`` and the 972 columns in their order.

    ``measured`` comes from :func:`wide`; ``simulated`` has key, T, P, Potential_E, Kinetic_E and Total_E.
    Only keys in both stay. Formation_E is the total energy less what the atoms have in bulk.
    """
    rows = derived(measured, elements).join(simulated.select(key, "T", "P", *ENERGIES[:3]), key)
    bulk = sum((F.col(f"N_Ele{k}") * F.lit(ELEMENTS[e][2]) for k, e in enumerate(elements, 1)), F.lit(0.0))
    return rows.withColumn("Formation_E", F.col("Total_E") - bulk).select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in names()])
