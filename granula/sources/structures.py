"""Structure files: simulation data files and dumps, listings, and files of two kinds back out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granula.sources.logs import numbered_lines


def data_headers(lines: DataFrame) -> DataFrame:
    """(path, atoms, types, xlo, xhi, ylo, yhi, zlo, zhi) of data files."""
    n = lambda p: F.max(F.regexp_extract("line", p, 1).try_cast("double"))
    two = {"lo": r"(\S+)\s+\S+", "hi": r"\S+\s+(\S+)"}
    ends = [n(rf"^\s*{two[k]}\s+{c}lo {c}hi").alias(f"{c}{k}") for c in "xyz" for k in ("lo", "hi")]
    return lines.groupBy("path").agg(n(r"^\s*(\d+)\s+atoms").cast("long").alias("atoms"), n(r"^\s*(\d+)\s+atom types").cast("int").alias("types"), *ends)


def read_data(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, atom_id, type_id, x, y, z) from the Atoms section of data files (atom style atomic)."""
    w = Window.partitionBy("path").orderBy("line_no")
    t = numbered_lines(spark, *paths)
    section = F.last(F.when(F.col("line").rlike(r"^\s*[A-Z][a-z]+"), F.regexp_extract("line", r"^\s*(\w+)", 1)), True).over(w)
    t = t.withColumns({"s": section, "w": F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")}).where("s = 'Atoms' and size(w) >= 5")
    n = lambda k, kind: F.element_at("w", k).try_cast(kind)
    return t.select("path", n(1, "long").alias("atom_id"), n(2, "int").alias("type_id"), *[n(3 + k, "double").alias(c) for k, c in enumerate("xyz")]).where("atom_id is not null")


def write_data(atoms: DataFrame, path: str, by: str, title: str = "atoms") -> None:
    """A text row, and so a file's worth of lines, a particle: header, bounds and the Atoms section."""
    line = F.format_string("%d %d %.6f %.6f %.6f", F.col("atom_id").cast("long"), F.col("type_id").cast("int"), *[F.col(c).cast("double") for c in "xyz"])
    g = atoms.groupBy(by).agg(F.count("*").alias("n"), F.max("type_id").alias("t"), *[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))], F.array_sort(F.collect_list(F.struct("atom_id", line.alias("l")))).alias("a"))
    bounds = [F.format_string(f"%.6f %.6f {c}lo {c}hi", F.col(f"{c}lo").cast("double"), F.col(f"{c}hi").cast("double")) for c in "xyz"]
    head = [F.lit(title), F.lit(""), F.format_string("%d atoms", "n"), F.format_string("%d atom types", F.col("t").cast("int")), *bounds, F.lit(""), F.lit("Atoms # atomic"), F.lit("")]
    g.select(F.concat_ws("\n", *head, F.concat_ws("\n", F.col("a.l"))).alias("value")).write.text(path)


def read_dump(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, step, atom_id, name, value): the items of each atom in dump files, in long form."""
    w = Window.partitionBy("path").orderBy("line_no")
    t = numbered_lines(spark, *paths)
    back = F.lag("line").over(w)
    t = t.withColumn("__b", back)
    t = t.withColumns({
        "step": F.last(F.when(F.col("__b").startswith("ITEM: TIMESTEP"), F.col("line").try_cast("long")), True).over(w),
        "names": F.last(F.when(F.col("line").startswith("ITEM: ATOMS"), F.split(F.trim(F.substring("line", 12, 10_000)), r"\s+")), True).over(w),
        "item": F.last(F.when(F.col("line").startswith("ITEM:"), F.regexp_extract("line", r"^ITEM: (\w+)", 1)), True).over(w),
        "w": F.split(F.trim("line"), r"\s+"),
    }).where("item = 'ATOMS' and line not like 'ITEM:%' and size(w) = size(names)")
    ident = F.element_at("w", F.array_position("names", F.lit("id")).cast("int")).try_cast("long")
    return t.select("path", "step", ident.alias("atom_id"), F.inline(F.arrays_zip(F.col("names").alias("name"), F.col("w").alias("value"))))


def read_last_tokens(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, atom_id, element, x, y, z): each line's last four words, of files whose first two lines are
    titles, whatever stands before them."""
    t = numbered_lines(spark, *paths).where("line_no > 2").withColumn("w", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).where("size(w) >= 4")
    at = lambda k: F.element_at("w", k)
    return t.select("path", (F.col("line_no") - 2).alias("atom_id"), at(-4).alias("element"), *[at(k).try_cast("double").alias(c) for k, c in ((-3, "x"), (-2, "y"), (-1, "z"))])


def last_frames(atoms: DataFrame, by: str = "path") -> DataFrame:
    """All atoms of the last frame of each file."""
    last = atoms.groupBy(by).agg(F.max("frame").alias("frame"))
    return atoms.join(last, [by, "frame"])


def snapshots(spark: SparkSession, folder: str, pattern: str = r"\.(\d+)\.xyz$") -> DataFrame:
    """(path, length, number): files below ``folder`` whose name has a match of ``pattern``, by its number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.withColumn("number", F.regexp_extract("path", pattern, 1).try_cast("long")).where("number is not null").orderBy("number", "path")


def missing_or_empty(expected: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """Rows of ``expected`` for which ``files`` (name, length) has no file, or an empty one."""
    return expected.join(files.where("length > 0"), name, "left_anti")


def elements(atoms: DataFrame, by: str = "path") -> DataFrame:
    """(by, element, type_id): the elements of each particle, numbered from 1 by name."""
    found = atoms.select(by, "element").distinct()
    return found.withColumn("type_id", F.row_number().over(Window.partitionBy(by).orderBy("element")))


def cutoff_matrix(spark: SparkSession, pairs: dict[tuple[str, str], float]) -> DataFrame:
    """(a, b, cutoff) for both orders of each pair of elements."""
    rows = {(a, b): float(r) for (x, y), r in pairs.items() for a, b in ((x, y), (y, x))}
    return spark.createDataFrame([(a, b, r) for (a, b), r in rows.items()], "a string, b string, cutoff double")
