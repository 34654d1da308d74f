"""Results as files: simulated energies, analysis tables, and structures to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granula.sources.xyz import write_xyz

#: Columns of a table of simulated energies, without a header in its files.
MDOUT = "conf_id string, T double, P double, PE double, KE double, TE double"
#: Elements that stand for boxes of the surface and of the bulk.
BOXES = {"surface": "H", "bulk": "He"}


def read_mdout(spark: SparkSession, *paths: str) -> DataFrame:
    """Simulated energies of configurations. Rows that were appended twice count once; values that are no numbers are null."""
    return spark.read.schema(MDOUT).option("mode", "PERMISSIVE").csv(list(paths)).dropDuplicates()


def append_mdout(rows: DataFrame, path: str) -> None:
    """Add rows to a table of simulated energies; repeats go when it is read."""
    rows.select(*[c.split()[0] for c in MDOUT.split(", ")]).dropDuplicates().write.mode("append").csv(path)


def write_analysis(results: dict[str, DataFrame], folder: str) -> None:
    """Each result as CSV with a header under its own name in ``folder``; arrays and structs as JSON."""
    for name, rows in results.items():
        plain = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, kind in rows.dtypes]
        rows.select(*plain).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")


def write_clusters(atoms: DataFrame, labels: DataFrame, path: str) -> None:
    """Atoms (path, frame, comment, atom_id, element, x, y, z) as XYZ with their cluster behind; - where they have none."""
    write_xyz(atoms.join(labels.select("frame", "atom_id", "cluster"), ["frame", "atom_id"], "left"), path, ("cluster",))


def with_boxes(atoms: DataFrame, boxes: DataFrame, kind: Column) -> DataFrame:
    """Atoms and the centres of boxes (path, frame, x, y, z) as one structure: a box is an atom of an element of
    ``BOXES`` by ``kind`` (surface or bulk), behind the atoms of its frame."""
    name = F.when(kind == "bulk", BOXES["bulk"]).otherwise(BOXES["surface"])
    last = atoms.groupBy("path", "frame").agg(F.max("atom_id").alias("__last"), F.first("comment").alias("comment"))
    placed = boxes.withColumn("__name", name).join(last, ["path", "frame"])
    w = F.row_number().over(Window.partitionBy("path", "frame").orderBy("x", "y", "z"))
    columns = ["path", "frame", "comment", "atom_id", "element", "x", "y", "z"]
    return atoms.select(*columns).unionByName(placed.withColumns({"atom_id": (F.col("__last") + w).cast(atoms.schema["atom_id"].dataType), "element": F.col("__name")}).select(*columns))


def of_elements(listing: DataFrame, folder: str, name: str, first: str, second: str) -> DataFrame:
    """Entries whose folder names the first element and whose name names the second."""
    return listing.where(F.col(folder).contains(first) & F.col(name).contains(second))
