"""Multi-frame XYZ files as atoms, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granula.sources.lines import numbered_lines

#: A line with nothing but a number of atoms; it may be cut by blanks into three groups at most, as an atom has four.
_COUNT = r"^\s*[0-9]+(\s+[0-9]+){0,2}\s*$"


def frame_heads(lines: DataFrame) -> DataFrame:
    """(path, frame, head, n): where each frame of a file begins and how many atoms it has, frames from 1.

    A head is a line with a number alone; one right after a head is that frame's comment. A row a
    frame, so the windows over a file's heads hold no atoms.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    c = lines.where(F.col("line").rlike(_COUNT)).select("path", "line_no", F.regexp_replace("line", r"\s", "").cast("long").alias("n"))
    run = Window.partitionBy("path", "__run").orderBy("line_no")
    c = c.withColumn("__run", F.col("line_no") - F.row_number().over(w)).withColumn("__k", F.row_number().over(run)).where("__k % 2 = 1")
    return c.select("path", F.row_number().over(w).alias("frame"), F.col("line_no").alias("head"), "n")


def read_xyz(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, frame, comment, atom_id, element, x, y, z, surf) of XYZ files on any file system.

    A frame is a line with the number of atoms (blanks in it are ignored), a comment line, and a line an
    atom: element, x, y, z and, if there is one, a surface flag. Lines between frames are skipped.
    Files are read by splits of any size; frames' lines find their frame by an equality join on
    the line's number, the one shuffle there is. A line that is too short or has no numbers gives
    nulls; a frame cut off by the file's end has the atoms that are there.
    """
    lines = numbered_lines(spark, *paths)
    heads = frame_heads(lines)
    comments = heads.select("path", (F.col("head") + 1).alias("line_no"), "frame").join(lines, ["path", "line_no"], "left").select("path", "frame", F.coalesce("line", F.lit("")).alias("comment"))
    places = heads.where("n > 0").select("path", "frame", F.posexplode(F.sequence(F.col("head") + 2, F.col("head") + 1 + F.col("n"))).alias("k", "line_no"))
    w = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    atoms = lines.join(places, ["path", "line_no"]).withColumn("w", w).join(comments, ["path", "frame"])
    at = lambda k: F.try_element_at("w", F.lit(k))
    return atoms.select(
        "path", "frame", "comment", (F.col("k") + 1).alias("atom_id"), at(1).alias("element"), *[at(k).try_cast("double").alias(c) for k, c in ((2, "x"), (3, "y"), (4, "z"))], at(5).try_cast("int").alias("surf")
    )


def write_xyz(atoms: DataFrame, path: str, columns: tuple[str, ...] = ()) -> None:
    """One text row a frame, frames kept whole; extra ``columns`` follow the coordinates. A null is
    written as ``-``, so that no column moves."""
    line = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("element", "x", "y", "z", *columns)])
    rows = atoms.groupBy("path", "frame").agg(F.first("comment").alias("comment"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("atom_id", line.alias("line")))).alias("a"))
    rows.select(F.concat_ws("\n", F.col("n").cast("string"), F.coalesce("comment", F.lit("")), F.concat_ws("\n", F.col("a.line"))).alias("value")).write.text(path)
