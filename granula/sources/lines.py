"""Numbered lines of text files, read by splits from any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line_no, line) of text files, lines counted from 1 within a file.

    Files are read by splits. A line's place in its split is its place in the scan less that of the
    split's first line; what lies before a split is a running total over the lines of the file's splits,
    a row each. So lines are neither sorted nor shuffled, and any size of splits gives the same numbers.
    """
    text = spark.read.text(list(paths))
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__seq"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "__block").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    before = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(splits, ["path", "__block"]).select("path", (F.col("__before") + F.col("__seq") - F.col("__first") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))
