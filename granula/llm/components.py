"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import drop_materialized, materialize


def _is_stars(edges: DataFrame) -> bool:
    """Whether every id has one edge down at most, and none that is pointed to has one."""
    end = lambda c, down: F.struct(F.col(c).alias("id"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
    ends = edges.select(F.inline(F.array(end("a", 1), end("b", 0))))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): component is the smallest id reachable.

    Each round lets every id point its larger neighbours, then its smaller ones, to the least
    id it knows, until the edges are stars around the least ids; the number of rounds grows
    with the logarithm of the graph's size. Rounds are written to the shared folder, which cuts lineage.
    Least ids are found by partial aggregation and joined back, so a hot id's rows can be split.
    Self-loops and null ends are ignored, repeated edges count once; no edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    now = materialize(now, "edges")
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        drop_materialized(now)
        now = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
