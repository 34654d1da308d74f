"""An extension: the thermo log as a stream, with late lines up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_energy(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean of ``value`` by window of ``ts`` and type; the same on batches and streams."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return windowed_energy(spark.readStream.schema(schema).parquet(folder))
