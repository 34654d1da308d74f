"""Running totals over a whole table without a window that meets in one task.

Rows are dealt by ranges of the order, summed within their partition, and the partitions' totals,
one row each, are added on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed(df: DataFrame) -> DataFrame:
    """``df`` computed once, so that all who use it see the same partitions: checkpointed in the folder that
    the cluster names in spark.checkpoint.dir, or kept in memory and on disk where none is named."""
    context = df.sparkSession.sparkContext
    folder = context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def dealt(rows: DataFrame, key: str, n: int, each: int = 25_000) -> DataFrame:
    """``rows``, ``n`` in all, hashed by ``key`` into partitions of about ``each``: their number grows with the
    rows, so a task's share of what is made of them does not."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // each)), key)


def shared(rows: DataFrame, key: str, n: int, each: int = 25_000) -> DataFrame:
    """As :func:`dealt`, in one shuffle that all who read it share. Spark shares a shuffle between readers that need the same of it: so a
    row crosses as one column, and nothing that a reader asks for is pushed below a column that takes the partition's number."""
    rest = [c for c in rows.columns if c != key]
    t = dealt(rows.select(key, F.struct(*rest).alias("__row")), key, n, each)
    return t.select(key, F.when(F.spark_partition_id() >= 0, F.col("__row")).alias("__row")).select(key, "__row.*").select(*rows.columns)


def running_total(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over all rows before in ``order``.

    ``order`` has to tell all rows apart for the result to be the same on each run. Ranges come from
    a sample, so the dealt rows are fixed before both uses.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fixed(rows.withColumn("__amount", amount).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("__inner", F.coalesce(F.sum("__amount").over(w), F.lit(0)))
    # A total a partition: a bounded number of rows, so this window may be one task's.
    totals = dealt.groupBy("__part").agg(F.sum("__amount").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("__part", before.alias("__offset"))
    return inner.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__inner") + F.col("__offset")).drop("__amount", "__part", "__inner", "__offset", "__sum")


def dense_index(rows: DataFrame, order: list[str], name: str = "index", digits: int = 0) -> DataFrame:
    """``rows`` numbered from 1 in ``order``; with ``digits``, as zero-filled text."""
    out = running_total(rows, order, F.lit(1), "__index")
    n = (F.col("__index") + 1).cast("long")
    return out.withColumn(name, F.lpad(n.cast("string"), digits, "0") if digits else n).drop("__index")


def quantiles(rows: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """A row with a column for each of ``at`` (name, share): the exact quantile of ``value``, between two values in
    proportion; nulls are left out, and of no value it is null. Values are counted and dealt by ranges, so no task meets them all."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    r = running_total(counts, [value], F.col("n"), "__before")
    # Where the quantiles lie depends on the number of rows alone.
    r = r.join(F.broadcast(rows.agg(F.count(value).alias("__all"))))
    here = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("n")), F.col(value).cast("double")))
    place = {name: F.lit(q) * (F.col("__all") - 1) for name, q in at.items()}
    one = r.agg(F.max("__all").alias("__all"), *[here(f(p)).alias(f"__{k}{name}") for name, p in place.items() for k, f in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda name, p: (F.ceil(p) - p) * F.col(f"__lo{name}") + (p - F.floor(p)) * F.col(f"__hi{name}")
    return one.select(*[F.when(F.col(f"__lo{name}") == F.col(f"__hi{name}"), F.col(f"__lo{name}")).otherwise(between(name, p)).alias(name) for name, p in place.items()])


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, rank): the mean rank from 1 of each distinct value of a column; nulls have none.
    Join it back on the value: rows with one value are ranked together, so hot values cost nothing."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return running_total(counts, [value], F.col("n"), "__before").select(value, (F.col("__before") + (F.col("n") + 1) / 2).alias("rank"))
