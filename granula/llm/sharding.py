"""Sharding by extendible hashing, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.llm.common import materialize

#: Hash bits looked at in one round; a round aggregates to at most 2**BITS buckets per open prefix.
BITS = 12
#: Bits of hash there are: 13 hexadecimal digits of an MD5.
DEPTH = 52


def hash_bits(key: Column) -> Column:
    """The first 52 bits of the key's MD5 as a non-negative long; a null key counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """The leaves (depth, prefix, shard_bytes, shard_rows) for ``sizes`` (h, n, bytes).

    A bucket stays whole if its bytes fit ``limit`` or all its rows have one hash, which no
    further bit can part; every other bucket splits on its next bit. Buckets are looked at in
    rounds of BITS bits, and only the rows of buckets still too large take part in the next.
    """
    spark = sizes.sparkSession
    leaves, todo, depth = None, sizes, 0
    while depth < DEPTH:
        last = min(depth + BITS, DEPTH)
        micro = todo.groupBy(F.shiftrightunsigned("h", DEPTH - last).alias("p")).agg(
            F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        levels = F.sequence(F.lit(depth if depth == 0 else depth + 1), F.lit(last))
        nodes = (
            micro.select("*", F.explode(levels).alias("depth"))
            .groupBy("depth", F.expr(f"shiftrightunsigned(p, {last} - depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")) | (F.col("depth") == DEPTH))
        )
        # A leaf fits while its parent does not; parents of a round's first level were too large, as they took part.
        nodes = materialize(nodes, "extendible")
        parents = nodes.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        first = 0 if depth == 0 else depth + 1
        found = (
            nodes.where("fits")
            .withColumn("up", F.shiftrightunsigned("prefix", 1))
            .join(parents.withColumn("split", F.lit(True)), ["depth", "up"], "left")
            .where((F.col("depth") == first) | F.col("split"))
            .select("depth", "prefix", "shard_bytes", "shard_rows")
        )
        leaves = found if leaves is None else leaves.unionByName(found)
        large = nodes.where((F.col("depth") == last) & ~F.col("fits")).select(F.col("prefix").alias("p"))
        if large.isEmpty():
            return leaves
        todo = todo.withColumn("p", F.shiftrightunsigned("h", DEPTH - last)).join(large, "p", "left_semi").drop("p")
        depth = last
    return leaves if leaves is not None else spark.createDataFrame([], "depth int, prefix long, shard_bytes long, shard_rows long")


def shard(rows: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``rows`` with shard_depth, shard_prefix, shard_bytes and shard_rows.

    ``size`` gives the bytes of a row (null: 0). Rows go by the MD5 bits of ``key``; null keys
    go as the empty string. A shard is over ``limit`` only if all its rows have the same key
    hash (one very large row, or repeated keys). An empty table gives no rows. Columns of
    ``rows`` with the names of new columns are replaced.
    """
    new = ["shard_depth", "shard_prefix", "shard_bytes", "shard_rows"]
    rows = rows.drop(*new).withColumns({"__h": hash_bits(F.col(key)), "__b": F.coalesce(size.cast("long"), F.lit(0))})
    sizes = rows.groupBy(F.col("__h").alias("h")).agg(F.count("*").alias("n"), F.sum("__b").alias("bytes"))
    leaves = materialize(directory(materialize(sizes, "sizes"), limit), "directory")
    leaves = leaves.withColumnsRenamed({"depth": "__depth", "prefix": "__prefix"})
    # One equality join for each depth in use, by union: a row's depth is that at which its prefix is a leaf.
    depths = sorted(r[0] for r in leaves.select("__depth").distinct().collect())
    if not depths:
        return rows.drop("__h", "__b").withColumns({c: F.lit(None).cast("int" if c == "shard_depth" else "long") for c in new})
    paths = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("__h", DEPTH - d).alias("prefix")) for d in depths])
    # The directory proper: every prefix of the deepest round's length points to its leaf.
    top = depths[-1]
    if top <= BITS + 8:
        entries = leaves.select("*", F.explode(F.expr(f"sequence(shiftleft(__prefix, {top} - __depth), shiftleft(__prefix + 1, {top} - __depth) - 1)")).alias("__e"))
        joined = rows.withColumn("__e", F.shiftrightunsigned("__h", DEPTH - top)).join(entries, "__e").drop("__e")
    else:
        joined = rows.withColumn("__at", F.explode(paths)).join(
            leaves, (F.col("__at.depth") == F.col("__depth")) & (F.col("__at.prefix") == F.col("__prefix"))
        ).drop("__at")
    return joined.withColumnsRenamed({"__depth": "shard_depth", "__prefix": "shard_prefix"}).drop("__h", "__b")
