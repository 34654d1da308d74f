"""Mixing sources to target weights by Sainte-Lague apportionment, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granula.llm.common import materialize

#: Fixed value: weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``target`` to ``sources`` (source, source_size): one row a source.

    The targets share ``share`` of all sizes by weight; none is above ``most`` times its
    source's size, and what is above goes to the others by weight until none is. That is water
    filling: sources in order of most * size / weight are capped while the level passes them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumns({
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "want": F.lit(float(share)) * F.sum("source_size").over(every),
    })
    # The level if this source and all after it stay uncapped; the first such source fixes it.
    s = s.withColumn("level", (F.col("want") - F.col("before")) / F.col("rest"))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("at", F.min(F.when(F.col("free"), F.struct("before", "rest"))).over(every))
    level = (F.col("want") - F.col("at.before")) / F.col("at.rest")
    return s.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")).alias("target"))


def sainte_lague(parts: DataFrame, group: list[str], seats: Column, votes: Column, key: Column) -> DataFrame:
    """Add ``quota``: how many of the group's ``seats`` each row gets by its ``votes``.

    Seats go one by one to the highest quotient votes / (2 * given + 1), ties to the lower
    ``key``. All seats whose quotient is certainly among the highest are given at once: with
    W votes, N seats and n rows, round(votes * (N - n) / W) never gives too many. The rest,
    3n quotients a group at most, are ranked.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy()
    p = parts.withColumns({"__v": votes.cast("double"), "__n": seats.cast("long"), "__k": key})
    p = p.withColumns({"__w": F.sum("__v").over(g), "__c": F.sum(F.lit(1)).over(g)})
    at = lambda n: F.coalesce(F.floor(F.expr("try_divide(__v, __w)") * n + 0.5), F.lit(0)).cast("long")
    p = p.withColumns({
        "__low": F.least(F.col("__n"), at(F.greatest(F.col("__n") - F.col("__c"), F.lit(0)))),
        "__high": at(F.col("__n") + F.col("__c")),
    })
    p = p.withColumn("__left", F.col("__n") - F.sum("__low").over(g))
    more = F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low"), F.col("__high") - 1)).otherwise(F.array(F.lit(-1).cast("long")))
    q = p.withColumn("__s", F.explode(more)).withColumn("__q", F.when(F.col("__s") >= 0, F.col("__v") / (2 * F.col("__s") + 1)))
    order = Window.partitionBy(*group).orderBy(F.col("__q").desc_nulls_last(), F.col("__k"), F.col("__s"))
    q = q.withColumn("__got", ((F.row_number().over(order) <= F.col("__left")) & F.col("__q").isNotNull()).cast("long"))
    return (
        q.groupBy(*[F.col(c) for c in parts.columns])
        .agg((F.max("__low") + F.sum("__got")).alias("quota"))
    )


def mix(
    docs: DataFrame, size: Column, *, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS,
    block: int = 16, shard_size: int = 1 << 20, seed: int = 17,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken.

    Every source gets target / ``block`` blocks by Sainte-Lague; whole passes over the source
    come first, and the blocks of the last, broken pass are apportioned to the source's shards
    by their sizes. A shard (about ``shard_size`` tokens, by seeded hash of doc_id) lays its
    documents in seeded order and takes its quota of blocks from the front, so ``taken`` of a
    document is passes * size plus what of it lies in those blocks.

    Null sources are one source, last in order. Documents of size 0 or null take 0. The same
    rows give the same result in any order and partitioning: shards and places go by hashes of
    whole rows, so rows that share a doc_id, or have none, are told apart, and rows that are
    equal throughout may change places with each other only. An empty table gives no rows.
    Columns of ``docs`` with the names of new columns are replaced.
    """
    new = ["size", "source_size", "target", "taken"]
    rows = docs.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0))).drop(*new).withColumnRenamed("__size", "size")
    hashed = [c for c in rows.columns if "map<" not in rows.schema[c].dataType.simpleString()]
    rows = rows.withColumns({"__h": F.xxhash64(F.lit(seed), *hashed), "__g": F.xxhash64(F.lit(seed + 1), *hashed)})
    # Written once, so sizes are not counted again for the plan.
    sized = materialize(rows.select("source", "size", "__g"), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, share, most, weights)
    whole = Window.partitionBy()
    quotas = sainte_lague(
        targets.withColumn("__all", F.round(F.sum("target").over(whole) / block).cast("long")), [],
        F.col("__all"), F.col("target"), F.struct(F.col("source").isNull(), F.col("source")),
    )
    words = F.least(F.col("quota") * block, F.col("source_size") * most)
    plan = quotas.select(
        "source", "source_size", "target",
        F.coalesce(F.floor(F.expr(f"try_divide(least(quota * {block}, source_size * {most}), source_size)")), F.lit(0)).cast("long").alias("__passes"),
        words.alias("__words"), F.ceil((F.col("source_size") + 1) / F.lit(shard_size)).cast("long").alias("__shards"),
    ).withColumn("__rest", F.col("__words") - F.col("__passes") * F.col("source_size"))
    # A row a source, written: its real size is known, so Spark broadcasts it while it is small,
    # and otherwise deals rows by source and splits the hot ones.
    plan = materialize(plan, "sources")
    # Null-safe equality on a struct key would not hash; a coalesced key and flag do.
    tag = lambda d: d.withColumns({"__src": F.coalesce("source", F.lit("")), "__nul": F.col("source").isNull()})
    in_shard = lambda d: tag(d).join(tag(plan).drop("source"), ["__src", "__nul"]).withColumn("__shard", F.when(F.col("size") > 0, F.pmod("__g", F.col("__shards"))).otherwise(F.lit(-1) - F.pmod("__g", F.lit(64))))
    rows = in_shard(rows)
    held = in_shard(sized).where("size > 0").groupBy("__src", "__nul", "__shard", "__rest").agg(F.sum("size").alias("__held"))
    shares = sainte_lague(
        held, ["__src", "__nul"], F.floor((F.col("__rest") + block - 1) / block), F.col("__held"), F.col("__shard"),
    ).select("__src", "__nul", "__shard", (F.col("quota") * block).alias("__quota"))
    line = Window.partitionBy("__src", "__nul", "__shard").orderBy("__h", "__g", "size").rowsBetween(Window.unboundedPreceding, -1)
    # Dealt by the whole key before the join, which would else be content with the source alone.
    rows = rows.repartition("__src", "__nul", "__shard").join(shares, ["__src", "__nul", "__shard"], "left")
    before = F.coalesce(F.sum("size").over(line), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("__quota", F.lit(0)) - before))
    return rows.withColumn("taken", (F.col("__passes") * F.col("size") + F.when(F.col("__passes") < most, part).otherwise(0)).cast("long")).select(
        *[c for c in docs.columns if c not in new], *new
    )
