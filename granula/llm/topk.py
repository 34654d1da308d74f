"""Exact top-k inner-product search by no-random-access aggregation of sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantise(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null if a component is null or not finite."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def nra(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best rows of ``x`` for each row of ``q`` as (query index, row index, score).

    A query reads one list a component, in order of falling contribution q_d * x_d: the list
    sorted by x_d from the top if q_d > 0, from the bottom if q_d < 0. After a depth, a row's
    score is at most what was read of it plus, for each list that it was not read from, that
    list's last contribution, and at least the same with the list's least one. Reading goes on
    (an eighth, a quarter, a half, all) until no row outside those whose upper bound
    reaches the k-th lower bound can qualify and these are few; their lists are then read to
    the end for these rows alone, which gives their final scores. Works on 64-bit floats, which
    hold the integers exactly below 2**53.
    """
    n, d = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None].repeat(d, 1), 0)
    ordered = np.take_along_axis(x, order, 0)
    least, most = ordered[0], ordered[-1]
    position = {v: i for i, v in enumerate(ids.tolist())} if len(set(ids.tolist())) == n else None
    todo, out = np.arange(len(q)), []
    for depth in dict.fromkeys((max(1, n // 8), max(1, n // 4), max(1, n // 2), n)):
        down, up = rank >= n - depth, rank < depth
        last_down, last_up = ordered[n - depth], ordered[depth - 1]
        x_down, x_up, not_down, not_up = x * down, x * up, (~down).astype(float), (~up).astype(float)
        again = []
        for part in np.array_split(todo, max(1, len(todo) // 64)):
            if not len(part):
                continue
            plus, minus = np.maximum(q[part].T, 0), np.minimum(q[part].T, 0)
            read = x_down @ plus + x_up @ minus
            if depth < n:
                upper = read + not_down @ (plus * last_down[:, None]) + not_up @ (minus * last_up[:, None])
                lower = read + not_down @ (plus * least[:, None]) + not_up @ (minus * most[:, None])
            else:
                upper = lower = read
            for j, i in enumerate(part):
                same = [position[own[i]]] if position is not None and own[i] in position else [] if position is not None else np.flatnonzero(ids == own[i])
                low, high = lower[:, j], upper[:, j]
                if len(same):
                    low, high = low.copy(), high.copy()
                    low[same] = high[same] = -np.inf
                m = n - len(same)
                if m <= 0:
                    continue
                bar = np.partition(low, n - min(k, m))[n - min(k, m)]
                rows = np.flatnonzero((high >= bar) & (high > -np.inf))
                if depth < n and len(rows) > max(4 * k, n // 16):
                    again.append(i)
                    continue
                score = (x[rows] @ q[i]).astype(np.int64)
                for r in np.lexsort((ids[rows], -score))[:k]:
                    out.append((int(i), int(rows[r]), int(score[r])))
        todo = np.array(again, int)
        if not len(todo):
            break
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int, *, shard_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """The ``k`` rows of ``vectors`` (id, v: array<long>) with the highest inner product for
    each row of ``queries`` (id, v): query_id, rank from 1, vec_id, score; ties to the smaller id.

    Rows are dealt to shards and queries to blocks of bounded size; each pair of a shard and a
    block meets in one task by equality of their numbers, reads its own sorted lists and gives
    k rows a query, and the best k of these are ranked. A query's own id is left out. Null ids
    and vectors take no part; only vectors of a query's length count; repeated ids are ranked
    each; empty tables give no rows.
    """
    vectors = vectors.select("id", "v").where("id is not null and v is not null")
    queries = queries.select("id", "v").where("id is not null and v is not null")
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumns({"d": F.size("v"), "shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")}).select("*", every(blocks).alias("block"))
    right = queries.withColumns({"d": F.size("v"), "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")}).select("*", every(shards).alias("shard"))

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        got = []
        if rows.num_rows and asked.num_rows:
            d = rows.column("d")[0].as_py()
            matrix = lambda t: t.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(t.num_rows, d).astype(float)
            ids, own = rows.column("id").to_numpy(), asked.column("id").to_numpy()
            if d:
                got = [(own[i], ids[r], s) for i, r, s in nra(matrix(rows), ids, matrix(asked), own, k)]
        return pa.table({c: pa.array([g[i] for g in got], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    key = ["d", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
