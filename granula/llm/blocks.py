"""All links between different components of the same bucket, in bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import materialize

#: Sets a block holds on average, and elements of its sets together.
SETS, ELEMENTS = 512, 1 << 20
#: Elements whose incidence is held at once.
WIDTH = 4096


def _incidence(sets: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each element of ``sets`` that is in the sorted array ``shared``."""
    x = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
    hit = shared[at] == x
    return row[hit], at[hit]


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``; sets are arrays without repeats."""
    out = np.zeros((len(a), len(b)), np.int64)
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(shared):
        return out
    (ra, ca), (rb, cb) = _incidence(a, shared), _incidence(b, shared)
    for start in range(0, len(shared), WIDTH):
        x, y = np.zeros((len(a), WIDTH), np.float32), np.zeros((len(b), WIDTH), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            some = (c >= start) & (c < start + WIDTH)
            m[r[some], c[some] - start] = 1
        out += (x @ y.T).astype(np.int64)  # exact: counts up to WIDTH
    return out


def _linked(a: dict, b: dict, percent: int) -> list[tuple[int, int]]:
    """Pairs of different labels over two blocks with sets similar enough; of pairs that would
    close a circle of labels, the first."""
    both = intersections(a["sets"], b["sets"])
    na, nb = (np.array([len(s) for s in x["sets"]])[:, None] for x in (a, b))
    hit = (100 * both >= percent * (na + nb.T - both)) & (a["label"][:, None] != b["label"][None, :])
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for i, j in np.argwhere(hit).tolist():
        p, q = int(a["label"][i]), int(b["label"][j])
        x, y = find(p), find(q)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((min(p, q), max(p, q)))
    return out


def cross_links(members: DataFrame, payload: DataFrame, to_set: Callable[[bytes], np.ndarray], percent: int) -> DataFrame:
    """Links (a, b) between labels that join those of every bucket as far as its members' similarities do.

    ``members`` (bucket, id, n, label) has a row a member, n the size of its set; ``payload``
    (id, data) has the data from which ``to_set`` makes it. Every pair of members of a bucket
    with different labels and sizes that allow ``percent`` is compared on its full sets: members
    are dealt by length class and hash into blocks of bounded size, and blocks meet two by two.
    Members of a bucket's largest label do not meet each other.
    """
    labels = members.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    top = labels.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    # Written, so that the join with it knows its size and can split a hot bucket.
    top = materialize(top, "mains")
    # Sizes of a similar pair differ by at most one class; a little wider, so rounding is safe.
    wide = max(math.log(100 / percent), 0.01) * 1.0001
    at = members.join(top.select("bucket", F.col("top.label").alias("main")), "bucket")
    at = at.select("bucket", "id", "n", "label", (F.col("label") == F.col("main")).alias("main"), F.floor(F.log("n") / wide).cast("int").alias("class"))
    kinds = at.groupBy("bucket", "class", "main").agg(F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / ELEMENTS)).cast("int").alias("parts"))
    blocks = kinds.select("bucket", "class", "main", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    key = F.struct("class", "main", "part")
    left, right = blocks.select("bucket", key.alias("x")), blocks.select("bucket", key.alias("y"))
    meet = left.join(right, "bucket").where("x <= y and abs(x.class - y.class) <= 1 and not (x.main and y.main)")
    meet = materialize(meet, "meetings")
    side = lambda c, s: meet.select("bucket", F.col(c).alias("block"), "x", "y", F.lit(s).alias("side"))
    both = side("x", 0).unionByName(side("y", 1).where("x <> y"))
    placed = at.join(kinds, ["bucket", "class", "main"]).withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)")).select("bucket", key.alias("block"), "id", "label")
    dealt = placed.join(both, ["bucket", "block"]).select("bucket", "x", "y", "side", "id", "label").join(payload.select("id", "data"), "id").drop("id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [{"label": [], "sets": []} for _ in range(2)]
        for batch in batches:
            for s, label, data in zip(*(batch.column(c).to_pylist() for c in ("side", "label", "data")), strict=True):
                sides[s]["label"].append(label)
                sides[s]["sets"].append(to_set(data))
        held = [{"label": np.array(x["label"], np.int64), "sets": x["sets"]} for x in sides]
        a, b = held if held[1]["sets"] else (held[0], held[0])
        out = _linked(a, b, percent) if a["sets"] else []
        if out:
            yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], ["a", "b"])

    return dealt.groupBy("bucket", "x", "y").applyInArrow(rows, "a long, b long").distinct()
