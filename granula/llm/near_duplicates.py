"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.blocks import cross_links
from granula.llm.common import WordHashes, batch_rows, gram_hashes, materialize, mix, text_chunks, utf8
from granula.llm.components import components

#: SetSketch parameters: registers, base, rate, largest register value.
M, BASE, RATE, TOP = 128, 1.001, 20.0, 65535
#: Registers a band; 32 bands of 4 find a pair of similarity 0.75 with probability 1 - 5e-6.
ROWS = 4
#: Open buckets of up to so many sets are compared by a join of their pairs, larger ones in blocks; both compare all.
PAIRWISE = 48
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, M, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, M, dtype=np.uint32)


def shingle_set(text: bytes, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; ASCII case is ignored."""
    words = text.lower().split()
    return np.unique(gram_hashes(hashes.of(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16, a row a non-empty set): truncated floor(1 - log_b of the least
    exponential variate). Registers of a union are the larger of each pair, see ``merge``."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(sets), M), np.uint32)
    y = np.empty_like(x)
    for i in range(M):
        np.multiply(x, _A[i], out=y)
        y += _B[i]
        least[:, i] = np.minimum.reduceat(y, starts)
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of the two sets."""
    return np.maximum(a, b)


def bands(r: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    k = np.ascontiguousarray(r).view(np.uint64)
    return mix(k + np.arange(1, M // ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def plausible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, nats: float = 14.0) -> np.ndarray:
    """Whether the likelihood of the registers leaves room for a similarity of ``least`` or more.

    With u and v the sets' shares of the summed sizes, registers compare greater with
    probability p(u - v J) and less with p(v - u J), p(x) = -log_b(1 - x (b - 1) / b). A pair
    is dropped only if no J from ``least`` on comes within ``nats`` of the highest likelihood.
    """
    up, down = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    most = np.minimum(na, nb) / np.maximum(na, nb)
    j = np.linspace(0, 1, 101)[None, :] * most[:, None]
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
    more, fewer = p(u - (1 - u) * j), p(1 - u - u * j)
    like = up * np.log(more) + down * np.log(fewer) + (M - up - down) * np.log(np.clip(1 - more - fewer, 1e-9, 1))
    return np.where(j >= least - 0.01, like, -np.inf).max(1) >= like.max(1) - nats


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk in text_chunks(batches):
            sets = [shingle_set(t, hashes, n) for t in utf8(chunk.column("text"))]
            full = [s for s in sets if len(s)]
            keys = iter(bands(registers(full))) if full else iter(())
            yield pa.record_batch([
                chunk.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], ["doc_id", "n", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n long, key binary, bands array<long>")


def _payload(docs: DataFrame, n: int) -> DataFrame:
    """Registers and whole shingle sets of documents."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk in text_chunks(batches):
            sets = [shingle_set(t, hashes, n) for t in utf8(chunk.column("text"))]
            yield pa.record_batch([
                chunk.column("doc_id"), pa.array([r.tobytes() for r in registers(sets)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], ["id", "registers", "shingles"])

    return docs.mapInArrow(rows, "id long, registers binary, shingles binary")


def hashes_of(data: bytes) -> np.ndarray:
    """A shingle set from its stored form."""
    return np.frombuffer(data, np.uint64)


def _verified(pairs: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, x, y) with 100 * intersection >= ``percent`` * union on the full sets, as (x, y)."""
    side = lambda c: payload.select(F.col("id").alias(c), F.col("registers").alias(f"r{c}"), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                s = b.slice(k, 256)
                ra, rb = (np.frombuffer(b"".join(s.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
                sa, sb = ([np.frombuffer(x, np.uint64) for x in s.column(c).to_pylist()] for c in ("sa", "sb"))
                na, nb = (np.array([len(x) for x in y]) for y in (sa, sb))
                keep = plausible(ra, rb, na, nb, percent / 100)
                for i in np.flatnonzero(keep):
                    both = len(np.intersect1d(sa[i], sb[i], assume_unique=True))
                    keep[i] = 100 * both >= percent * (na[i] + nb[i] - both)
                yield pa.record_batch([s.column(c).filter(pa.array(keep)) for c in ("x", "y")], ["a", "b"])

    return both.select("x", "y", "ra", "sa", "rb", "sb").mapInArrow(rows, "a long, b long")


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Documents are linked if the Jaccard similarity of their sets of ``n``-word shingles (the
    whole sequence, with fewer words) is ``percent`` or more; component_id is the smallest
    doc_id reachable over links and ``kept`` says that it is the document's own.

    1. Documents with equal sets become one class, so groups of copies do not meet again.
    2. A class has a SetSketch; each band's bucket pairs its members with its least member and
       with that of the least hash. Candidates with plausible likelihood are verified on the full sets.
    3. Buckets whose members are then in several components compare all their pairs over
       different components, small ones by a join, larger ones block by block, so no pair that
       shares a bucket is left untested between components.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with a null
    doc_id are returned with null component_id and kept; rows that repeat a doc_id are all
    returned and have its component. An empty table gives no rows.
    """
    batch_rows(docs.sparkSession)
    all_rows = materialize(_sketches(docs, n), "sketches")
    known = all_rows.where("n > 0 and doc_id is not null")
    reps = known.groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = known.join(reps, (known.key == reps.key) & (known.doc_id == reps.rep)).select("rep", "n", "bands").dropDuplicates(["rep"])
    buckets = classes.select("rep", "n", F.explode("bands").alias("band"))
    one = F.struct("rep", "n")
    leaders = buckets.groupBy("band").agg(F.min(one).alias("lead"), F.min_by(one, F.xxhash64("rep")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = materialize(buckets.join(leaders, "band").select("band", "rep", "n", "lead", "pivot", "size"), "members")
    similar_size = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    met = members.select("rep", "n", F.explode(F.array("lead", "pivot")).alias("o")).where((F.col("rep") != F.col("o.rep")) & similar_size(F.col("n"), F.col("o.n")))
    tested = materialize(met.select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b")).distinct(), "pairs")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    payload = materialize(_payload(docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id").select("doc_id", "text"), n).dropDuplicates(["id"]), "payload")
    labels = components(_verified(tested.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), payload, percent))
    at = members.select("band", "rep", "n", "size").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    several = at.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    open_ = materialize(at.join(several, "band", "left_semi"), "open")
    small = open_.where(F.col("size") <= PAIRWISE).select("band", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("x"))
    right = small.select("band", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("x").alias("y"))
    cross = small.join(right, "band").where("a < b and x <> y").where(similar_size(F.col("na"), F.col("nb"))).select("a", "b", "x", "y").distinct()
    found = _verified(cross.join(tested, ["a", "b"], "left_anti"), payload, percent)
    large = open_.where(F.col("size") > PAIRWISE).select(F.col("band").alias("bucket"), F.col("rep").alias("id"), "n", "label")
    if not large.isEmpty():
        found = found.unionByName(cross_links(large, payload.select("id", F.col("shingles").alias("data")), hashes_of, percent))
    # The links found last join labels, so their graph is small; its components relabel the classes.
    again = components(found).select(F.col("id").alias("label"), F.col("component").alias("whole"))
    labels = labels.select(F.col("id").alias("rep"), F.col("component").alias("label"))
    of_class = reps.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")).join(again, "label", "left").select("key", F.coalesce("whole", "label").alias("component"))
    # Rows without shingles have a null key and keep their own id.
    out = all_rows.join(of_class, "key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
