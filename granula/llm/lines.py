"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard, union of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.blocks import cross_links
from granula.llm.common import batch_rows, materialize, mix, text_chunks, utf8
from granula.llm.components import components

#: Bytes of a character shingle; shorter lines are one shingle, padded.
SHINGLE = 8
#: 8 bands of 5 rows find a pair of similarity 0.85 with probability 0.991, of 0.9 with 0.9993.
BANDS, ROWS = 8, 5
#: Open buckets of up to so many lines are compared by a join of their pairs, larger ones in blocks; both compare all.
PAIRWISE = 48
#: Bits of the filter that spares the shuffle most lines that are nobody's candidate (2 MB, fixed).
FILTER_BITS = 1 << 24
_rng = np.random.default_rng(991)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All 8-byte shingles of non-empty lines as integers, and where each line's start."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, b"\0") for x in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    b = np.frombuffer(b"".join(padded), np.uint8)
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    eight = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))
    ends = np.cumsum(sizes)
    valid = np.ones(len(b), bool)
    for k in range(1, SHINGLE):
        valid[ends - k] = False
    counts = sizes - SHINGLE + 1
    return eight[valid[: len(eight)]], np.cumsum(counts) - counts


def signatures(lines: list[bytes], most: int = 1 << 16) -> np.ndarray:
    """Band keys (int64, BANDS a row) of non-empty lines, cut about ``most`` bytes at once, which stay in a core's cache."""
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    cuts = np.flatnonzero(np.diff(ends // most)) + 1
    parts = zip([0, *cuts.tolist()], [*cuts.tolist(), len(lines)], strict=True)
    return np.concatenate([_signatures(lines[a:b]) for a, b in parts])


def _signatures(lines: list[bytes]) -> np.ndarray:
    s, starts = shingles(lines)
    x = (mix(s) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(lines), BANDS * ROWS), np.uint64)
    y = np.empty_like(x)
    for i in range(BANDS * ROWS):
        np.multiply(x, _A[i], out=y)  # a permutation of the mixed shingles
        least[:, i] = np.minimum.reduceat(y, starts)
    least = least.reshape(len(lines), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key + least[:, :, r])
    return key.view(np.int64)


def _lines(text: bytes) -> tuple[list[int], list[bytes]]:
    """Numbers and bytes of the lines that hold a word."""
    parts = text.split(b"\n")
    at = [i for i, x in enumerate(parts) if x and not x.isspace()]
    return at, parts if len(at) == len(parts) else [parts[i] for i in at]


def line_ids(lines: list[bytes]) -> np.ndarray:
    """64-bit hash of each line."""
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)) ^ np.uint64(1 << 63)).view(np.int64)


def _table(docs: DataFrame, remembered: int = 200_000) -> DataFrame:
    """(line, k, id, at, keys): a row a line; keys of a line that its task has seen are null."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in text_chunks(batches):
            lines, at, counts = [], [], []
            for text in utf8(chunk.column("text")):
                places, found = _lines(text)
                at += places
                lines += found
                counts.append(len(found))
            if not lines:
                continue
            ids = line_ids(lines)
            new = []
            for i, h in enumerate(ids.tolist()):
                if h not in seen:
                    if len(seen) >= remembered:
                        seen.clear()
                    seen.add(h)
                    new.append(i)
            known = np.ones(len(lines), bool)
            known[new] = False
            ends = np.concatenate([[0], np.cumsum(np.where(known, 0, BANDS))]).astype(np.int32)
            values = signatures([lines[i] for i in new]).ravel() if new else np.empty(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(known))
            k, doc = (np.repeat(chunk.column(c).to_numpy(), counts) for c in ("k", "id"))
            yield pa.record_batch([pa.array(ids), pa.array(k), pa.array(doc), pa.array(np.array(at, np.int32)), keys], ["line", "k", "id", "at", "keys"])

    return docs.select("k", "id", "text").mapInArrow(rows, "line long, k long, id long, at int, keys array<long>")


def _chains(table: DataFrame) -> DataFrame:
    """(key, lead, last, line, rank): a row a member of a bucket behind its least, ``lead``; ``last``
    is the member before it. Buckets come sorted, and what is kept of one is its last row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line, lead, rank = (np.empty(0, np.int64) for _ in range(4))  # the member before the batch
        for b in batches:
            if not b.num_rows:
                continue
            k, x = (np.concatenate([c, b.column(n).to_numpy()]) for c, n in ((key, "key"), (line, "line")))
            held = len(key)
            fresh = np.ones(len(k), bool)  # not the same line in the same bucket again
            fresh[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
            k, x = k[fresh], x[fresh]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            at = np.arange(len(k))
            start = np.maximum.accumulate(np.where(first, at, 0))
            leads, ranks = x[start], at - start
            if held:
                leads, ranks = np.where(start == 0, lead, leads), np.where(start == 0, ranks + rank, ranks)
            some = np.flatnonzero(~first)
            key, line, lead, rank = k[-1:], x[-1:], leads[-1:], ranks[-1:]
            if len(some):
                yield pa.record_batch([pa.array(v) for v in (k[some], leads[some], x[some - 1], x[some], ranks[some])], ["key", "lead", "last", "line", "rank"])

    keys = table.where("keys is not null").select("line", F.explode("keys").alias("key"))
    return keys.repartition("key").sortWithinPartitions("key", "line").select("key", "line").mapInArrow(rows, "key long, lead long, last long, line long, rank long")


def _open(chains: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, id, label, size) of the members of buckets of four and more, in which not all pairs have
    met, that are in several components."""
    big = chains.groupBy("key").agg(F.max("rank").alias("r")).where("r > 2").select("key")
    rows = chains.join(big, "key", "left_semi")
    members = rows.select("key", "line").unionByName(rows.where("rank = 1").select("key", F.col("lead").alias("line")))
    at = members.join(groups, "line", "left").select(F.col("key").alias("bucket"), F.col("line").alias("id"), F.coalesce("component", "line").alias("label"))
    # Written, so that the join with it knows its size and can split a hot bucket.
    several = materialize(at.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x <> y").select("bucket", "size"), "several")
    return at.join(several, "bucket")


def shingle_set(line: bytes) -> np.ndarray:
    """Sorted distinct shingles of a line."""
    return np.unique(shingles([line])[0])


def bit_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit array of fixed size in which the bit of every id is set. It can only spare work:
    what passes it is joined exactly."""
    bit = F.pmod(F.col(column), F.lit(bits)).alias("bit")
    words = ids.select(bit).groupBy(F.expr("bit div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 32)))").alias("v"))
    out = np.zeros(bits // 32, np.uint32)
    for w in words.toLocalIterator():  # bits / 32 rows at most
        out[w.w] = w.v & 0xFFFFFFFF
    return out


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(line, text) of the lines in ``ids`` (line), from a scan of the documents."""
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, "line"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for chunk in text_chunks(batches):
            lines = list({x for t in utf8(chunk.column("text")) for x in _lines(t)[1]})
            if not lines:
                continue
            h = line_ids(lines)
            bit = np.mod(h, FILTER_BITS)
            some = np.flatnonzero((bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1)
            if len(some):
                yield pa.record_batch([pa.array(h[some]), pa.array([lines[i] for i in some.tolist()], pa.binary())], ["line", "text"])

    return docs.select("text").mapInArrow(rows, "line long, text binary").join(ids, "line", "left_semi").dropDuplicates(["line"])


def _sizes(texts: DataFrame) -> DataFrame:
    """(id, n): the number of distinct shingles of each line."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(shingle_set(x)) for x in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("line"), pa.array(n, pa.int64())], ["id", "n"])

    return texts.select("line", "text").mapInArrow(rows, "id long, n long")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """Whether the shingle sets of two lines have a Jaccard similarity of ``percent`` or more."""
    x, y = shingle_set(a), shingle_set(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def similar_pairs(a: list[bytes], b: list[bytes], percent: int, most: int = 1 << 19) -> np.ndarray:
    """``similar`` for many pairs, up to 512 pairs or about ``most`` bytes of lines at once: the shingles of
    all are sorted by pair and 54 bits of hash, repeats within a line go, and those alike on both
    sides stand next to each other. Counts are off with a chance of some 1e-11 a pair."""
    out, start = [], 0
    while start < len(a):
        stop, size = start, 0
        while stop < len(a) and stop - start < 512 and (size := size + len(a[stop]) + len(b[stop])) <= most:
            stop += 1
        stop = max(stop, start + 1)
        s, starts = shingles([x for pair in zip(a[start:stop], b[start:stop], strict=True) for x in pair])
        n = np.diff(np.append(starts, len(s)))
        row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        key = (row >> np.uint64(1)) << np.uint64(55) | (mix(s) >> np.uint64(10)) << np.uint64(1) | row & np.uint64(1)
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        pair = (key >> np.uint64(55)).astype(np.int64)
        total = np.bincount(pair, minlength=stop - start)
        both = np.bincount(pair[1:][key[1:] >> np.uint64(1) == key[:-1] >> np.uint64(1)], minlength=stop - start)
        out.append(100 * both >= percent * (total - both))
        start = stop
    return np.concatenate(out) if out else np.empty(0, bool)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, x, y) whose lines a and b are similar, as (x, y)."""
    side = lambda c: texts.select(F.col("line").alias(c), F.col("text").alias(f"t{c}"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(similar_pairs(b.column("ta").to_pylist(), b.column("tb").to_pylist(), percent))
            yield pa.record_batch([b.column(c).filter(keep) for c in ("x", "y")], ["a", "b"])

    return pairs.join(side("b"), "b").join(side("a"), "a").select("x", "y", "ta", "tb").mapInArrow(rows, "a long, b long")


def dedup_lines(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    r"""``docs`` (doc_id, text, ...) with n_lines, n_removed and the text without removed lines.

    Lines are the parts of a text between \n that hold a word. Lines whose sets of 8-byte
    shingles have a Jaccard similarity of ``percent`` or more are linked; of each component of
    equal and linked lines the one in the smallest doc_id, there the first, is kept. Lines
    without a word stay as they are, and a removed line goes with one \n.

    Each distinct line of a task gets a MinHash signature; buckets of a band are streamed in
    order and link each member to the bucket's least and to its neighbour; candidates are
    verified on their whole texts, fetched past a filter of fixed size; components come from
    star rounds. Buckets whose members are then in several components compare all pairs between
    them, small ones by a join, larger ones block by block. The filter and the banding decide which pairs are compared, never what is removed.

    Null and blank texts have no lines and stay. Null doc_ids come last. Rows that repeat doc_id
    and text are one document: its first occurrence of a line is kept in each. An empty table
    gives no rows. Columns named n_lines and n_removed are replaced; others stay.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*keep).withColumn("__k", F.xxhash64("doc_id", "text"))
    keyed = docs.select(F.col("__k").alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), "text")
    batch_rows(docs.sparkSession)
    table = materialize(_table(keyed), "lines")
    batch_rows(docs.sparkSession, 8192)
    chains = materialize(_chains(table), "chains")
    pairs = materialize(chains.select(F.col("lead").alias("a"), F.col("line").alias("b")).unionByName(chains.select(F.col("last").alias("a"), F.col("line").alias("b"))).distinct(), "pairs")
    batch_rows(docs.sparkSession)
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "wanted")
    texts = materialize(_texts(keyed, wanted), "texts")
    groups = components(_verified(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), texts, percent)).withColumnRenamed("id", "line")
    rest = materialize(_open(chains, groups), "open")
    if not rest.isEmpty():
        small = rest.where(F.col("size") <= PAIRWISE).select("bucket", F.col("id").alias("a"), F.col("label").alias("x"))
        cross = small.join(small.select("bucket", F.col("a").alias("b"), F.col("x").alias("y")), "bucket").where("a < b and x <> y").select("a", "b", "x", "y").distinct()
        found = _verified(cross.join(pairs, ["a", "b"], "left_anti"), texts, percent)
        large = rest.where(F.col("size") > PAIRWISE).drop("size")
        if not large.isEmpty():
            sizes = _sizes(texts.join(large.select(F.col("id").alias("line")).distinct(), "line", "left_semi"))
            found = found.unionByName(cross_links(large.join(sizes, "id"), texts.select(F.col("line").alias("id"), F.col("text").alias("data")), shingle_set, percent))
        # Links between labels; a label that no link had before is the line itself.
        again = components(found)
        whole = again.select(F.col("id").alias("component"), F.col("component").alias("whole"))
        alone = again.withColumnRenamed("id", "line").join(groups, "line", "left_anti")
        groups = groups.join(whole, "component", "left").select("line", F.coalesce("whole", "component").alias("component")).unionByName(alone)
    placed = table.select("line", "k", "id", "at").join(groups, "line", "left").withColumn("group", F.coalesce("component", "line"))
    firsts = materialize(placed.groupBy("group").agg(F.min(F.struct("id", "at", "k")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "firsts")
    later = placed.join(firsts, "group").where((F.col("k") != F.col("first.k")) | (F.col("at") != F.col("first.at")))
    gone = later.groupBy("k").agg(F.collect_set("at").alias("gone")).withColumnRenamed("k", "__k")
    schema = docs.drop("__k").schema.add("n_lines", "long").add("n_removed", "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            texts, total, removed = [], [], []
            for text, drop in zip(chunk.column("text").to_pylist(), chunk.column("gone").to_pylist(), strict=True):
                drop = set(drop or ())
                texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text)
                total.append(len(_lines((text or "").encode())[0]))
                removed.append(len(drop))
            columns = [pa.array(texts, pa.string()) if c == "text" else chunk.column(c) for c in keep]
            yield pa.record_batch([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*keep, "n_lines", "n_removed"])

    # The side without texts is hashed, so no text is sorted.
    return docs.join(gone.hint("shuffle_hash"), "__k", "left").select(*keep, "gone").mapInArrow(rows, schema)
