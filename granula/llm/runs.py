"""Periodic runs of words: dyadic blocks look for themselves in the windows beside them.

A run is a stretch of words with smallest period q that cannot be extended and holds q at least
four times. A block of 2^k words that lies in such a run, with q at most 2^k and above half of
it, occurs again q words before or behind; a dyadic block always lies there. The next occurrence
on either side is found by range successor over the suffix array, so it costs the logarithm of
the text. Occurrences in the window form an arithmetic progression, and its difference is the
candidate's period.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import batch_rows, text_chunks, utf8

SCHEMA = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"
#: A run holds its period so many times, and so many words at least.
TIMES, LEAST = 4, 6


class WaveletTree:
    """Counts and order statistics of ranges of an array of integers below 2^bits, a bit a level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.before = bits, [], []
        for k in range(bits - 1, -1, -1):
            one = (values >> k & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32)  # zeros among the first i
            np.cumsum(~one, out=before[1:])
            self.before.append(before)
            self.zeros.append(int(before[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are less than x."""
        out = np.zeros(len(lo), np.int64)
        for k, zeros, before in zip(range(self.bits - 1, -1, -1), self.zeros, self.before, strict=True):
            a, b = before[lo].astype(np.int64), before[hi].astype(np.int64)
            one = (x >> k & 1).astype(bool)
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return out

    def ranked(self, lo: np.ndarray, hi: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The value of rank r, from 0, among [lo, hi)."""
        out = np.zeros(len(lo), np.int64)
        for k, zeros, before in zip(range(self.bits - 1, -1, -1), self.zeros, self.before, strict=True):
            a, b = before[lo].astype(np.int64), before[hi].astype(np.int64)
            one = r >= b - a
            out |= one.astype(np.int64) << k
            r = np.where(one, r - (b - a), r)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return out


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes sorted by their first 2^K ids, and for each k <= K the class of the 2^k ids at each place.

    A class is named by its first place in the order, so it is a range of it. K is the first
    depth at which no class has two members; only places whose class has are sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.r_[True, ids[order][1:] != ids[order][:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else 0
    ranks, width = [rank.astype(np.int32)], 1
    while n:
        last = np.r_[first[1:], True]
        slots = np.flatnonzero(~(first & last))
        if not len(slots):
            break
        at = order[slots]
        behind = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        sort = np.lexsort((behind, rank[at]))
        at, behind = at[sort], behind[sort]
        order[slots] = at
        new = np.r_[True, (rank[at][1:] != rank[at][:-1]) | (behind[1:] != behind[:-1])]
        first = first.copy()
        first[slots] = new
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        ranks.append(rank.astype(np.int32))
        width *= 2
    return order, ranks


def _extend(ranks: list[np.ndarray], a: np.ndarray, d: np.ndarray, back: bool) -> np.ndarray:
    """How far the ids from a on (or before a, if ``back``) equal those d places further, by doubling."""
    n, a = len(ranks[0]), a.copy()
    begun = a.copy()
    for k in range(len(ranks) - 1, -1, -1):
        step, rank = 1 << k, ranks[k]
        for _ in range(2 if k == len(ranks) - 1 else 1):
            x = a - step if back else a
            fits = (x >= 0) & (x + d + step <= n)
            y = np.where(fits, x, 0)
            same = fits & (rank[y] == rank[np.minimum(y + d, n - 1)])
            a = np.where(same, a - step if back else a + step, a)
    return begun - a if back else a - begun


def find_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run in ``ids``, by start, then period."""
    n = len(ids)
    none = np.empty(0, np.int64)
    if n < LEAST:
        return none, none, none
    order, ranks = suffix_order(ids)
    if len(ranks) < 2:
        return none, none, none
    tree = WaveletTree(order.astype(np.int64), max(1, int(n - 1).bit_length()))
    places, periods = [], []
    for k in range(1, len(ranks)):
        width, rank = 1 << k, ranks[k].astype(np.int64)
        size = np.bincount(rank, minlength=n)
        at = np.arange(0, n - width + 1, width)
        at = at[size[rank[at]] > 1]
        if not len(at):
            continue
        lo = rank[at]
        hi = lo + size[lo]
        mine = tree.below(lo, hi, at)
        for other in (mine + 1, mine - 1):
            there = (other >= 0) & (other < hi - lo)
            b = at[there]
            found = tree.ranked(lo[there], hi[there], other[there])
            d = np.abs(found - b)
            near = (d <= width) & (d > (width >> 1 if k > 1 else 0))
            places.append(np.minimum(b, found)[near])
            periods.append(d[near])
    if not places:
        return none, none, none
    a, d = np.concatenate(places), np.concatenate(periods)
    start = a - _extend(ranks, a, d, True)
    length = a + _extend(ranks, a, d, False) + d - start
    good = length >= np.maximum(LEAST, TIMES * d)
    runs = np.unique(np.stack([start, d, length], 1)[good], axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def planted(words: list[bytes], doc: int | None) -> list[bytes]:
    """The words with a periodic tail, in documents whose checksum ends in the digit 0."""
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a, times = g % n, 3 + g % 8
    p = 1 + (n - a) // times
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapse(words: list[bytes], starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by single spaces."""
    if not len(starts):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts + periods, 1)
    np.add.at(edge, starts + lengths, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, *, plant: bool = False) -> DataFrame:
    """The start, length and smallest period of each run of each text, and the text without repetitions.

    Words are those between white space, numbered from 0; runs are sorted by start, then period.
    ``collapsed`` has the words that no run holds behind its first period, joined by single
    spaces. Each task takes its texts in chunks of about 2 MB and finds the runs of a chunk
    together; words of different documents never equal each other. Nothing is shuffled.
    ``plant`` makes some texts periodic first (:func:`planted`).

    Null and empty texts have no words and no runs; null doc_ids stay null and are never
    planted; repeated rows are treated each. An empty table gives no rows, other columns of
    ``docs`` are ignored. A text longer than a chunk is a chunk of its own, whole: it takes
    about 150 bytes a word.
    """
    batch_rows(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            texts = [t.split() for t in utf8(chunk.column("text"))]
            docs = chunk.column("doc_id")
            if plant:
                texts = [planted(w, i) for w, i in zip(texts, docs.to_pylist(), strict=True)]
            ends = np.cumsum([len(w) + 1 for w in texts])
            ids, low = np.empty(ends[-1], np.int64), 0
            for w, end in zip(texts, ends.tolist(), strict=True):  # a number a word of a document, one more behind it
                known = dict(zip(w, range(low, low + len(w)), strict=True))
                ids[end - len(w) - 1 : end - 1] = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                low += len(w) + 1
                ids[end - 1] = low - 1
            start, length, period = find_runs(ids)
            doc = np.searchsorted(ends, start, side="right")
            start = start - np.r_[0, ends[:-1]][doc]
            cut = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            kept = [collapse(w, start[i:j], length[i:j], period[i:j]) for w, i, j in zip(texts, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x, pa.int64())) for x in (start, length, period)]
            counts = pa.array([len(w) for w in texts], pa.int64())
            yield pa.record_batch([docs, counts, *lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "starts", "lengths", "periods", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, SCHEMA)


def digest(runs: DataFrame) -> DataFrame:
    """Per document the number of runs, that of greatest exponent, and hashes of all runs and of the collapsed text.

    Exponents are compared exactly, as products of longs; ties go to the smallest start, then
    period. A document without runs has null in the four columns of that run.
    """
    run = F.arrays_zip("starts", "lengths", "periods")
    better = lambda a, x: F.when(a["lengths"].isNull() | (x["lengths"] * a["periods"] > a["lengths"] * x["periods"]), x).otherwise(a)
    none = F.lit(None).cast("struct<starts:bigint,lengths:bigint,periods:bigint>")
    told = F.array_join(F.transform(run, lambda x: F.concat_ws(",", x["starts"], x["lengths"], x["periods"])), "\n")
    return runs.withColumn("top", F.aggregate(run, none, better)).select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), F.col("top.starts").alias("start"), F.col("top.lengths").alias("length"), F.col("top.periods").alias("period"),
        F.expr("1000 * top.lengths div top.periods").alias("exponent_milli"),
        F.sha2(F.when(F.size("starts") > 0, F.concat(told, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
