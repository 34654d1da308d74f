"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import batch_rows, text_chunks, utf8

#: Buckets of the two multinomials.
BUCKETS = 1 << 16
#: Labelled documents of each kind (trusted, rejected, toxic) that are used at most: those with the
#: least seeded hash of their doc_id. A bound on what is broadcast, and on nothing else.
LABELLED = 20_000
#: Buckets of words, and the documents by which a word's toxic count and its expectation are smoothed.
WORD_BUCKETS, PRIOR = 1 << 20, 2.0
#: The characters that count as symbols.
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_MULTIPLY = np.uint32(2654435761)
#: Punctuation that is taken off a word's ends.
_MARKS = string.punctuation.encode()
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, toxic_llr double"


def buckets(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram of the text, white space and all; shorter texts have none."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * _MULTIPLY) >> np.uint32(16)


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows found twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    if len(number) < 1 << 20:
        key = (w[:-2] * len(number) + w[1:-1]) * len(number) + w[2:]
    else:
        pairs = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)[1]
        key = pairs[:-1] * len(number) + w[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    many = np.zeros(n, bool)
    many[order] = same[1:] | same[:-1]
    cover = np.zeros(len(words), bool)
    cover[:n] |= many
    cover[1 : n + 1] |= many
    cover[2:] |= many
    return int(cover.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.split()
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, len(_SYMBOLS.findall(text)), again, repeat_words(words)


class WordBuckets(dict):
    """Bucket of each word without case and outer punctuation, remembered for at most ``most`` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = b = xxhash.xxh3_64_intdigest(word.lower().strip(_MARKS)) % WORD_BUCKETS
        return b

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _toxic_words(docs: DataFrame) -> DataFrame:
    """(bucket, toxic): in how many of ``docs`` a word bucket occurs."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, n = WordBuckets(), np.zeros(WORD_BUCKETS, np.int64)
        for chunk in text_chunks(batches):
            for t in utf8(chunk.column("text")):
                n[np.unique(bucket.of(t.split()))] += 1
        some = np.flatnonzero(n)
        if len(some):
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "toxic"])

    return docs.select("text").mapInArrow(rows, "bucket int, toxic long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"))


def _counts(docs: DataFrame, suspect: np.ndarray) -> DataFrame:
    """(kind, bucket, raw, trusted): trigram counts (kind 0) of all documents and of those marked
    trusted; documents (kind 1) that have a word of the buckets ``suspect``; their number (kind 2)."""
    held = docs.sparkSession.sparkContext.broadcast(suspect)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        bucket, wanted, n, seen = WordBuckets(), np.zeros(WORD_BUCKETS, bool), np.zeros(WORD_BUCKETS, np.int64), 0
        wanted[held.value] = True
        for chunk in text_chunks(batches):
            texts, good = utf8(chunk.column("text")), chunk.column("__trusted").to_pylist()
            seen += len(texts)
            for t, g in zip(texts, good, strict=True):
                if len(t) > 4096:
                    c = np.bincount(buckets(t), minlength=BUCKETS)
                    raw += c
                    if g:
                        trusted += c
                else:
                    np.add.at(raw, b := buckets(t), 1)
                    if g:
                        np.add.at(trusted, b, 1)
                if len(held.value):
                    w = bucket.of(t.split())
                    n[np.unique(w[wanted[w]])] += 1
        for kind, a, b in ((0, raw, trusted), (1, n, n), (2, np.array([seen]), np.array([0]))):
            if len(some := np.flatnonzero(a)):
                yield pa.record_batch([pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), pa.array(a[some]), pa.array(b[some])], ["kind", "bucket", "raw", "trusted"])

    counts = docs.select("text", "__trusted").mapInArrow(rows, "kind int, bucket int, raw long, trusted long")
    return counts.groupBy("kind", "bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def _scored(docs: DataFrame, weights: np.ndarray, toxic: tuple[np.ndarray, np.ndarray], base: bool, carry: dict[str, str]) -> DataFrame:
    """The columns of SCHEMA and those of ``carry`` (name in docs: name returned)."""
    held = docs.sparkSession.sparkContext.broadcast((weights, *toxic))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = docs.select("doc_id").schema
    for x in SCHEMA.split(", ")[1:]:
        schema = schema.add(*x.split())
    for c, name in carry.items():
        schema = schema.add(name, docs.schema[c].dataType)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, places, gains = held.value
        bucket, gain = WordBuckets(), np.zeros(WORD_BUCKETS, np.float32)
        gain[places] = gains
        for chunk in text_chunks(batches):
            texts = utf8(chunk.column("text"))
            counts = [base_counts(t) if base else (0,) * 5 for t in texts]
            llr = [float(w[b].mean()) if len(b := buckets(t)) else 0.0 for t in texts]
            toxicity = [float(gain[bucket.of(x)].mean(dtype=np.float64)) if len(places) and (x := t.split()) else 0.0 for t in texts]
            found = [*(pa.array([c[i] for c in counts], pa.int64()) for i in range(5)), pa.array(llr, pa.float64()), pa.array(toxicity, pa.float64())]
            yield pa.record_batch([chunk.column("doc_id"), *found, *(chunk.column(c) for c in carry)], [*names, *carry.values()])

    return docs.select("doc_id", "text", *(c for c in carry if c not in ("doc_id", "text"))).mapInArrow(rows, schema)


def threshold(good: list[float], bad: list[float], dear: float = 1.0) -> float:
    """The cut between two labelled groups, ``good`` above, with the fewest errors, weighed by group;
    a good one counts ``dear`` times. The middle of the best gap. With a group missing: no cut."""
    if not good or not bad:
        return float("-inf")
    g, b = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([g, b]))
    wrong = dear * np.searchsorted(g, cuts, "left") / len(g) + (len(b) - np.searchsorted(b, cuts, "left")) / len(b)
    i = int(np.argmin(wrong))
    return float(cuts[i] if i == 0 else (cuts[i - 1] + cuts[i]) / 2)


def quality(docs: DataFrame, labels: DataFrame, *, seed: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Base counts, ``llr``, ``toxic_llr``, base_failed and kept for every row of ``docs`` (doc_id, text).

    The raw multinomial counts the hashed byte trigrams of all documents; the trusted one those
    of documents with label quality 1 and toxic 0 (LABELLED at most). llr is the mean over a
    document's trigrams of log(trusted share / raw share), shares smoothed by one half count.
    toxic_llr does the same for hashed words between documents labelled toxic and the corpus:
    the mean over a document's words of log((toxic documents with the word + PRIOR) / (those
    expected from all documents + PRIOR)) as far as it is above log 2, else 0.
    A document is kept if it does not fail the base rules (fewer than 50 words; over half of
    its words in repeated 3-word windows), its llr reaches the threshold that best parts
    labelled documents of quality 1 and 0, and its toxic_llr stays below that which best parts
    trusted from toxic ones, a lost trusted one counting four times. Everything is a function of the rows alone.

    Null text is empty; texts of under three bytes have llr 0; without labels of both kinds
    only the other rules reject. Repeated rows count each; labels that contradict each other
    count in both groups. An empty table gives no rows. ``carry`` names columns of ``docs`` to
    return as well, but for those named like a new column; others are ignored.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    new = {x.split()[0] for x in SCHEMA.split(", ")} | {"base_failed", "kept"}
    carried = [c for c in dict.fromkeys(carry) if c not in new]
    names = {"text" if c == "text" else f"__c{i}": c for i, c in enumerate(carried)}
    docs = docs.select(F.col("doc_id").cast("long"), "text", *(F.col(c).alias(n) for n, c in names.items() if n != "text"))
    pick = lambda rows: [r[0] for r in rows.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(LABELLED).collect()]
    picked = [pick(labels.where(x)) for x in ("quality = 1 and coalesce(toxic, 0) = 0", "quality = 0", "toxic = 1")]
    kinds = [k for k, x in enumerate(picked) for _ in x]
    marks = spark.createDataFrame(pa.table({"doc_id": pa.array([i for x in picked for i in x], pa.int64()), "__kind": pa.array(kinds, pa.int32())}))
    of_kind = lambda k: F.broadcast(marks.where(f"__kind = {k}").select("doc_id", F.lit(True).alias("__trusted")))
    toxic = np.zeros(WORD_BUCKETS, np.int64)
    for r in _toxic_words(docs.join(of_kind(2), "doc_id", "left_semi")).where(F.col("toxic") > PRIOR).toLocalIterator():  # WORD_BUCKETS rows at most
        toxic[r.bucket] = r.toxic
    suspect = np.flatnonzero(toxic)
    n, among, total = np.full((2, BUCKETS), 0.5), np.zeros(WORD_BUCKETS), 0
    for r in _counts(docs.join(of_kind(0), "doc_id", "left"), suspect).toLocalIterator():  # as many rows as there are buckets at most
        if r.kind == 0:
            n[:, r.bucket] += r.raw, r.trusted
        elif r.kind == 1:
            among[r.bucket] = r.raw
        else:
            total = r.raw
    weights = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    if not picked[0]:
        weights[:] = 0
    gains = np.log((toxic[suspect] + PRIOR) / (among[suspect] * len(picked[2]) / max(total, 1) + PRIOR)) - np.log(2)
    words = suspect[gains > 0], gains[gains > 0].astype(np.float32)
    sample = _scored(docs.join(F.broadcast(marks.select("doc_id").distinct()), "doc_id", "left_semi"), weights, words, False, {}).select("doc_id", "llr", "toxic_llr").join(F.broadcast(marks), "doc_id")
    scores = sample.select("__kind", "llr", "toxic_llr").collect()  # 3 * LABELLED rows at most, but for repeated doc_ids
    cut = threshold([r.llr for r in scores if r[0] == 0], [r.llr for r in scores if r[0] == 1])
    toxic_cut = threshold([-r.toxic_llr for r in scores if r[0] == 0], [-r.toxic_llr for r in scores if r[0] == 2], 4.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("llr") >= F.lit(cut)) & (-F.col("toxic_llr") >= F.lit(toxic_cut))
    return _scored(docs, weights, words, True, names).withColumn("base_failed", failed).withColumn("kept", kept)
