"""Substring deduplication: repeated word windows found by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import WordHashes, batch_rows, gram_hashes, materialize, mix, text_chunks, utf8

#: Words of an anchor phrase.
ANCHOR = 5
#: Fragments that one automaton is compiled from at most; a task builds one after the other.
SHARD = 4096
#: Words of one document that anchors are chosen from at a time.
BLOCK = 1 << 22


@dataclass
class Fragments:
    """Runs of windows with one anchor, over the texts of a chunk; word places count within a text."""

    text: np.ndarray  # number of the text in the chunk
    anchor: np.ndarray  # hash of the anchor
    at: np.ndarray  # its place
    first: np.ndarray  # first and last start of a window
    last: np.ndarray


def fragments(hashes: np.ndarray, counts: list[int], window: int) -> Fragments:
    """The fragments of texts with ``counts`` words, whose hashes stand one text after the other.

    The anchor of a window is its leftmost ANCHOR-word phrase of least hash, so equal windows have equal
    anchors at equal places wherever they stand.
    """
    parts = []
    span, n = window - ANCHOR + 1, len(hashes) - window + 1
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.empty(0, np.int64)
    of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    for base in range(0, max(n, 0), BLOCK):
        stop = min(base + BLOCK, n)
        g = gram_hashes(hashes[base : stop + window - 1], ANCHOR)
        m = (g & ~np.uint64((1 << 24) - 1)) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            m = np.minimum(m[:-step], m[step:])
            width += step
        start = np.flatnonzero(of[base:stop] == of[base + window - 1 : stop + window - 1])  # windows within a text
        if not len(start):
            continue
        at = (m[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(at) - 1]])
        text = of[base + start[first]]
        own = begin[text] - base
        parts.append((text, g[at[first]].view(np.int64), at[first] - own, start[first] - own, start[last] - own))
    if not parts:
        e = np.empty(0, np.int64)
        return Fragments(e.astype(np.int32), e, e, e, e)
    return Fragments(*(np.concatenate(p) for p in zip(*parts, strict=True)))


def _recurring(docs: DataFrame, window: int, remembered: int = 300_000) -> DataFrame:
    """(k, at): fragments, by the position of their anchor, whose anchor recurs in the corpus.

    A task sends two places of an anchor by the anchor's hash; of those beyond it knows that
    they recur and sends them by their document, so a very frequent anchor meets itself twice a
    task. Behind the shuffle anchors come sorted, and those with a neighbour recur.
    """
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}
        for chunk in text_chunks(batches):
            words = [t.split() for t in utf8(chunk.column("text"))]
            f = fragments(hashes.of([w for x in words for w in x]), [len(x) for x in words], window)
            k = chunk.column("k").to_numpy()[f.text]
            if len(seen) > remembered:
                seen = {}
            many = np.zeros(len(k), bool)
            for i, x in enumerate(f.anchor.tolist()):
                seen[x] = n = seen.get(x, 0) + 1
                many[i] = n > 2
            yield pa.record_batch([pa.array(np.where(many, k, f.anchor)), pa.array(k), pa.array(f.at.astype(np.int32)), pa.array(many)], ["h", "k", "at", "many"])

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, (h, k, at, sent)
        for b in batches:
            many = b.column("many").to_numpy(zero_copy_only=False)
            h, k, at = (b.column(c).to_numpy() for c in ("h", "k", "at"))
            out_k, out_at = [k[many]], [at[many]]
            h, k, at = h[~many], k[~many], at[~many]
            if len(h):
                same = h[1:] == h[:-1]
                sent = np.concatenate([[last is not None and last[0] == h[0]], same])
                if sent[0] and not last[3]:
                    out_k.append(np.array([last[1]]))
                    out_at.append(np.array([last[2]], at.dtype))
                sent[:-1] |= same
                out_k.append(k[sent])
                out_at.append(at[sent])
                last = (h[-1], k[-1], at[-1], sent[-1])
            yield pa.record_batch([pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_at))], ["k", "at"])

    sent = docs.select("k", "text").mapInArrow(places, "h long, k long, at int, many boolean")
    return sent.repartition("h").sortWithinPartitions("many", "h").mapInArrow(sorted_out, "k long, at int")


#: An odd factor of rolling hashes and its inverse modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(x: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))


def run_hashes(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of words [first, stop), alike wherever it stands."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_FACTOR, len(hashes))[:-1])])
    return mix((total[stop] - total[first]) * _powers(_INVERSE, len(hashes))[first])


def _candidates(docs: DataFrame, window: int, remembered: int = 200_000) -> DataFrame:
    """Fragments with a recurring anchor (h, id, k, start, last, words).

    A fragment that its task has just seen at an earlier place, by two 64-bit hashes and its length,
    is settled: it goes by its document and without words, in one row with those that follow on it,
    so very frequent passages meet themselves about once a task.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}
        for chunk in text_chunks(batches):
            words = [t.split() for t in utf8(chunk.column("text"))]
            counts = np.array([len(x) for x in words], np.int64)
            begin = np.cumsum(counts) - counts
            h = hashes.of([w for x in words for w in x])
            f = fragments(h, counts.tolist(), window)
            places = chunk.column("places")
            wanted = np.zeros(len(h) + 1, bool)
            wanted[places.values.slice(places.offsets[0].as_py(), places.offsets[-1].as_py() - places.offsets[0].as_py()).to_numpy() + np.repeat(begin, np.diff(places.offsets.to_numpy()))] = True
            hit = np.flatnonzero(wanted[f.at + begin[f.text]])
            if not len(hit):
                continue
            text, first, last, anchor = f.text[hit], f.first[hit], f.last[hit], f.anchor[hit]
            whole = run_hashes(h, first + begin[text], last + begin[text] + window)
            ids, ks = chunk.column("id").to_numpy()[text], chunk.column("k").to_numpy()[text]
            settled = np.zeros(len(hit), bool)
            for i, row in enumerate(zip(whole.tolist(), anchor.tolist(), ids.tolist(), first.tolist(), (last - first).tolist(), strict=True)):
                run, a, doc, s, size = row
                if (known := seen.get(run)) is not None and known[2:] == (a, size) and known[:2] < (doc, s):
                    settled[i] = True
                    continue
                if len(seen) >= remembered:
                    seen.clear()
                seen[run] = (doc, s, a, size)
            # Settled runs that follow on each other become one.
            done = np.flatnonzero(settled)
            if len(done):
                new = np.ones(len(done), bool)
                new[1:] = (text[done][1:] != text[done][:-1]) | (first[done][1:] > last[done][:-1] + 1)
                head, tail = done[new], done[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(done) - 1]])]
                yield table(ks[head], ids[head], ks[head], first[head], last[tail], [None] * len(head))
            rest = np.flatnonzero(~settled)
            pieces = [b" ".join(words[t][s : e + window]) for t, s, e in zip(text[rest].tolist(), first[rest].tolist(), last[rest].tolist(), strict=True)]
            yield table(anchor[rest], ids[rest], ks[rest], first[rest], last[rest], pieces)

    def table(h, doc, k, first, last, words) -> pa.RecordBatch:
        return pa.record_batch([*(pa.array(x, pa.int64()) for x in (h, doc, k, first, last)), pa.array(words, pa.binary())], ["h", "id", "k", "start", "last", "words"])

    return docs.select("id", "k", "text", "places").mapInArrow(rows, "h long, id long, k long, start long, last long, words binary")


class Shard:
    """An automaton over the recurring windows of a run of fragments, which come in order of place.

    Window hashes say which passages recur; these are compiled by their words, and the fragments are
    streamed through the automaton, whose first hit of a passage is the one to keep. Hits at one
    place, in rows that share a doc_id, are one.
    """

    def __init__(self, window: int):
        self.window, self.rows = window, []
        self.number: dict[bytes, int] = {}
        self.known: dict[bytes, tuple[int, int]] = {}  # whole fragments and where they stand first
        self.before: dict[tuple, tuple[int, int]] = {}  # windows of an anchor that goes on

    def add(self, doc: int, k: int, start: int, last: int, words: bytes) -> tuple[int, int, int] | None:
        """Take a fragment; the span of all its windows if it stands earlier as a whole."""
        if self.known.setdefault(words, (doc, start)) != (doc, start):
            return k, start, last
        number = self.number
        self.rows.append((doc, k, start, [number.setdefault(w, len(number) + 1) for w in words.split()]))
        return None

    def spans(self, goes_on: bool) -> Iterator[tuple[int, int, int]]:
        """(k, first, last) of the window starts that stand earlier too; the rows are then forgotten."""
        w, rows = self.window, self.rows
        if rows:
            ids = np.concatenate([np.array(r[3], np.uint64) for r in rows])
            sizes = np.array([len(r[3]) for r in rows])
            begin = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(rows)), sizes - w + 1)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes - w + 1) - (sizes - w + 1), sizes - w + 1)
            start = begin[row] + offset
            _, kind, count = np.unique(run_hashes(mix(ids), start, start + w), return_inverse=True, return_counts=True)
            passages: dict[tuple, int] = {}
            for i in np.flatnonzero(count[kind] > 1).tolist():
                passages.setdefault(tuple(rows[row[i]][3][offset[i] : offset[i] + w]), len(passages))
            stood: list[tuple[int, int] | None] = [None] * len(passages)
            for p in (tuple(x[o : o + w]) for *_, x in rows for o in range(len(x) - w + 1)) if self.before else ():
                if (place := self.before.get(p)) is not None:
                    if (n := passages.setdefault(p, len(passages))) == len(stood):
                        stood.append(place)
                    stood[n] = place
            if passages:
                automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
                for passage, n in passages.items():
                    automaton.add_word(passage, n)
                automaton.make_automaton()
                for doc, k, begins, x in rows:
                    lo = hi = -2
                    for end, n in automaton.iter(tuple(x)):
                        s = begins + end - w + 1
                        if stood[n] is None:
                            stood[n] = (doc, s)
                        if stood[n] == (doc, s):
                            continue
                        if s != hi + 1:
                            if lo >= 0:
                                yield k, lo, hi
                            lo = s
                        hi = s
                    if lo >= 0:
                        yield k, lo, hi
            if goes_on:
                for doc, _, begins, x in rows:
                    for o in range(len(x) - w + 1):
                        self.before.setdefault(tuple(x[o : o + w]), (doc, begins + o))
        self.rows = []
        if not goes_on:
            self.number, self.known, self.before = {}, {}, {}


def _repeats(candidates: DataFrame, window: int) -> DataFrame:
    """(k, first, last): runs of windows that stand earlier. Fragments come by anchor and place."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, out = Shard(window), None, []
        for b in batches:
            for h, doc, k, start, last, words in zip(*(b.column(c).to_pylist() for c in ("h", "id", "k", "start", "last", "words")), strict=True):
                if words is None:
                    out.append((k, start, last))
                    continue
                if len(shard.rows) >= SHARD:
                    out.extend(shard.spans(h == now))
                now = h
                if (span := shard.add(doc, k, start, last, words)) is not None:
                    out.append(span)
            if len(out) > 4096:
                yield table(out)
                out = []
        out.extend(shard.spans(False))
        if out:
            yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["k", "first", "last"])

    dealt = candidates.repartition("h").sortWithinPartitions("h", "id", "start")
    return dealt.select("h", "id", "k", "start", "last", "words").mapInArrow(rows, "k long, first long, last long")


def remove_repeats(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text for every row of ``docs`` (doc_id, text).

    A word is removed if a window of ``window`` words of its document covers it whose words also
    start earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on
    the input. kept_text has the kept words joined by single spaces.

    1. Texts that stand in a smaller doc_id too are copies; all their windows are removed.
    2. Every window has an anchor phrase; an anchor that occurs once in the corpus rules out its
       windows. Hashes and places are shuffled, very frequent anchors settled before.
    3. Documents are scanned for fragments around recurring anchors, which go to the shard
       that owns the anchor. There recurring windows are found by their hashes, compiled by their
       words into automata of bounded size, and every fragment is streamed through to locate all
       occurrences. Fragments that recur as a whole are settled by equality.
    4. Spans go back to their documents.

    Null and blank texts have no words. Null doc_ids come after all others. Rows that repeat
    both doc_id and text are one document, returned each time; rows that share only the doc_id
    are ordered by place and do not lose what both have at the same place. An empty table gives no rows.
    """
    batch_rows(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    keyed = keyed.select("k", "doc_id", "text")
    place = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id")
    named = keyed.select("k", place, F.md5(F.col("text").cast("binary")).alias("same")).where("same is not null")
    # Written, so that the join sees the size of both sides and can split a text with very many copies.
    firsts = materialize(named.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "firsts")
    copies = materialize(named.join(firsts, "same").where("id > first").select("k").distinct(), "copies")
    places = _recurring(keyed, window).join(copies, "k", "left_anti").groupBy("k").agg(F.collect_list("at").alias("places"))
    whole = copies.select("k", F.lit(0).cast("long").alias("first"), F.lit(1 << 60).cast("long").alias("last"))
    spans = _repeats(_candidates(keyed.join(places, "k").select("k", place, "text", "places"), window), window).unionByName(whole)
    spans = spans.groupBy("k").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            out = []
            for text, found in zip(utf8(chunk.column("text")), chunk.column("spans").to_pylist(), strict=True):
                words = text.split()
                if found and len(words) >= window:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["first"] for s in found], 1)
                    np.add.at(edge, [min(s["last"] + window, len(words)) for s in found], -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    kept = [words[i] for i in np.flatnonzero(keep)]
                else:
                    kept = words
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.record_batch([chunk.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_text"])

    return keyed.join(spans, "k", "left").select("doc_id", "text", "spans").mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def digest_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
