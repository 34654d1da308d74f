"""Two tokenizers side by side: windows between shared ends, and how often ids end together.

Whole texts are tokenised by both. A place where both have an end and both go on with a token that
begins with a space (or a line ends) is an anchor; what lies between two anchors is a window,
a pair of tuples of ids. Inside a window the alignment depends on its ids alone, so it is
remembered by them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import batch_rows, materialize, text_chunks
from granula.llm.tokens import BYTE_CHARACTERS, Encoder, pieces

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>"
#: A pair of ids as one number: a * PAIR + b.
PAIR = 1 << 24
_EMPTY = (), b"", 0, 0
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_BLOCK = {"block": pa.int64(), "doc_ids": _LONGS, "n_a": _LONGS, "n_b": _LONGS, "n_links": _LONGS, "sha": pa.list_(pa.string()), "n_pairs": _INTS, "places": _INTS, "numbers": _INTS, "pairs": _LONGS, "totals": _LONGS}


def _byte_level(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    back = {ord(c): b for b, c in BYTE_CHARACTERS.items()}
    out = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i) or ""
        out.append(bytes(back[ord(c)] for c in token) if all(ord(c) in back for c in token) else token.encode())
    return out


def _piece_bytes(model) -> list[bytes]:
    """The bytes of each id of a vocabulary of pieces."""
    return [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    ]


class Aligner:
    """Both tokenizers, with two memories: pieces of text to their ids, and windows of ids to their groups.

    Neither tokenizer joins over a place before a single space or at a line's end, so a text is
    tokenised piece by piece and each piece is a window between anchors: both tokenizers end
    there, which equal bytes verify, and go on with a token of a space. A window is a pair of tuples
    of ids (as bytes); its groups and links depend on these alone. Pieces are remembered in two
    generations of at most ``most`` each, as in :class:`granula.llm.tokens.Encoder`; windows go with
    the elder. What is new in a chunk is tokenised and aligned together.
    """

    def __init__(self, path_a: str, path_b: str, most: int = 300_000):
        import sentencepiece

        # Pieces are remembered here, so the encoder's own memory need only hold stems of words met lately.
        self.encode_a = Encoder(path_a, False, most=100_000, plain=True)
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = _byte_level(self.encode_a.tokenizer), _piece_bytes(self.model_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        each = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.told = {c: np.array([f"{i}{c}" for i in each], object) for c in ",|;"}
        self.digits = np.array([len(str(i)) + 1 for i in each], np.int64)
        self.most = most
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.windows: dict[tuple[bytes, bytes], tuple[str, bytes, int, int]] = {}

    def _align(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Groups and links of many windows at once: their ids are laid end to end, so that shared
        ends of bytes are found by marks, and no group reaches over a window's end."""
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in zip(*keys, strict=True))
        n_a, n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in zip(*keys, strict=True))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        marked = np.zeros(int(ends_a[-1]) + 1, bool)
        marked[ends_a] = True
        last_b = marked[ends_b]
        marked[:] = False
        marked[ends_b] = True
        last_a = marked[ends_a]
        i, j = np.flatnonzero(last_a), np.flatnonzero(last_b)
        pairs = (a[i] * PAIR + b[j]).tobytes()
        # A group is told as its A ids, then its B ids: places of all ids in that order.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        at_a = np.arange(len(a)) + np.r_[0, j + 1][group_a]
        at_b = np.arange(len(b)) + (i + 1)[group_b]
        words = np.empty(len(a) + len(b), object)
        words[at_a] = np.where(last_a, self.told["|"][a], self.told[","][a])
        words[at_b] = np.where(last_b, self.told[";"][b], self.told[","][b])
        told = "".join(words.tolist())
        length = np.empty(len(words), np.int64)
        length[at_a], length[at_b] = self.digits[a], self.digits[b]
        cut = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(n_a + n_b)]].tolist()
        groups = (8 * np.r_[0, np.cumsum(last_a)][np.r_[0, np.cumsum(n_a)]]).tolist()
        for k, (key, x, y) in enumerate(zip(keys, n_a.tolist(), n_b.tolist(), strict=True)):
            self.windows[key] = told[cut[k] : cut[k + 1] - 1], pairs[groups[k] : groups[k + 1]], x, y

    def _keeps(self, table: list[bytes], ids: list[bytes], new: list[bytes]) -> list[bool]:
        """Whether the bytes of each piece's ids are the piece; all are compared at once first."""
        text = table.__getitem__
        if b"".join(map(text, memoryview(b"".join(ids)).cast("I"))) == b"".join(new) and all(ids):
            return [True] * len(new)
        return [b"".join(map(text, memoryview(x).cast("I"))) == p for x, p in zip(ids, new, strict=True)]

    def _learn(self, pieces: set[str]) -> None:
        """See to it that the windows of all pieces are known; a piece of which a tokenizer loses a byte gets None."""
        wanted = pieces.difference(self.young)
        if len(self.young) + len(wanted) > self.most:
            self.old, self.young, self.windows, wanted = self.young, {}, {}, pieces
        young, old, new = self.young, self.old, []
        for p in wanted:
            if p in old:
                young[p] = old[p]
            else:
                new.append(p)
        if not new:
            return
        ids_a = self.encode_a.of_pieces(new)
        # The model adds a space; where the piece has none, a line's end keeps the two apart.
        ids_b = self.model_b.encode([p[1:] if p[0] == " " else "\n" + p for p in new], num_threads=1)
        for k, p in enumerate(new):
            if p[0] != " ":
                if b"".join(map(self.bytes_b.__getitem__, ids_b[k][:2])) != b" \n":
                    raise ValueError("the second tokenizer joins over a line's end")
                ids_b[k] = ids_b[k][2:]
        ids_b = [array("I", y).tobytes() for y in ids_b]
        raw = [p.encode() for p in new]
        whole = [x and y for x, y in zip(self._keeps(self.bytes_a, ids_a, raw), self._keeps(self.bytes_b, ids_b, raw), strict=True)]
        keys = [key if good else None for key, good in zip(zip(ids_a, ids_b, strict=True), whole, strict=True)]
        fresh = [k for k in dict.fromkeys(keys) if k is not None and k not in self.windows]
        for k in range(0, len(fresh), 50_000):
            self._align(fresh[k : k + 50_000])
        windows = self.windows.get
        for p, key in zip(new, keys, strict=True):
            young[p] = windows(key)

    def __call__(self, texts: list[str]) -> list[tuple[tuple[str, ...], bytes, int, int] | None]:
        """Of each text the groups of its windows, the linked pairs, and the numbers of ids of both
        tokenizers; None for an empty text and one of which they don't keep all bytes."""
        parts = [[p for p in pieces(" " + x) if p] if x else [] for x in texts]
        self._learn(set().union(*parts))
        out, window = [], self.young.__getitem__
        for p in parts:
            found = list(map(window, p))
            if found and None not in found:
                told, pairs, n_a, n_b = zip(*found, strict=True)
                out.append((told, b"".join(pairs), sum(n_a), sum(n_b)))
            else:
                out.append(None)
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One a Python worker; its memory lasts over tasks."""
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of each text: numbers of ids, groups and links, the groups as text, and each group's linked pair.

    ``path_a`` is a byte-level file of the tokenizers library, which reads a space and the text;
    ``path_b`` a sentencepiece model, which adds that space. Special tokens' strings are plain
    text. A group ends where ids of both end at the same byte; those two ids are linked.
    ``groups`` reads ``a1,a2|b1;a3|b2,b3``. A link is a * PAIR + b. Nothing is shuffled.

    Null and empty texts, and those of which a tokenizer loses a byte, have no tokens: zeros, an
    empty string and no links. Null doc_ids stay null, repeated rows are aligned each, an empty
    table gives no rows, and other columns of ``docs`` are ignored. A very long text is one
    call of either tokenizer, whole.
    """
    batch_rows(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for chunk in text_chunks(batches):
            out = [(n_a, n_b, ";".join(told), np.frombuffer(pairs, np.int64)) for told, pairs, n_a, n_b in (found or _EMPTY for found in both([x or "" for x in chunk.column("text").to_pylist()]))]
            n_a, n_b, groups, links = zip(*out, strict=True)
            n = pa.array([len(x) for x in links], pa.int64())
            yield pa.record_batch([chunk.column("doc_id"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), n, n, pa.array(groups, pa.string()), pa.array(links, pa.list_(pa.int64()))], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, SCHEMA)


def _blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    """The alignments of many documents as one row: a block's distinct pairs with their numbers,
    and for each document the places of its pairs among them, with its own numbers."""
    batch_rows(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block, held, size = aligner(path_a, path_b), TaskContext.get().partitionId() << 33, [], 0

        def row() -> pa.RecordBatch:
            nonlocal block, size
            ids, n_a, n_b, n, sha, pairs, numbers = zip(*held, strict=True)
            pair, place = np.unique(np.concatenate(pairs), return_inverse=True)
            number = np.concatenate(numbers)
            total = np.bincount(place, number, len(pair)).astype(np.int64)
            cells = [block, ids, n_a, n_b, n, sha, [len(x) for x in pairs], place.astype(np.int32), number.astype(np.int32), pair, total]
            held.clear()
            block, size = block + 1, 0
            return pa.record_batch([pa.array([cell], kind) for cell, kind in zip(cells, _BLOCK.values(), strict=True)], list(_BLOCK))

        for chunk in text_chunks(batches):
            texts = [x or "" for x in chunk.column("text").to_pylist()]
            for doc, text, found in zip(chunk.column("doc_id").to_pylist(), texts, both(texts), strict=True):
                told, pairs, n_a, n_b = found or _EMPTY
                links = np.frombuffer(pairs, np.int64)
                held.append((doc, n_a, n_b, len(links), hashlib.sha256(";".join(told).encode()).hexdigest() if told else "", *np.unique(links, return_counts=True)))
                size += len(text)
                if size >= block_bytes:
                    yield row()
        if held:
            yield row()

    schema = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, sha array<string>, n_pairs array<int>, places array<int>, numbers array<int>, pairs array<long>, totals array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document from blocks with the corpus-wide counts of their pairs."""
    for batch in batches:
        for k in range(batch.num_rows):
            cell = lambda c, k=k, batch=batch: batch.column(c)[k].values
            counts, best = (cell(c).to_numpy(zero_copy_only=False) if batch.column(c)[k].is_valid else np.empty(0, np.int64) for c in ("counts", "best"))
            place, number = (cell(c).to_numpy() for c in ("places", "numbers"))
            doc = np.repeat(np.arange(len(cell("doc_ids"))), cell("n_pairs").to_numpy())
            n_best, total = np.zeros(len(cell("doc_ids")), np.int64), np.zeros(len(cell("doc_ids")), np.int64)
            np.add.at(n_best, doc, number * best[place].astype(np.int64))
            np.add.at(total, doc, number * counts[place])
            n = cell("n_links")
            yield pa.record_batch([cell("doc_ids"), cell("n_a"), cell("n_b"), n, n, pa.array(n_best), pa.array(total), cell("sha")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def link_counts(docs: DataFrame, path_a: str, path_b: str, *, block_bytes: int = 8 << 20) -> DataFrame:
    """How far the links of each text agree with the corpus: counts of id pairs over all documents.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of
    its B id, ties included), count_sum (the corpus-wide counts of its links' pairs, summed) and
    groups_sha256. Texts are tokenised once: a task gathers its documents into blocks of about
    ``block_bytes`` of text, written to the shared folder with the distinct pairs of each. Pairs
    are counted per block, then corpus-wide; the counts go back once a block and not once a
    document. A pair found everywhere has a row a block in that join, which adaptive execution
    splits. Only the best count of each B id is broadcast: as many rows as B has ids.

    Nulls, blanks, repeats and clashes are as in :func:`align`; an empty table gives no rows.
    """
    blocks = materialize(_blocks(docs, path_a, path_b, block_bytes), "blocks")
    each = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("n"))
    counts = materialize(each.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b = F.pmod("pair", F.lit(PAIR))
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    judged = counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    known = each.drop("n").join(judged, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("known"))
    whole = blocks.drop("pairs", "totals").join(known, "block", "left").select("*", F.col("known.count").alias("counts"), F.col("known.best").alias("best")).drop("known", "block")
    return whole.mapInArrow(_judge, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
