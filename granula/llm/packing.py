"""Packing by the sum-of-squares rule, online, one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import batch_rows, text_chunks
from granula.llm.tokens import Encoder, encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Open windows by fill level; an item goes where the squared counts of levels grow least.

    ``levels[f]`` is the number of partially filled windows with fill f. Putting an item of
    size s into a window of fill f changes the sum of squares by 2 * (levels[f + s] - levels[f])
    + 2, by 1 - 2 * levels[f] if that fills it, and by 2 * levels[s] + 1 in a new window. Ties go to
    the fuller window.
    """

    def __init__(self, window: int):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def put(self, item: tuple, size: int) -> list | None:
        """Place an item; the window it is in, if that is now full."""
        n, top = self.levels, self.window - size
        cost = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2
        cost[top] = 1 - 2 * n[top]
        cost[0] = 2 * n[size] + 1 if size < self.window else 0
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        fill = top - int(np.argmin(cost[::-1]))
        if fill:
            held = self.open[fill].pop()
            n[fill] -= 1
        else:
            held = []
        held.append(item)
        if fill + size == self.window:
            return held
        self.open[fill + size].append(held)
        n[fill + size] += 1
        return None

    def drain(self) -> Iterator[tuple]:
        """The items of all open windows, fullest first."""
        for fill in range(self.window, 0, -1):
            for held in self.open[fill]:
                yield from held
            self.open[fill] = []
        self.levels[:] = 0


def _cut_rest(items: Iterator[tuple], window: int) -> Iterator[list]:
    """What is left at the end, poured into full windows; the last is cut into powers of two.

    An item is (doc_id, start, doc_tokens, ids).
    """
    held, room, left = [], window, [list(x) for x in items]
    total = sum(len(x[3]) for x in left) // 4
    sizes = [window] * (total // window)
    sizes += [1 << k for k in range(window.bit_length() - 1, -1, -1) if (total % window) >> k & 1]
    if not sizes:
        return
    room, at = sizes[0], 0
    for doc, start, tokens, ids in left:
        while ids:
            some = ids[: 4 * room]
            held.append((doc, start, tokens, some))
            ids, start, room = ids[len(some) :], start + len(some) // 4, room - len(some) // 4
            if not room:
                yield held
                held, at = [], at + 1
                room = sizes[at] if at < len(sizes) else 0


def pack(docs: DataFrame, tokenizer: str, *, window: int = 2048, end_id: int = 1, remembered: int = 500_000, lasting: bool = True) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of ``window`` (a power of two) tokens.

    Returns a row for each piece: doc_id, start (its document's ids before it), length,
    doc_tokens (with the end id), sequence_id, offset (in the sequence) and ids (little-endian
    unsigned 32-bit). Each task packs the documents of its input split as they come: whole
    windows are cut from long documents, the remainder is placed by the sum-of-squares rule,
    and windows still open at the end of the split are poured together, the last remainder
    into sequences whose lengths are powers of two. So no sequence needs padding. A task holds
    its open windows only. sequence_id has the split's number in its upper bits; a task that
    is run again gives the same rows.

    A Python worker remembers the ids of up to twice ``remembered`` pieces of text: more of them
    take memory, fewer take time. What it remembers is there for its next task; unless ``lasting``, it is
    given back at a task's end, for workers that go on to other work.

    Null and empty texts are documents of the end id alone; null doc_ids stay null; repeated
    rows are packed each. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    batch_rows(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False, most=remembered)
        try:
            yield from packed(batches, encode)
        finally:
            if not lasting:
                encode.forget()

    def packed(batches: Iterator[pa.RecordBatch], encode: Encoder) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(window)
        first, count = TaskContext.get().partitionId() << 33, 0
        out: list[tuple] = []

        def close(held: list) -> None:
            nonlocal count
            offset = 0
            for doc, start, tokens, ids in held:
                n = len(ids) // 4
                out.append((doc, start, n, tokens, first + count, offset, ids))
                offset += n
            count += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for chunk in text_chunks(batches):
            texts = [x or "" for x in chunk.column("text").to_pylist()]
            for doc, ids in zip(chunk.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                tokens = len(ids) // 4
                whole = tokens - tokens % window
                for start in range(0, whole, window):
                    close([(doc, start, tokens, ids[4 * start : 4 * (start + window)])])
                if whole < tokens and (full := packer.put((doc, whole, tokens, ids[4 * whole :]), tokens - whole)):
                    close(full)
            if len(out) >= 512:
                yield batch()
        for held in _cut_rest(packer.drain(), window):
            close(held)
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
