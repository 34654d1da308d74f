"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granula.llm.common import batch_rows, text_chunks
from granula.llm.tokens import encoder

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, tokenizer: str, *, end_id: int = 1, lossy_space: bool = True, files: int | None = None) -> DataFrame:
    """Rows (doc_id, shard, shard_start, n_tokens, ids) in ascending doc_id order, a shard a file.

    Texts are dealt out by ranges of doc_id before they are encoded, so ids are never shuffled.
    ``shard_start`` counts the ids before the document in its shard. Null text is empty, null
    doc_ids come first; repeated doc_ids are ordered by text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, shard, start = encoder(tokenizer, lossy_space), TaskContext.get().partitionId(), 0
        for chunk in text_chunks(batches):
            ids = [x + end for x in ids_of([x or "" for x in chunk.column("text").to_pylist()])]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(counts)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
            yield pa.record_batch([
                chunk.column("doc_id"), pa.array(np.full(len(ids), shard, np.int32)), pa.array(start + ends - counts), pa.array(counts), lists,
            ], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])
            start += int(ends[-1])

    return dealt.mapInArrow(rows, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, *, stripe_bytes: int = 64 << 20, row_stride: int = 1000, codec: str = "snappy", **options) -> None:
    """Encode ``docs`` and write them to ``path`` as ORC.

    Stripes of about ``stripe_bytes`` can be read in parallel; an index entry each
    ``row_stride`` rows and a Bloom filter on doc_id let a look-up skip the others. Run-length
    encoded ids leave little to ``codec``, so a cheap one is the default.
    """
    (
        encode(docs, tokenizer, **options).write
        .option("orc.create.index", "true").option("orc.row.index.stride", row_stride).option("orc.stripe.size", stripe_bytes)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("compression", codec).orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of ``path`` with ``start``: how many ids all documents before have.

    Only the sums of the shards meet in one task: as many rows as there are files.
    """
    table = spark.read.schema(SCHEMA).orc(path)
    sums = table.groupBy("shard").agg(F.sum("n_tokens").alias("__n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return table.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("__before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def digest(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            counts = pa.array(np.diff(ends).astype(np.int64))
            yield pa.record_batch([b.column("doc_id"), b.column("start"), counts, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("doc_id", "start", "ids").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
