"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.llm.common import batch_rows, make_dir, shared_dir, text_chunks, utf8

#: Fixed value: the profile that marks a revisit by equal payload (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, path string, offset long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One gzip member with a response record, or a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', uri)}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def open_fs(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives under ``path``,
    a URI in a folder that all executors share. Returns the files written (path, records).

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest
    page_id is a response and the others revisit it. Payload digests are pre-aggregated before
    they are shuffled, and pages meet their digest's keeper in a join whose large partitions
    Spark can split. A task writes its archive under a name of its own and renames it, so a
    task that is run again replaces its file. Null html is empty, null urls are empty; a null
    page_id is never a keeper. Repeated page_ids with equal payloads are all responses of it.
    """
    batch_rows(pages.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "html", 8 << 20):
            payloads = utf8(b.column("html"))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(payloads, pa.binary()), pa.array([base32_sha1(p) for p in payloads])], ["page_id", "url", "payload", "digest"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(digests, "page_id long, url string, payload binary, digest string")
    keepers = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(keepers, "digest", "left")
    spark_path = path

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(spark_path)
        task = TaskContext.get()
        fs.create_dir(base, recursive=True)
        name, part = f"{base}/part-{task.partitionId():06d}.warc.gz", f"{base}/.part-{task.partitionId()}-{task.taskAttemptId()}"
        n, out = 0, None
        for b in batches:
            for page, url, payload, digest, keeper in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "keeper")), strict=True):
                out = out or fs.open_output_stream(part)
                of = f"urn:page:{keeper}" if keeper is not None and keeper != page else None
                out.write(record(f"urn:page:{'' if page is None else page}", url or "", payload, digest, of, date))
                n += 1
        if out:
            out.close()
            fs.move(part, name)
            yield pa.record_batch([pa.array([f"{spark_path}/{name.rsplit('/', 1)[1]}"]), pa.array([n])], ["path", "records"])

    files = rows.select("page_id", "url", "payload", "digest", "keeper").mapInArrow(write_part, "path string, records long")
    make_dir(pages.sparkSession, path)
    files.write.parquet(f"{path}-files")
    return pages.sparkSession.read.parquet(f"{path}-files")


def _blocks(source, at: int, size: int = 1 << 20) -> Iterator[bytes]:
    source.seek(at)
    while block := source.read(size):
        yield block


def _member(source, at: int) -> tuple[bytes, int] | None:
    """The bytes and the end of the gzip member that starts at ``at``, if a WARC record does."""
    z, out, used = zlib.decompressobj(31), [], at
    try:
        for block in _blocks(source, at, 1 << 16):
            out.append(z.decompress(block))
            used += len(block) - len(z.unused_data)
            if len(out) == 1 and not out[0].startswith(b"WARC/1."[: len(out[0])]):
                return None
            if z.eof:
                data = b"".join(out)
                return (data, used) if data.startswith(b"WARC/1.") else None
    except zlib.error:
        return None
    return None


def members(source, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Records (offset, bytes) whose gzip members start in [start, end) of a file of ``size`` bytes.

    The first is found by its magic bytes: a candidate counts if its header decodes as a WARC
    record, its member ends with the right checksum, and a member or the file's end follows.
    From there members follow each other; garbage between them is scanned again.
    """
    at, sure = start, start == 0
    while at < end:
        if not sure:
            tail, base, found = b"", at, -1
            for block in _blocks(source, at):
                data = tail + block
                if (i := data.find(MAGIC)) >= 0:
                    found = base + i
                    break
                tail = data[-2:]
                base += len(data) - len(tail)
                if base >= end:
                    break
            if found < 0 or found >= end:
                return
            at = found
        got = _member(source, at)
        if got:
            source.seek(got[1])
            if got[1] == size or source.read(3) == MAGIC or sure:
                yield at, got[0]
                at, sure = got[1], True
                continue
        at, sure = at + 1, False


def parse(data: bytes) -> tuple:
    """record_id, type, uri, refers_to, payload length, digest, payload of a record's bytes."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = block[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    bare = lambda x: x and x.strip("<>")
    kind = fields.get("warc-type")
    if kind == "response":
        return bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), None, len(payload), base32_sha1(payload), payload
    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = fields.get("warc-payload-digest", "")
    return bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), int(said[1]) if said else None, digest.removeprefix("sha1:") or None, None


def read(spark: SparkSession, path: str, *, split_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives ``path``/*.warc.gz, read by byte ranges of ``split_bytes``.

    A task opens its range, finds the first member that starts inside, and owns the records
    that start there, though the last may end beyond. Lengths and digests of responses are of
    the payload that was read, those of revisits are as they state them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    step = F.lit(split_bytes)
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step.cast("long"))).alias("start"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("path"), F.col("start"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "length", "start")), strict=True):
                fs, file = open_fs(name)
                out, held = [], 0
                with fs.open_input_file(file) as source:
                    for offset, data in members(source, start, start + split_bytes, size):
                        out.append((*parse(data), name, offset))
                        held += len(data)
                        if held > 4 << 20:
                            yield batch(out)
                            out, held = [], 0
                if out:
                    yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
        names = [x.split()[0] for x in RECORD.split(", ")]
        order = (0, 1, 2, 3, 4, 5, 6, 7, 8)
        return pa.record_batch([pa.array([o[i] for o in out], kinds[i]) for i in order], names)

    return ranges.mapInArrow(rows, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the archives back: what each record says of its page."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(pages, path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")
    return read(spark, path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
