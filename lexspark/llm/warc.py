"""WARC archives as a chunked record table.

A payload travels as rows (record, chunk number, bytes) of at most
``chunk_bytes``: in the archive an oversized record is a first segment and
continuation records (WARC segmentation: ``WARC-Segment-Number``,
``WARC-Segment-Origin-ID``, ``WARC-Segment-Total-Length``).  Digests are
carried from chunk to chunk; no step joins the chunks of a record.

Archives are written by Spark's text writer with the record end (two CR LF) as
line separator, so they may lie in any file system that Spark reaches, and a
lost task is repeated like any other.  ``read_chunks`` parses archive files by
their Content-Length, one task a file (the writer bounds the records a file),
and ``read_records`` folds the chunk table to one row a record.

Of records with equal payloads (same SHA-256) of ``revisit_from`` bytes or
more, that with the smallest key is the response and the others are revisits
that refer to it.  A null payload is empty.  A repeated row (same key and
payload) is a record of its own of the same type; rows with a null key are
written, come last in the order of keys and refer to the smallest key that is
not null.  Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import same_key, saved, shared_path

CHUNK_BYTES = 1 << 16
REVISIT_FROM = 100
RECORDS_PER_FILE = 4_000  # with the chunk size, the bound of an archive file
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format

CHUNKS = ("record string, segment long, chunk long, key string, type string, refers_to string, "
          "declared_bytes long, declared_digest string, size long, sha256 string, payload binary")
RECORDS = "key string, type string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def choose(found: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(key, bytes, digest, type, refers_to): one row per distinct key and payload of ``found``."""
    large = F.col("bytes") >= revisit_from
    first = found.where(large).groupBy("digest").agg(F.min("key").alias("first"))
    rows = found.distinct().join(first, "digest", "left")
    again = large & F.col("first").isNotNull() & ~same_key(F.col("key"), F.col("first"))
    return rows.select("key", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("type"),
                       F.when(again, F.col("first")).alias("refers_to"))


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + END).encode()


def segments(key, url, payload, size, digest, kind, refers, number: str, chunk_bytes: int) -> Iterator[bytes]:
    """The archive records (without their end mark) of one page: one, or a segment per chunk."""
    rid = f"urn:record:{number}"
    clean = None if url is None else "".join(url.split())
    common = [("WARC-Target-URI", clean), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "text/html"),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Key", key), ("X-Payload-Length", size)]
    if kind == "revisit":
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{rid}>"), *common, ("WARC-Profile", PROFILE),
                     ("X-Refers-To-Key", refers), ("Content-Length", 0)])
        return
    view = memoryview(payload)
    count = max(1, -(-len(view) // chunk_bytes))
    for k in range(count):
        part = view[k * chunk_bytes:(k + 1) * chunk_bytes]
        own = [] if count == 1 else [("WARC-Segment-Number", k + 1)]
        if k:
            own.append(("WARC-Segment-Origin-ID", f"<{rid}>"))
        if k and k == count - 1:
            own.append(("WARC-Segment-Total-Length", len(view)))
        yield _head([("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", f"<{rid}{f':{k}' * bool(k)}>"),
                     *common, *own, ("Content-Length", len(part))]) + bytes(part)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
          chunk_bytes: int = CHUNK_BYTES, revisit_from: int = REVISIT_FROM) -> None:
    """Archives (gzip) of all rows of ``pages`` under ``path``."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"),
                        F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("digest"))
    plan = saved(choose(rows.select("key", "bytes", "digest"), revisit_from), "warc-plan").alias("p")
    rows = rows.alias("r")
    # By key and digest: a key that repeats with another payload finds its own plan.
    both = rows.join(plan, same_key(F.col("r.key"), F.col("p.key")) & (F.col("r.digest") == F.col("p.digest"))).select(
        F.col("r.key").cast("string").alias("key"), "url", F.when(F.col("type") == "response", F.col("payload")).alias("payload"),
        "r.bytes", "r.digest", "type", F.col("refers_to").cast("string").alias("refers_to"))

    def lines(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            payloads = batch.column(2)
            out, held = [], 0
            for i, (own, link, size, sha, kind, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6)))):
                data = payloads[i].as_buffer() if payloads[i].is_valid else b""
                for record in segments(own, link, data, size, sha, kind, refers, f"{part}-{k}", chunk_bytes):
                    out.append(record)
                    held += len(record)
                    if held >= 16 * chunk_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
                k += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # The bytes pass through the text writer unchanged; every value is followed by the record end.
    both.mapInArrow(lines, "value binary").select(F.col("value").cast("string")).write.option("lineSep", END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


class _Stream:
    """Bytes of an archive file, inflated as they are asked for."""

    def __init__(self, data, step: int = 1 << 18) -> None:
        self.data, self.at, self.step, self.held = memoryview(data), 0, step, bytearray()
        self.gzip = zlib.decompressobj(31) if bytes(self.data[:2]) == b"\x1f\x8b" else None

    def more(self) -> bool:
        part = self.data[self.at:self.at + self.step]
        self.at += len(part)
        if not self.gzip:
            self.held += part
            return bool(len(part))
        while len(part):
            self.held += self.gzip.decompress(part)
            part = self.gzip.unused_data
            if part:  # the next member of the file
                self.gzip = zlib.decompressobj(31)
        return self.at < len(self.data) or bool(len(self.held))

    def line_block(self) -> bytes | None:
        """The next head, without its empty line; None at the end."""
        while (cut := self.held.find(b"\r\n\r\n")) < 0:
            if self.at >= len(self.data):
                return None
            self.more()
        head = bytes(self.held[:cut])
        del self.held[:cut + 4]
        return head

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.at < len(self.data):
            self.more()
        if len(self.held) < n:
            raise ValueError("the archive file ends inside a record")
        part = bytes(self.held[:n])
        del self.held[:n]
        return part


def parse(data, chunk_bytes: int, payloads: bool) -> Iterator[tuple]:
    """Chunk rows of an archive file; ``payloads`` False leaves out those whose digest is complete here."""
    stream = _Stream(data)
    while (head := stream.line_block()) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")[1:] if ": " in line)
        segment = int(fields.get("WARC-Segment-Number", 0))
        record = fields.get("WARC-Segment-Origin-ID") or fields["WARC-Record-ID"]
        declared, left, k, sha = fields.get("X-Payload-Length"), int(fields["Content-Length"]), 0, hashlib.sha256()
        while True:
            part = stream.take(min(left, chunk_bytes))
            left -= len(part)
            sha.update(part)
            yield (record, segment, k, fields.get("X-Key"), fields["WARC-Type"], fields.get("X-Refers-To-Key"),
                   None if declared is None else int(declared), (fields.get("WARC-Payload-Digest") or "").removeprefix("sha256:") or None,
                   len(part), None if segment or left else sha.hexdigest(), part if payloads or segment else None)
            k += 1
            if not left:
                break
        if stream.take(4) != END.encode():
            raise ValueError(f"no end mark after {record}")


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """The chunk table of all archive files under ``path``."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                rows, held = [], 0
                for row in parse(batch.column(0)[i].as_buffer(), chunk_bytes, payloads):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 2_000 or held >= 64 * chunk_bytes:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, CHUNKS)


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record; digests of segmented payloads are carried over their chunks in order."""
    def fold(batches):
        state = None  # record, first row, bytes, running digest, complete digest
        out: list[tuple] = []

        def done():
            _, row, size, sha, whole = state
            digest = whole or sha.hexdigest()
            if row["type"] == "revisit":
                size, digest, intact = row["declared_bytes"], row["declared_digest"], True
            else:
                intact = digest == (row["declared_digest"] or digest) and size == (size if row["declared_bytes"] is None else row["declared_bytes"])
            out.append((row["key"], row["type"], row["refers_to"], size, digest, intact))

        for batch in batches:
            payloads = batch.column("payload")
            for i, row in enumerate(batch.drop_columns(["payload"]).to_pylist()):
                if state is None or state[0] != row["record"]:
                    if state:
                        done()
                    state = [row["record"], row, 0, hashlib.sha256(), None]
                state[2] += row["size"]
                if row["segment"]:
                    state[3].update(payloads[i].as_buffer())
                state[4] = state[4] or row["sha256"]
            if out:
                yield _rows(out)
                out.clear()
        if state:
            done()
            yield _rows(out)

    def _rows(out):
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          ["key", "type", "refers_to", "payload_bytes", "payload_digest", "intact"])

    return chunks.repartition("record").sortWithinPartitions("record", "segment", "chunk").mapInArrow(fold, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back: one row per page."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    rows = read_records(read_chunks(pages.sparkSession, path, payloads=False))
    return rows.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                       F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "intact")
