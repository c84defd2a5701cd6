"""WARC records in seekable Zstandard bundles.

A bundle is one file: independent zstd frames of about ``FRAME_BYTES`` of WARC records each (a longer record has a frame
of its own), then a skippable frame with the seek table of the public seekable format: compressed and full size of each
frame, their number, and the magic 0x8F92EAB1. A record is found by (bundle, frame, offset in the frame, length): that
index is a Parquet table beside the bundles.

A response holds the page as an HTTP response does, a head and then the payload, as readers of such archives expect; digest
and length are the payload's. A record's id is its page_id and the beginning of its payload's digest, so that pages that share an id
but not a payload are told apart.

Of records with equal payloads of at least ``MIN_DEDUP`` bytes, the one with the smallest page_id is a ``response``; the
others are ``revisit`` records without payload that name it (WARC-Refers-To) and keep the payload's digest and length.

Every task writes bundles under a name of its own attempt and returns the index rows that name them; the index is written
before anything is read, so a retried or speculative task leaves at most a file that no index names.

Defined cases: a null html is an empty payload; a null page_id gives a response with a null id (it is never referred to
and refers to none, as nulls have no smallest); rows that repeat the smallest page_id with its payload are responses all;
an empty table gives no bundles and an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bound_batches, fresh_path, staged
from sparkloom.llm.files import make_dir, open_in, open_out

FRAME_BYTES = 1 << 19
BUNDLE_BYTES = 1 << 30
TASK_BYTES, TASKS = 1 << 25, 20_000
MIN_DEDUP = 100
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
RECORD_ID = "urn:page:"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX = "page_id long, bundle string, frame int, start long, length long"


def _named(page_id: int | None, digest: str) -> str:
    return f"<{RECORD_ID}{'' if page_id is None else page_id}:{digest[:16]}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to`` given) has no payload."""
    revisit = refers_to is not None
    body = b"" if revisit else HTTP_HEAD % len(payload) + payload
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_named(page_id, digest)}", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_named(refers_to, digest)}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where it should")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def _id(field: str) -> int | None:
    got = field.removeprefix(f"<{RECORD_ID}").rpartition(":")[0]
    return int(got) if got else None


def _batch(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


class BundleWriter:
    """Frames, then the seek table. ``add`` returns the record's frame and offset in it."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.parts: list[bytes] = []
        self.size, self.written, self.table = 0, 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.table), self.size
        self.parts.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.size:
            frame = self.zstd.compress(b"".join(self.parts))
            self.out.write(frame)
            self.written += len(frame)
            self.table.append((len(frame), self.size))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Reads any one frame by the seek table; the last one read is kept."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        file.seek(end - 9 - 8 * n)
        table = list(struct.iter_unpack("<II", file.read(8 * n)))
        self.starts, at = [], 0
        for packed, full in table:
            self.starts.append((at, packed, full))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, start: int, length: int) -> bytes:
        if self.last[0] != frame:
            at, packed, full = self.starts[frame]
            self.file.seek(at)
            self.last = frame, zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=full)
        return self.last[1][start : start + length]


def _typed(pages: DataFrame, min_dedup: int) -> DataFrame:
    """Pages with digest and refers_to."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # one long per repeated payload; counted map-side, so a payload of a third of all rows is a few rows by then
    firsts = p.filter(F.octet_length("html") >= min_dedup).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    firsts = staged(firsts, "warc-firsts")  # a scan on each side lets Spark split a hot digest
    p = p.join(firsts, "digest", "left")
    return p.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")


def write_bundles(pages: DataFrame, out_dir: str, min_dedup: int = MIN_DEDUP, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes the bundles to ``out_dir`` (of the shared folder) and returns the record index, read from ``out_dir``/index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, ""
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if writer is None:
                    name = f"{out_dir}/{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(open_out(name), frame_bytes)
                record = warc_record(x["page_id"], x["url"], x["html"].encode("utf-8"), x["digest"], x["refers_to"])
                frame, start = writer.add(record)
                rows.append((x["page_id"], name, frame, start, len(record)))
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            if rows:
                yield _batch(rows, ("page_id", "bundle", "frame", "start", "length"), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))
        if writer is not None:
            writer.close()

    make_dir(out_dir)
    spark = pages.sparkSession
    bound_batches(spark)
    index = _typed(pages, min_dedup).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, INDEX)
    index.write.parquet(f"{out_dir}/index")
    return spark.read.schema(INDEX).parquet(f"{out_dir}/index")


def read_bundles(index: DataFrame) -> DataFrame:
    """Every indexed record read through its bundle's seek table and checked: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader, file = None, None, None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["bundle"] != name:
                    if file is not None:
                        file.close()
                    name, file = x["bundle"], open_in(x["bundle"])
                    reader = BundleReader(file)
                fields, payload = parse_record(reader.record(x["frame"], x["start"], x["length"]))
                kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                if kind == "response":
                    n, found = len(payload), hashlib.sha256(payload).hexdigest()
                    if found != digest:
                        raise ValueError(f"payload of record {fields['WARC-Record-ID']} is damaged")
                rows.append((_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], n, digest, kind, _id(fields["WARC-Refers-To"]) if kind == "revisit" else None))
            if rows:
                yield _batch(rows, ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))
        if file is not None:
            file.close()

    # a frame's records go to one task, which reads on from frame to frame; tasks by what they will read, as index rows are small
    total = index.agg(F.sum("length")).first()[0] or 0
    near = index.repartitionByRange(max(1, min(TASKS, -(-total // TASK_BYTES))), "bundle", "frame").sortWithinPartitions("bundle", "frame", "start")
    return near.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def bundle_pages(pages: DataFrame) -> DataFrame:
    index = write_bundles(pages, fresh_path(pages.sparkSession, "warc"))
    return read_bundles(index).drop("url")
