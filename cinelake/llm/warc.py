"""WARC archives through a chunked record table.

A payload is a run of rows (record id, chunk number, bytes), each with the digest of the payload up to its end. Payloads
are cut where they are read, in the JVM, so that no Python worker ever holds an oversized record whole. The writer turns rows into
gzip members of `.warc.gz` files, one member a record, chunk by chunk, and starts another file when one is large; the reader
streams them back into the same kind of table, checks every payload against its header's digest, and never looks
further than one chunk.

Files are written from tasks under names of their own, and only those named in the manifest, a written table
of what the successful attempts returned, are read: repeated or lost attempts leave no record twice.
The folder must be one that pyarrow opens (local or mounted, hdfs, s3, gs).

Of records with equal payloads of at least `least` bytes the one with the smallest id is a response and
the others revisit it. Defined cases: a null payload is empty; payloads of any length are whole; rows that repeat both id and payload are
all responses, or all revisits; null ids come last and read back as null; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, set_batches, small, written

CHUNK = 256 << 10
#: Bytes from which on an archive is closed.
ROLL = 1 << 30
RECORD_URI = "urn:cinelake:page:"
DATE = "2024-01-01T00:00:00Z"

CHUNKS = "page_id bigint, url string, chunk_no int, last boolean, data binary, running_digest string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_CHUNKS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("running_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (binary), sha1 (hex), record_type, refers_to for every row of (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("bigint"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    keys = rows.select("page_id", "sha1", F.octet_length("payload").alias("n")).filter(F.col("n") >= least)
    # groups of copies are counted and their first id found before any join; only those of two ids or more go on
    first = keys.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter((F.col("copies") > 1) & F.col("first").isNotNull())
    # a table of its own, so that a payload that a third of all rows share can be split in the join
    first = small(written(first, "copied"), 64)
    later = keys.join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("first").alias("refers_to")).distinct()
    later = small(written(later, "revisits"), 80)
    joined = rows.join(later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
    return joined.select("page_id", "url", "payload", "sha1", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def chunks(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table of `decide`'s rows. A record's chunks leave the JVM one after another; what is kept between them is a digest."""
    set_batches(records.sparkSession, 128)
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring("payload", k * size + 1, F.lit(size)))
    rows = records.select("page_id", "url", F.posexplode(cut).alias("k", "data"), n.alias("n"), F.octet_length("payload").cast("bigint").alias("bytes"), "sha1", "record_type", "refers_to")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha1()
        for b in batches:
            columns = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            rest = zip(*(columns[c].to_pylist() for c in ("page_id", "url", "k", "n", "bytes", "sha1", "record_type", "refers_to")), strict=True)
            out = []
            for (page, url, k, n, whole_bytes, sha1, kind, to), data in zip(rest, columns["data"], strict=True):
                part = memoryview(data.as_buffer())
                digest = digest if k else hashlib.sha1()
                digest.update(part)
                out.append((page, url, k, k == n - 1, part, base32(digest.digest()), whole_bytes, base32(bytes.fromhex(sha1)), kind, to))
            if out:
                yield _batch(out)

    return rows.mapInArrow(kernel, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNKS.types, strict=True)], schema=_CHUNKS)


def _head(row: dict) -> bytes:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    name = lambda i: f"<{RECORD_URI}{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {name(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["url"]:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"]))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(row['refers_to'])}"]
    length = len(http) + (0 if revisit else row["payload_bytes"])
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode() + http


MANIFEST = "path string, records bigint, bytes bigint"


def write(chunk_table: DataFrame, folder: str, level: int = 1, roll: int = ROLL) -> DataFrame:
    """Writes the records of a chunked table (a record's rows in order, in one partition) and returns MANIFEST, written. A file is closed after the
    record with which it reaches `roll` bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, member, records, path = None, None, 0, ""

        def closed() -> pa.RecordBatch:
            n = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records]), pa.array([n])], ["path", "records", "bytes"])

        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    system, root = fs.FileSystem.from_uri(folder)
                    system.create_dir(root, recursive=True)
                    path, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(path, compression=None)
                if row["chunk_no"] == 0:
                    member, records = zlib.compressobj(level, wbits=31), records + 1
                    out.write(member.compress(_head(row)))
                if row["record_type"] == "response":
                    out.write(member.compress(row["data"]))
                if row["last"]:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    if out.tell() >= roll:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return written(chunk_table.mapInArrow(kernel, MANIFEST), "manifest")


def _id(text: str) -> int | None:
    return int(text[len(RECORD_URI) + 1 : -1]) if text != f"<{RECORD_URI}>" else None


def _records(stream, size: int) -> Iterator[tuple]:
    """Rows of CHUNKS from an open archive, one chunk in memory at a time."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head, http = {}, {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        left = int(head["content-length"])
        while (line := stream.readline()) != b"\r\n":
            left -= len(line)
            name, _, value = line.decode("latin-1").partition(":")
            http[name.lower()] = value.strip()
        left -= 2
        kind, whole, n, k = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]), 0
        page, to = _id(head["warc-record-id"]), _id(head["warc-refers-to"]) if "warc-refers-to" in head else None
        if kind == "revisit":
            yield page, head.get("warc-target-uri"), 0, True, b"", whole, n, whole, kind, to
        else:
            digest = hashlib.sha1()
            while left or not k:
                data = stream.read(min(size, left)) if left else b""
                if left and not data:
                    raise ValueError("the archive ends within a record")
                left -= len(data)
                digest.update(data)
                yield page, head.get("warc-target-uri"), k, not left, data, base32(digest.digest()), n, whole, kind, to
                k += 1
            if base32(digest.digest()) != whole:
                raise ValueError(f"the payload of {head['warc-record-id']} does not have its header's digest")
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read(manifest: DataFrame, folder: str, size: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in `manifest`; without data, only each record's last row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None, buffer_size=size) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in _records(stream, size):
                        if not with_data:
                            if not row[3]:
                                continue
                            row = (*row[:4], None, *row[5:])
                        rows.append(row)
                        held += len(row[4] or b"")
                        if held >= 8 * size or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = manifest.select("path")
    return files.repartition(max(1, min(2000, files.count())), "path").mapInArrow(kernel, CHUNKS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all (page_id, url, html) as archives in the shared folder and reads their records' last rows back."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write(chunks(decide(pages, least)), folder)
    return read(manifest, folder, with_data=False)
