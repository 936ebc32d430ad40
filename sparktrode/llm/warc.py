"""WARC archives: a writer with one gzip member for each record, and a sequential reader.

The reader inflates one member after the other with zlib, a chunk at a time, frames each record by
its Content-Length and checks its digests. Archives are written straight to a shared folder; only
the files named in a written manifest count, so what a failed task leaves is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, written

CHUNK = 1 << 18
LEVEL = 6
ARCHIVE_BYTES = 1 << 28
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32, from 40-bit groups of the hex digest."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest and refers_to: of equal payloads the largest page_id's row is
    the response, the others refer to it.

    Null html is an empty payload. Rows that repeat the largest page_id are all responses. Where
    every page_id of a payload is null, all are responses; beside others, a null one is a revisit.
    Payloads of fewer than min_bytes bytes are all responses.
    """
    base = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    kept = base.filter(F.octet_length("payload") >= min_bytes)
    groups = kept.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 and top is not null").drop("n")
    groups = written(groups, "payload_groups")  # its size is known when the join is planned
    return base.join(groups, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when((F.octet_length("payload") >= min_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to")
    )


def _clean(value: str) -> str:
    """A header's value on one line: control characters and '%' are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


def _plain(value: str) -> str:
    out = value.split("%")
    return out[0] + "".join(chr(int(x[:2], 16)) + x[2:] for x in out[1:])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has no payload of its own but names the response."""
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _writer(folder: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _open(folder)
        out, name, size, records = None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{at}/{name}")
                deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = deflate.compress(record(*row)) + deflate.flush()
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= limit:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [records]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [records]})

    return write


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages into archives of about archive_bytes and return their manifest.

    Each task writes files of its own names, so a repeated task leaves files that no manifest
    names. The manifest is a written table: it is the commit of the archives.
    """
    bounded_batches(pages.sparkSession)
    store, at = _open(folder)
    store.create_dir(at, recursive=True)
    return written(mark_revisits(pages, min_bytes).mapInArrow(_writer(folder, archive_bytes), "archive string, bytes long, records long"), "warc_manifest")


def members(stream) -> Iterator[bytes]:
    """The inflated chunks of each gzip member in turn; an empty chunk ends a member."""
    data = b""
    while True:
        inflate = zlib.decompressobj(31)
        data = data or stream.read(CHUNK)
        if not data:
            return
        while not inflate.eof:
            if not data and not (data := stream.read(CHUNK)):
                raise ValueError("the archive ends inside a gzip member")
            chunk = inflate.decompress(data, CHUNK)
            data = inflate.unconsumed_tail or inflate.unused_data
            if chunk:
                yield chunk
        yield b""


def records(stream) -> Iterator[tuple[dict[str, str], int, str, str]]:
    """(headers, payload bytes, payload digest, block digest) of each record.

    A block is hashed chunk by chunk, so memory doesn't grow with a record.
    """
    chunks = members(stream)
    for chunk in chunks:
        head = chunk
        while b"\r\n\r\n" not in head:
            if not (more := next(chunks, b"")):
                raise ValueError("a record ends inside its headers")
            head += more
        raw, _, rest = head.partition(b"\r\n\r\n")
        version, *lines = raw.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        left = int(headers["Content-Length"])
        block, payload, size, http, tail = hashlib.sha1(), hashlib.sha1(), 0, b"", b""
        inside = False
        while True:
            part, extra = rest[:left], rest[left:]
            left -= len(part)
            tail += extra
            block.update(part)
            if not inside:
                http += part
                if b"\r\n\r\n" in http:
                    inside, part = True, http.partition(b"\r\n\r\n")[2]
            if inside and part:
                payload.update(part)
                size += len(part)
            if not (rest := next(chunks, b"")):
                break
        if left or tail != b"\r\n\r\n":
            raise ValueError("a record's length isn't its Content-Length")
        yield headers, size, base64.b32encode(payload.digest()).decode(), base64.b32encode(block.digest()).decode()


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[x.split(" ")[1]]) for n, x in zip(names, READ_SCHEMA.split(", "), strict=True)])
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            store, at = _open(archive)
            rows = []
            with store.open_input_stream(at) as stream:
                for h, size, digest, block in records(stream):
                    if h["WARC-Block-Digest"] != f"sha1:{block}":
                        raise ValueError(f"block digest of {h['WARC-Record-ID']}")
                    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (said != digest or int(h["X-Payload-Length"]) != size):
                        raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
                    number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                    url = _plain(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None
                    rows.append((number("X-Page-ID"), url, number("X-Payload-Length"), said, h["WARC-Type"], number("X-Refers-To-Page"), archive))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_warc(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives in column `archive`; a bad digest fails the job."""
    spread = archives.select("archive").repartition(max(1, min(archives.count(), 4096)))
    return spread.mapInArrow(_reader, READ_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages and read them back; an empty table gives no archive and no row."""
    return read_warc(write_warc(pages, new_path(spark, "warc"), min_bytes))
