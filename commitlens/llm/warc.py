"""WARC archives: one gzip member per record, written by Spark's text writer and read back by byte ranges.

Writing. Each row becomes a complete gzip member. A gzip member ends with its content's length as four little-endian bytes, and a
record's member holds less than 16 MB, so its last byte is always zero: the text writer gets the member without that byte and puts it back as its line
separator. The files are thus exact concatenations of gzip members, written under Spark's commit protocol (a lost executor's
attempt leaves nothing behind). A record of 16 MB or more spans several members.

Reading. Files are cut into byte ranges. A task searches its range for the gzip magic, accepts a candidate only if it
decompresses to a record head, and owns the records that start inside its range, reading past the range's end to finish the last.
Magic bytes inside compressed data fail the test and are passed over.

Defined results: a null payload is an empty one; a null page id is written as such and comes back as null; equal payloads of
at least ``revisit_bytes`` bytes are stored once, with the largest page id, and revisited by the others (rows that repeat
that id are responses too).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

MAGIC = b"\x1f\x8b\x08"
#: Content of one gzip member, at most; below 16 MB, so that the length's last byte is zero.
MEMBER_BYTES = (1 << 24) - 1
#: Compressed bytes fetched at once while reading.
READ_BYTES = 1 << 20
#: Bytes searched at once for the next magic.
SEARCH_BYTES = 1 << 16
HEAD = re.compile(rb"WARC/1\.[01]\r\n")
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def revisit_plan(pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): which record of each group of equal payloads holds the payload.

    Only (digest, largest id) rows of repeated payloads are joined back; the join splits hot digests.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")}
    )
    kept = (
        rows.where(F.col("size") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "keeper")
    )
    return rows.join(kept, "digest", "left").withColumn("refers_to", F.when(F.col("keeper") != F.coalesce("page_id", F.lit(-(1 << 63))), F.col("keeper")))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record. Line breaks in a url would end its header line, so they are percent-encoded."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(record: bytes) -> bytes:
    out = []
    for i in range(0, len(record), MEMBER_BYTES):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(c.compress(record[i : i + MEMBER_BYTES]) + c.flush())
    return b"".join(out)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(b.column(i) for i in range(6)), strict=True)
        out: list[bytes] = []
        held = 0
        for row in rows:
            out.append(members(record_bytes(*(x.as_py() for x in row)))[:-1])
            held += len(out[-1])
            if held > 32 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000) -> None:
    plan = revisit_plan(pages, id_col, url_col, payload_col, revisit_bytes)
    rows = plan.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(_encode, "value binary")
    # a cast from binary to string keeps the bytes as they are
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Source:
    """Bytes of one file by absolute position, fetched in pieces."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, position: int, n: int) -> bytes:
        """Up to n bytes from ``position``; fewer only at the end of the file."""
        if not self.at <= position <= position + n <= self.at + len(self.held):
            self.at, self.held = position, self.file.read_at(min(max(n, READ_BYTES), max(0, self.size - position)), position)
        i = position - self.at
        return self.held[i : i + n]


def _member(source: _Source, position: int, head_only: bytes | None = None) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``position`` and the position behind it; None if there is no valid member."""
    d, out, p, size = zlib.decompressobj(31), [], position, 1 << 12
    try:
        while not d.eof:
            piece = source.read(p, min(size, source.size - p))
            if not piece:
                return None
            out.append(d.decompress(piece))
            p += len(piece)
            size = min(2 * size, 1 << 18)
            if head_only is not None and sum(map(len, out)) >= len(head_only) and not b"".join(out).startswith(head_only):
                return None
    except zlib.error:
        return None
    return b"".join(out), p - len(d.unused_data)


def _records(uri: str, start: int, end: int) -> Iterator[bytes]:
    """Whole records whose first member starts in [start, end)."""
    source, p = _Source(uri), start
    end = min(end, source.size)
    while p < end:
        near = source.read(p, min(len(MAGIC), source.size - p))  # records follow one another, so this is the common case
        window = near if near == MAGIC else source.read(p, min(SEARCH_BYTES, source.size - p))
        i = window.find(MAGIC)
        if i < 0:
            p += max(1, len(window) - len(MAGIC) + 1)
            continue
        if p + i >= end:
            return
        p += i
        got = _member(source, p, b"WARC/1.")
        if got is None or not HEAD.match(got[0]):
            p += 1
            continue
        record, after = got
        cut = record.find(b"\r\n\r\n")
        length = re.search(rb"\r\nContent-Length: (\d+)", record[:cut])
        need = cut + 4 + int(length[1]) + 4 if cut >= 0 and length else len(record)
        while len(record) < need and (more := _member(source, after)) is not None:
            record, after = record + more[0], more[1]
        yield record
        p = after


def parse(record: bytes) -> tuple[int | None, int, str, str, int | None, str, bytes | None]:
    cut = record.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in record[:cut].decode().split("\r\n")[1:])
    block = record[cut + 4 : cut + 4 + int(head["Content-Length"])]
    number = lambda x: None if (n := x[len("<urn:page:") : -1]) == "null" else int(n)
    digest, size, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Bytes"]), None
    if head["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"record {head['WARC-Record-ID']}: its payload does not match its digest")
    refers = head.get("WARC-Refers-To")
    return number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], number(refers) if refers else None, head["WARC-Target-URI"], payload


def read(spark: SparkSession, path: str, range_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url and, if asked for, the payload (null for revisits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                for record in _records(uri, start, end):
                    row = parse(record)
                    rows.append(row if with_payload else (*row[:6], None))
                    held += len(row[6] or b"") if with_payload else 100
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content column is not read
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), F.explode(starts).alias("start")).withColumn("end", F.col("start") + range_bytes)
    return ranges.repartition(partitions(spark)).mapInArrow(scan, FIELDS)
