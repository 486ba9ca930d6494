"""WARC archives: a writer and a salvage reader.

write() makes one record per page, each a gzip member of its own. Records with equal payloads of at least
`REVISIT_BYTES` bytes are stored once, as the response of the page with the largest id; the others become revisit
records that refer to it and keep the HTTP header. Repeated payloads are found by their digests alone: the
`HOT_PAYLOADS` commonest ones are broadcast, what there is beyond joins by digest, so html moves only for those.
Files hold about `FILE_ROWS` times `CHUNK` compressed bytes at most, unless single records are longer.

salvage() reads archives, plain or packed in gzip members of one or more records. A record must have a version
line, a header with a content length, a block of that length closed by two line ends, and the payload digest
that its header states. If a check fails, the reader searches for the next gzip member or version line at which
a whole record can be read, goes on there, and logs the bytes in between as a quarantined gap. A file is read by
one task as one row, so it must be smaller than 2 GB, the limit of Spark's binary source.

Null html is an empty payload. Null ids write no id and read back as null; they are never referred to. Rows
that repeat a page are records of their own; all rows of the largest id stay responses. Payloads of any length
are kept whole. Other columns, also such with the names of results, are ignored. An empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

REVISIT_BYTES = 1000
#: Repeated payloads that are broadcast: rows of a digest and an id.
HOT_PAYLOADS = 100_000
#: Compressed bytes of a row of an archive, and rows of a file.
CHUNK, FILE_ROWS = 1 << 20, 64
#: Effort of compression, and the size from which a member's last byte is not zero.
LEVEL, LARGE_RECORD = 4, 1 << 24
#: Compressed bytes that are looked at first for the end of a member.
PIECE = 1 << 14
_END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Header fields that a record states once; a second one is another record's.
_ONCE = frozenset({"warc-type", "warc-record-id", "content-length", "warc-payload-digest"})
_MAGIC = b"\x1f\x8b\x08"


def classified(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, bytes, digest, target): target is the id of the response that a page repeats."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    seen = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("most"), F.count(F.lit(1)).alias("n"))
    twice = common.materialize(seen.where("n > 1"), "repeats")
    out = common.join_hot(rows.withColumn("key", F.when(F.col("bytes") >= REVISIT_BYTES, F.col("digest"))), twice.withColumnRenamed("digest", "key"), "key", HOT_PAYLOADS).drop("key")
    repeats = (F.col("bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("most"))
    return out.withColumn("target", F.when(repeats, F.col("most"))).drop("most")


def _records(rows: DataFrame) -> DataFrame:
    """One column: the record of each row of classified() as bytes."""
    revisit = F.col("target").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.concat_ws(":", "page_id", F.substring("digest", 1, 12)), F.lit(">"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"\s+", "%20")),
        F.when(F.col("page_id").isNotNull(), line("WARC-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To-Page", F.col("target").cast("string")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.lit("Content-Type: application/http\r\n"),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("html")), F.lit("\r\n\r\n")).cast("binary").alias("record"))


def member(record: bytes) -> bytes:
    """A record as a gzip member that ends with a zero byte; very long ones are followed by an empty member."""
    out = gzip.compress(record, LEVEL, mtime=0)
    return out if len(record) < LARGE_RECORD else out + gzip.compress(b"", mtime=0)


def write(pages: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Writes a record per page below path."""

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                held.append(member(record.as_py()))
                size += len(held[-1])
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["members"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["members"])

    packed = _records(classified(pages)).mapInArrow(pack, "members binary")
    # the text source writes bytes as they are; the zero byte after each row is the last one of its last member
    packed.select(F.col("members").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", file_rows).text(path)


class Record(NamedTuple):
    offset: int
    end: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    offset: int
    end: int
    reason: str


class Broken(ValueError):
    """A check of a record failed."""


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for row in raw.split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            raise Broken("header line without a colon")
        name = name.decode("latin-1").strip().lower()
        if name in _ONCE and name in out:
            raise Broken(f"{name} stated twice")
        out[name] = value.decode("utf-8", "replace").strip()
    return out


def parse(data: bytes, at: int, last: int | None = None) -> Record:
    """The record at an offset; raises Broken if a check fails."""
    last = len(data) if last is None else last
    found = _VERSION.match(data, at, last)
    if not found:
        raise Broken("no version line")
    stop = data.find(_END, found.end(), last)
    if stop < 0:
        raise Broken("header not closed")
    headers = _headers(data[found.end() : stop])
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Broken("no content length")
    begin, end = stop + 4, stop + 4 + int(length)
    if end + 4 > last or data[end : end + 4] != _END:
        raise Broken("block not closed where its length says")
    block, http = data[begin:end], {}
    if headers.get("content-type", "").startswith("application/http"):
        head, _, block = block.partition(_END)
        http = _headers(head.partition(b"\r\n")[2])
        if headers.get("warc-type") == "response" and http.get("content-length") != str(len(block)):
            raise Broken("payload length differs")
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.startswith("sha1:") and hashlib.sha1(block).hexdigest() != digest[5:].lower():
        raise Broken("payload digest differs")
    return Record(at, end + 4, headers, http, block)


def _unpacked(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at an offset holds, and where it ends; reads ahead in pieces."""
    work, out, step, view = zlib.decompressobj(31), [], PIECE, memoryview(data)
    try:
        while not work.eof and at < len(data):
            out.append(work.decompress(view[at : at + step]))
            at, step = min(at + step, len(data)), step * 2
    except zlib.error as e:
        raise Broken(f"gzip: {e}") from e
    if not work.eof:
        raise Broken("gzip member cut off")
    return b"".join(out), at - len(work.unused_data)


def _member(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """The records and gaps of the gzip member at an offset, all with the member's place, and where it ends."""
    raw, end = _unpacked(data, at)
    found = list(records(raw, packed=False))
    if found and not any(isinstance(x, Record) for x in found):
        raise Broken(found[0].reason)
    return [x._replace(offset=at, end=end) if isinstance(x, Record) else Gap(at, end, f"bytes {x.offset} to {x.end} of the gzip member: {x.reason}") for x in found], end


def records(data: bytes, packed: bool = True) -> Iterator[Record | Gap]:
    """Records of an archive and the gaps between them, in order; packed archives may hold gzip members."""
    at, bad, reason, line = 0, None, "", -1
    while at < len(data):
        try:
            if packed and data.startswith(_MAGIC, at):
                found, after = _member(data, at)
            else:
                found = [parse(data, at)]
                after = found[0].end
        except Broken as e:
            if bad is None:
                bad, reason = at, str(e)
            if line <= at:  # the next version line is searched for once
                line = _VERSION.search(data, at + 1)
                line = line.start() if line else len(data)
            magic = data.find(_MAGIC, at + 1, line) if packed else -1
            at = magic if magic >= 0 else line
            continue
        if bad is not None:
            yield Gap(bad, at, reason)
            bad = None
        yield from found
        at = after
    if bad is not None:
        yield Gap(bad, len(data), reason)


def gzip_archive(raw_records: list[bytes]) -> bytes:
    """Records as an archive with one gzip member each."""
    return b"".join(gzip.compress(r, mtime=0) for r in raw_records)


_SCHEMA = "kind string, path string, offset long, end long, page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, reason string"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _row(path: str, x: Record | Gap, payload: bool):
    if isinstance(x, Gap):
        return ("gap", path, x.offset, x.end, None, None, None, None, None, None, x.reason, *([None] if payload else []))
    h = x.headers
    revisit = h.get("warc-type") == "revisit"
    number = lambda v: int(v) if v and re.fullmatch(r"-?\d+", v) else None
    size = number(x.http.get("content-length")) if revisit else len(x.payload)
    digest = h.get("warc-payload-digest", "")[5:].lower() if revisit else hashlib.sha1(x.payload).hexdigest()
    return ("record", path, x.offset, x.end, number(h.get("warc-page-id")), h.get("warc-target-uri"), size, digest, h.get("warc-type"), number(h.get("warc-refers-to-page")), None, *([x.payload] if payload else []))


def salvage(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record (kind 'record') and per quarantined gap (kind 'gap') of the archives below path."""
    names = [*_NAMES, *(["payload"] if payload else [])]
    schema = _SCHEMA + (", payload binary" if payload else "")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                out, held = [], 0
                for x in records(data.as_py()):
                    out.append(_row(file, x, payload))
                    held += len(x.payload) if payload and isinstance(x, Record) else 64
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages
), t AS (
  SELECT *, max(page_id) OVER (PARTITION BY d) AS m FROM p
)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN b >= 1000 AND page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 1000 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM t
"""
