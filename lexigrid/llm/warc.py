"""WARC archives: a writer that marks revisits, and a reader that salvages damaged files.

Writing: one record per page, each a gzip member of its own, through Spark's text
sink, so files appear by its committer and a lost task leaves nothing behind. A
task numbers its files by the bytes written so far (the folders volume=N). The
sink ends every line with a separator; a member's last byte (the top byte of its
length, 0 below 16 MB) serves as that, and a longer record is cut into several
members. Records of equal payload are found by digest: the one of the smallest
page_id is a response, the others revisit it and carry no payload.

Reading: a file is taken member by member (or, without compression, from version
line to version line), and every record's check sums, lengths and digests are
checked. After a failure the reader looks for the next valid member or version
line, goes on from there, and logs the bytes between as a quarantined gap.

Edge cases: a null html is an empty payload; payloads below ``least_bytes`` are
always responses; rows that repeat a page_id with one payload are all responses
(it is the same page); a null page_id stays null, and is a revisit only if some
other page has the payload; empty tables and folders give no rows; further
columns are ignored; very long records are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import maybe_broadcast, prepare, tidy

BROADCAST_ROWS = 500_000
#: A file ends at the first of these; only a record that is larger makes a larger file.
RECORDS_PER_FILE, FILE_BYTES = 4_000, 64 << 20
_MEMBER = 1 << 24
_DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"(?:^|(?<=\n))WARC/1\.\d\r?\n")
_LEVEL, _STEP = 5, 1 << 14


def record_uuid(page_id: int | None) -> str:
    """A record id that holds the page id: a UUID of version 8."""
    h = f"{(page_id or 0) & 0xFFFFFFFFFFFFFFFF:016x}"
    return f"{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}{'01' if page_id is None else '00'}-000000000000"


def page_of(urn: str | None) -> int | None:
    found = re.search(r"([0-9a-f]{8})-([0-9a-f]{4})-8([0-9a-f]{3})-8([0-9a-f])(0[01])-0{12}", urn or "")
    if not found or found[5] == "01":
        return None
    value = int("".join(found.groups()[:4]), 16)
    return value - (1 << 64) if value >> 63 else value


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{record_uuid(page_id)}>"


def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(first)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def members(record: bytes) -> bytes:
    """The record in gzip members whose last byte is 0."""
    out = []
    for i in range(0, len(record), _MEMBER - 1):
        packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
        out.append(packer.compress(record[i : i + _MEMBER - 1]) + packer.flush())
    return b"".join(out)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write page_id, url and html of every row to WARC files below folder."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    named = rows.filter(F.octet_length("html") >= least_bytes).select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size"))
    firsts = named.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = named.join(maybe_broadcast(firsts, BROADCAST_ROWS), ["digest", "size"]).filter("page_id is null or page_id <> first").filter("first is not null")
    later = later.select("page_id", "digest", "size", "first").distinct().checkpoint()
    keyed = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    marked = keyed.alias("k").join(
        maybe_broadcast(later, BROADCAST_ROWS).alias("l"),
        F.col("k.page_id").eqNullSafe(F.col("l.page_id")) & (F.col("k.digest") == F.col("l.digest")) & (F.col("k.size") == F.col("l.size")), "left",
    ).select("k.page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume = size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                volumes, records = [], []
                for r in batch.slice(i, 64).to_pylist():
                    data = members(_record(r["page_id"], r["url"], r["html"].encode(), r["first"], r["first"] is not None))
                    if size and size + len(data) > file_bytes:
                        volume, size = volume + 1, 0
                    size += len(data)
                    volumes.append(volume)
                    records.append(data[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(records, pa.binary())], names=["volume", "record"])

    made = marked.mapInArrow(tidy(run), "volume int, record binary").select("volume", F.col("record").cast("string").alias("record"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).mode("overwrite").partitionBy("volume").text(folder)


@dataclass
class Found:
    """A record with its place, or a gap (reason is set)."""

    offset: int
    length: int
    reason: str = ""
    headers: dict[str, str] | None = None
    block: bytes = b""


def _parse(data: bytes, at: int) -> tuple[Found | None, str]:
    """The record at a position, or what is wrong with it."""
    if not (v := _VERSION.match(data, at)):
        return None, "no version line"
    end = data.find(b"\r\n\r\n", v.end())
    if end < 0:
        return None, "no end of header"
    headers = {}
    for line in data[v.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, "bad header line"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        return None, "no length"
    start, size = end + 4, int(headers["content-length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        return None, "wrong length"
    block = data[start : start + size]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != base32_sha1(block):
        return None, "wrong block digest"
    told = headers.get("warc-payload-digest", "")
    if told.startswith("sha1:") and headers.get("warc-type") == "response" and told[5:] != base32_sha1(payload_of(block)):
        return None, "wrong payload digest"
    return Found(at, start + size + 4 - at, "", headers, block), ""


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message."""
    return block.partition(b"\r\n\r\n")[2]


def _plain(data: bytes) -> Iterator[Found]:
    at = 0
    while at < len(data):
        found, why = _parse(data, at)
        if found:
            yield found
            at += found.length
            continue
        following = next((m.start() for m in _VERSION.finditer(data, at + 1)), len(data))
        while following < len(data) and not _parse(data, following)[0]:
            following = next((m.start() for m in _VERSION.finditer(data, following + 1)), len(data))
        yield Found(at, following - at, why)
        at = following


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A member's content and its end; raises if its checks fail."""
    packer, view, out = zlib.decompressobj(31), memoryview(data), []
    while at < len(data) and not packer.eof:  # in steps, as what is left over is copied
        out.append(packer.decompress(view[at : at + _STEP]))
        at += _STEP
    if not packer.eof:
        raise zlib.error("cut short")
    return b"".join(out), min(at, len(data)) - len(packer.unused_data)


def _zipped(data: bytes) -> Iterator[Found]:
    at, held, start = 0, b"", 0  # held: a record's members so far
    while at < len(data):
        try:
            got, end = _inflate(data, at)
            why = ""
        except zlib.error as e:
            got, end, why = b"", at, str(e)
        if not why:
            whole = held + got
            records, inside = [], 0
            while inside < len(whole):
                found, why = _parse(whole, inside)
                if not found:
                    break
                records.append(found)
                inside += found.length
            if not why or records:
                for x in records:
                    yield Found(start if held else at, end - (start if held else at), "", x.headers, x.block)
                if why:
                    yield Found(at, end - at, why)
                held, at, start = b"", end, end
                continue
            more = re.search(rb"\ncontent-length:\s*(\d+)", whole, re.I)
            if why == "wrong length" and more and len(whole) < int(more[1]) + whole.find(b"\r\n\r\n") + 8:
                held, start, at = whole, (start if held else at), end
                continue
        bad = start if held else at
        at = _next_member(data, bad + 1)
        held, start = b"", at
        yield Found(bad, at - bad, why or "damaged member")
    if held:
        yield Found(start, len(data) - start, "cut short")


def _next_member(data: bytes, at: int) -> int:
    """Where the next member that starts a record lies."""
    while (at := data.find(_MAGIC, at)) >= 0:
        try:
            if _VERSION.match(zlib.decompressobj(31).decompress(data[at : at + 4096], 64)):
                return at
        except zlib.error:
            pass
        at += 1
    return len(data)


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records of a file, and the gaps between them."""
    if data.startswith(_MAGIC) or _VERSION.match(data):
        return _zipped(data) if data.startswith(_MAGIC) else _plain(data)
    line = _VERSION.search(data)
    return _zipped(data) if _next_member(data, 0) < (line.start() if line else len(data)) else _plain(data)


READ_SCHEMA = "path string, offset long, length long, gap string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record, and per gap (its reason in gap); payload is null for revisits, gaps and without payloads."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in READ_SCHEMA.split(", ")])
        for batch in batches:
            for k in range(batch.num_rows):
                path, rows = batch.column(0)[k].as_py(), []
                for x in salvage(batch.column(1)[k].as_py()):
                    rows.append(dict.fromkeys(names) | {"path": path, "offset": x.offset, "length": x.length, "gap": x.reason or None} | (_fields(x, payloads) if x.headers else {}))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(folder).select("path", "content").mapInArrow(tidy(run), READ_SCHEMA)


def _fields(x: Found, payloads: bool) -> dict:
    h = x.headers
    kind, out = h.get("warc-type"), {}
    if kind == "response":
        payload = payload_of(x.block)
        out = {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "payload": payload if payloads else None}
    elif kind == "revisit":
        told = re.search(rb"\ncontent-length:\s*(\d+)", x.block, re.I)
        out = {"payload_bytes": int(told[1]) if told else None, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": page_of(h.get("warc-refers-to"))}
    return out | {"record_type": kind, "page_id": page_of(h.get("warc-record-id")), "url": h.get("warc-target-uri") or None}
