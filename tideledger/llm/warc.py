"""WARC archives: a writer with revisit records and a reader that salvages what is left of damaged files.

Archives are gzip members, one record each. The reader checks every member (deflate stream, length,
CRC) and record (version line, Content-Length, closing lines, block and payload digest). After a failed
check it looks for the next member that unpacks to a record, in plain archives for the next version
line that starts one, goes on there, and tells the bytes between as a gap with its reason.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.llm.bytefiles import read_bytes, write_bytes
from tideledger.session import durable

VERSION = b"WARC/1.1"
FIRST_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
VERSION_LINE = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r?\n")
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MAX_RECORDS = 2000
#: Input handed to the unpacker at once.
FEED = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _plain(value: object) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def record(kind: str, record_id: object, uri: str | None, digest: str, payload_bytes: int, block: bytes,
           refers_to: object = None, date: str = DATE) -> bytes:
    """A whole record; `block` is the payload of a response and empty for a revisit."""
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{_plain(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_plain(uri)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:record:{_plain(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
             f"X-Payload-Length: {payload_bytes}", "Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def without_last_zero(packed: bytes) -> bytes:
    """What the sink's zero byte completes.

    The last byte of a member's length field is zero below 16 MiB; of longer ones the sink's byte is
    padding after the member.
    """
    return packed[:-1] if packed[-1] == 0 else packed


# -- reading -----------------------------------------------------------------------------------


def _headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.decode("utf-8", "surrogatepass").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def read_record(data: bytes, at: int) -> tuple[int, dict[str, str] | str, bytes]:
    """(end, headers, block) of the record at a place, or (place, reason, b'')."""
    if not FIRST_LINE.match(data, at):
        return at, "no version line", b""
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return at, "headers without end", b""
    try:
        headers = _headers(data[at:head_end])
    except UnicodeDecodeError:
        return at, "headers are not UTF-8", b""
    if "warc-record-id" not in headers or "warc-type" not in headers:
        return at, "no record id or type", b""
    size = headers.get("content-length", "")
    if not size.isdecimal():
        return at, "no Content-Length", b""
    start = head_end + 4
    end = start + int(size)
    if end > len(data):
        return at, "cut off", b""
    if data[end:end + 4] != b"\r\n\r\n":
        return at, "no closing lines", b""
    block = data[start:end]
    wanted = {"warc-block-digest": block}
    if headers.get("warc-type") == "response":
        wanted["warc-payload-digest"] = block
    for name, part in wanted.items():
        algorithm, _, digest = headers.get(name, "").partition(":")
        if algorithm.lower() == "sha1" and digest.upper() != base32_sha1(part):
            return at, f"{name} differs", b""
    return end + 4, headers, block


def _unpack(data: bytes, at: int) -> tuple[int, bytes | None]:
    """(end, content) of the gzip member at a place; content is None if a check fails."""
    unpacker, out = zlib.decompressobj(31), []
    view, place = memoryview(data), at
    try:
        while place < len(data) and not unpacker.eof:
            part = view[place:place + FEED]
            out.append(unpacker.decompress(part))
            place += len(part)
    except zlib.error:
        return at, None
    if not unpacker.eof:
        return at, None
    return place - len(unpacker.unused_data), b"".join(out)


def _starts_record(data: bytes, at: int) -> bool:
    """Whether a member at this place unpacks, at least at its start, to a version line."""
    try:
        head = zlib.decompressobj(31).decompress(data[at:at + 512], 16)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.")


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', start, end, headers, block) and ('gap', start, end, reason) of an archive, in order.

    Works for gzip members, members with several records, plain records and mixtures of them.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        if bad is None and data[at] == 0:
            at += 1
            continue
        found: list[tuple] = []
        end, why = at, "neither member nor version line"
        if data.startswith(MEMBER, at):
            end, content = _unpack(data, at)
            why = "member is damaged"
            if content is not None:
                found = list(_within(content, at, end))
        elif data.startswith(b"WARC/", at):
            end, headers, block = read_record(data, at)
            if end > at:
                found = [("record", at, end, headers, block)]
            else:
                why = headers
        if end > at:
            if bad is not None:
                yield "gap", bad, at, reason
                bad = None
            yield from found
            at = end
            continue
        if bad is None:
            bad, reason = at, why
        at = _next_start(data, at + 1)
    if bad is not None:
        yield "gap", bad, len(data), reason


def _next_start(data: bytes, at: int) -> int:
    """The next place with a member that starts a record or with a version line; else the end."""
    line = VERSION_LINE.search(data, at)
    stop = line.start() if line else len(data)
    place = data.find(MEMBER, at, stop)
    while place >= 0 and not _starts_record(data, place):
        place = data.find(MEMBER, place + 1, stop)
    return place if place >= 0 else stop


def _within(content: bytes, start: int, end: int) -> Iterator[tuple]:
    """Records of a member's content; a failed one is a gap of the member's bytes."""
    at, reason = 0, None
    while at < len(content):
        stop, headers, block = read_record(content, at)
        if stop > at:
            yield "record", start, end, headers, block
            at = stop
        else:
            reason = reason or headers
            line = VERSION_LINE.search(content, at + 1)
            at = line.start() if line else len(content)
    if reason or not content:
        yield "gap", start, end, reason or "empty member"


READ_SCHEMA = ("path string, start long, end long, gap string, record_type string, record_id string, target_uri string, "
               "refers_to string, payload_digest string, payload_bytes long, payload binary")


def _named(value: str | None) -> str | None:
    if value is None:
        return None
    m = re.fullmatch(r"<urn:record:(.*)>", value, re.S)
    return m[1] if m else value.strip("<>")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record, and one per gap (gap holds its reason, then only path, start and end are set).

    start and end are byte offsets in the file; records of one member share them. Spark reads each
    file as one row, so files should be of some hundred megabytes at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for kind, start, end, about, *block in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((name.as_py(), start, end, about, *[None] * 7))
                        continue
                    digest = about.get("warc-payload-digest", "").partition(":")[2] or None
                    length = about.get("x-payload-length", about["content-length"])
                    rows.append((name.as_py(), start, end, None, about.get("warc-type"), _named(about.get("warc-record-id")),
                                 about.get("warc-target-uri"), _named(about.get("warc-refers-to")), digest,
                                 int(length) if length.isdecimal() else None, block[0] if with_payload else None))
                    size += len(block[0]) if with_payload else 256
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return read_bytes(spark, path).select("path", "content").mapInArrow(run, READ_SCHEMA)


# -- writing -----------------------------------------------------------------------------------


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
                   least_bytes: int = 0) -> None:
    """Writes one record per row.

    Of rows with equal payloads of at least `least_bytes` bytes the one of the greatest key is the
    response and the others are revisits of it (rows that share that key are all responses); a null
    key never refers to itself unless all are null. A null payload is empty. Only payload digests
    are gathered by key; records are packed before anything is moved.
    """
    key_type = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), F.col(payload).cast("binary").alias("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, members = [], [], []
            for k, u, p in zip(batch.column("key").to_pylist(), batch.column("uri").to_pylist(), batch.column("payload")):
                p = p.as_py() or b""
                digests.append(base32_sha1(p))
                sizes.append(len(p))
                members.append(member(record("response", k, u, digests[-1], len(p), p)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("uri"), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()),
                 pa.array(members, pa.binary())], ["key", "uri", "digest", "size", "member"])

    packed = durable(rows.mapInArrow(pack, f"key {key_type}, uri string, digest string, size long, member binary"))
    kept = durable(packed.where(F.col("size") >= least_bytes).groupBy("digest")
                   .agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("digest", "keep"))
    joined = (packed.join(kept, "digest", "left")
              .withColumn("revisit", F.col("keep").isNotNull() & ~F.col("key").eqNullSafe(F.col("keep"))))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("member").to_pylist()
            revisit = batch.column("revisit").to_pylist()
            about = batch.select(["key", "uri", "digest", "size", "keep"]).to_pylist() if any(revisit) else []
            for i, again in enumerate(revisit):
                if again:
                    a = about[i]
                    members[i] = member(record("revisit", a["key"], a["uri"], a["digest"], a["size"], b"", a["keep"]))
            yield pa.RecordBatch.from_arrays([pa.array(map(without_last_zero, members), pa.binary())], ["member"])

    write_bytes(joined.select("key", "uri", "digest", "size", "keep", "revisit", "member").mapInArrow(finish, "member binary"),
                "member", path, MAX_RECORDS)
