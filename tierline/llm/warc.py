"""Legacy archive converter: ARC files, version 1 or 2, to equivalent WARC files.

An ARC file opens with a ``filedesc://`` record whose body names the version; version 1 has five fields on a record's
header line and version 2 ten, the last of them the declared length of what follows. Files may be plain, or gzip with
any number of records in a member; WARC files are written with one member for each record. Each record becomes a WARC record with an identifier, a timestamp, a type, and digests of
payload and block; the file's own record becomes ``warcinfo``. Of records with equal payloads of at least
``LEAST_BYTES`` one is a response, that with the smallest page id (then by its place); the others revisit it.

Payloads are not shuffled: digests meet in an aggregate with map-side combine, and each archive gets back only the
places of its revisits. Archives hold about ``ARCHIVE_BYTES`` unpacked (one record at least), are written and read by Spark, so
any store will do, and are rebuilt by their own task if lost.

Defined results: a null html is an empty payload; a null url is written as ``-``, blanks and control characters in a url
are percent-encoded; a null page id stays null and sorts last; repeated rows are records of their own. A declared
length that runs past the data, or an unknown version, is an error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, scratch_dir

ARCHIVE_BYTES = 8 << 20
LEAST_BYTES = 100
#: Fixed field lists of both versions.
FIELDS = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of a revisit whose payload is identical.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = b"20010101000000"
#: An empty gzip member without its last byte, which is 0; the writer's line end supplies it.
_LAST_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()[:-1]


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(blobs: DataFrame, path: str) -> None:
    """Each row's ``blob`` (gzip members) as one file. The text writer passes bytes on as they are; its line end is byte 0."""
    closed = F.concat("blob", F.lit(_LAST_MEMBER)).cast("string").alias("value")
    blobs.select(closed).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def buffers(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset in the unpacked file, bytes) of each gzip member, or the whole of a plain file."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    view, at, begin = memoryview(data), 0, 0
    while at < len(view):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            piece = view[at : at + (1 << 16)]
            if not len(piece):
                raise ValueError("a gzip member ends early")
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        unpacked = b"".join(out)
        yield begin, unpacked
        begin += len(unpacked)


class ArcRecord(NamedTuple):
    offset: int
    version: bytes
    url: bytes
    ip: bytes
    date: bytes
    mime: bytes
    body: bytes

    def http(self) -> tuple[bytes, bytes]:
        """Header lines with their blank line, and payload."""
        head, gap, payload = self.body.partition(b"\r\n\r\n")
        return (head + gap, payload) if gap else (b"", self.body)


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    version = None
    for offset, buffer in buffers(data):
        at = 0
        while at < len(buffer):
            if buffer[at : at + 1] in b"\r\n":  # records are set apart by line ends
                at += 1
                continue
            begin, end = at, buffer.index(b"\n", at)
            fields = buffer[at:end].rstrip(b"\r").split(b" ")
            length, at = int(fields[-1]), end + 1
            if at + length > len(buffer):
                raise ValueError(f"the declared length {length} runs past the data")
            body = buffer[at : at + length]
            if fields[0].startswith(b"filedesc://"):
                version = body.split(b" ", 1)[0]
                if version not in FIELDS:
                    raise ValueError(f"unknown version {version!r}")
            elif version is None or len(fields) != len(FIELDS[version].split()):
                raise ValueError("a header line does not fit its version")
            yield ArcRecord(offset + begin, version, *fields[:4], body)
            at += length


def record_id(page_id: int | None, salt: bytes) -> str:
    """A version 8 UUID that holds the page id (or its absence) and 57 bits of a digest of the record's place."""
    low = hashlib.sha256(salt).digest()
    number = ((page_id or 0) & (1 << 64) - 1) << 57 | int.from_bytes(low[:8]) >> 7
    bits = (page_id is None) << 121 | number  # 122 free bits
    value = (bits >> 74) << 80 | 8 << 76 | ((bits >> 62) & 0xFFF) << 64 | 2 << 62 | bits & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(identifier: str) -> int | None:
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    bits = (value >> 80) << 74 | ((value >> 64) & 0xFFF) << 62 | value & (1 << 62) - 1
    page = (bits >> 57) & (1 << 64) - 1
    return None if bits >> 121 else page - (page >> 63 << 64)


def timestamp(date: bytes) -> str:
    """14 digits (or fewer, filled from the left) as a WARC date."""
    d = date.decode().ljust(14, "0")
    return f"{d[:4]}-{max(d[4:6], '01')}-{max(d[6:8], '01')}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) by declared lengths."""
    for _, buffer in buffers(data):
        at = 0
        while at < len(buffer):
            end = buffer.index(b"\r\n\r\n", at)
            lines = buffer[at:end].decode("utf-8", "surrogatepass").split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            at = end + 4
            length = int(headers["Content-Length"])
            if at + length + 4 > len(buffer):
                raise ValueError("a block ends early")
            yield headers, buffer[at : at + length]
            at += length + 4


def _header(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb": ?([^\r\n]*)", head)
    return found and found[1]


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """``pages`` (page_id, url, html) as ARC files, each task's by turns of version 1 and 2."""

    def pack(batches):
        number, parts, size = 0, [], 0
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = b"12"[number % 2 : number % 2 + 1]
                if not parts:
                    text = version + b" 0 pages\n" + FIELDS[version] + b"\n\n"
                    line = [b"filedesc://pages.arc", b"0.0.0.0", DATE, b"text/plain", *_more(version), b"%d" % len(text)]
                    parts, size = [b" ".join(line) + b"\n" + text], 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                name = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                head = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + name
                body = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
                target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "-").encode("utf-8", "surrogatepass"))
                line = [target or b"-", b"0.0.0.0", DATE, b"text/html", *_more(version), b"%d" % len(body)]
                parts.append(b" ".join(line) + b"\n" + body + b"\n")
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"blob": [gzip_member(b"".join(parts), 4)]})
                    number, parts = number + 1, []
        if parts:
            yield pa.RecordBatch.from_pydict({"blob": [gzip_member(b"".join(parts), 4)]})

    write_archives(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(pack, "blob binary"), path)


def _more(version: bytes) -> list[bytes]:
    return [b"200", b"-", b"-", b"0", b"pages.arc"] if version == b"2" else []


PLACED = "path string, offset long, page_id long, digest binary, bytes long"


def payload_digests(archives: DataFrame) -> DataFrame:
    """(path, offset, page_id, digest, bytes) of each document record of ARC archives (path, content)."""

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for r in arc_records(content.as_py()):
                    if not r.url.startswith(b"filedesc://"):
                        head, payload = r.http()
                        page = _header(head, b"X-Page-Id")
                        rows.append((path, r.offset, page and int(page), hashlib.sha256(payload).digest(), len(payload)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _PLACED_TYPES, strict=True)],
                    ["path", "offset", "page_id", "digest", "bytes"],
                )

    return archives.select("path", "content").mapInArrow(parse, PLACED)


_PLACED_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]


def convert(spark: SparkSession, arc: str, out: str, least: int = LEAST_BYTES) -> None:
    """Convert the ARC files at ``arc`` to WARC files at ``out``, one for one."""
    archives = read_archives(spark, arc)
    placed = cut_lineage(payload_digests(archives), "digests").where(F.col("bytes") >= least)
    place = F.struct(F.col("page_id").isNull().alias("late"), "page_id", "path", "offset").alias("place")
    first = placed.select("digest", place).groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = (
        placed.join(first, "digest")
        .where("NOT (path = first.path AND offset = first.offset)")
        .groupBy("path")
        .agg(F.collect_list(F.struct("offset", F.col("first.page_id"), F.col("first.path").alias("of"), F.col("first.offset").alias("at"))).alias("again"))
    )  # at most as many entries as the archive has records

    def rewrite(batches):
        for batch in batches:
            for path, content, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                refers = {x["offset"]: x for x in again or ()}
                parts = [gzip_member(w) for w in map(lambda r: _as_warc(r, path, refers), arc_records(content.as_py()))]
                yield pa.RecordBatch.from_pydict({"blob": pa.array([b"".join(parts)], pa.binary())})

    write_archives(archives.join(again, "path", "left").select("path", "content", "again").mapInArrow(rewrite, "blob binary"), out)


def _as_warc(r: ArcRecord, path: str, refers: dict[int, dict]) -> bytes:
    place = lambda p, offset: f"{p}:{offset}".encode()
    block_digest = lambda block: ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest())
    if r.url.startswith(b"filedesc://"):
        info = b"software: ARC converter\r\nformat: WARC File Format 1.0\r\narc-version: " + r.version + b"\r\n"
        headers = [("WARC-Record-ID", record_id(None, place(path, r.offset))), ("WARC-Date", timestamp(r.date))]
        return warc_record("warcinfo", [*headers, ("Content-Type", "application/warc-fields"), block_digest(info)], info)
    head, payload = r.http()
    page = _header(head, b"X-Page-Id")
    headers = [
        ("WARC-Record-ID", record_id(page and int(page), place(path, r.offset))),
        ("WARC-Date", timestamp(r.date)),
        ("WARC-Target-URI", r.url.decode("utf-8", "surrogatepass")),
        ("WARC-IP-Address", r.ip.decode()),
        ("Content-Type", "application/http; msgtype=response" if head else r.mime.decode()),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
    ]
    if (to := refers.get(r.offset)) is None:
        return warc_record("response" if head else "resource", [*headers, block_digest(r.body)], r.body)
    headers += [("WARC-Refers-To", record_id(to["page_id"], place(to["of"], to["at"]))), ("WARC-Profile", PROFILE)]
    return warc_record("revisit", [*headers, block_digest(head)], head)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each document record.

    The digest and length of a response are taken from its payload, and the digest must equal the header's; a revisit's
    are those that its headers give.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [x for h, block in warc_records(content.as_py()) if (x := _read(h, block))]
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    return read_archives(spark, path).select("content").mapInArrow(parse, schema)


def _read(headers: dict[str, str], block: bytes):
    kind = headers["WARC-Type"]
    if kind == "warcinfo":
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    page, stated = _header(head, b"X-Page-Id"), headers["WARC-Payload-Digest"].partition(":")[2]
    page = page and int(page)
    if kind == "revisit":
        return page, headers["WARC-Target-URI"], int(_header(head, b"Content-Length")), stated, kind, page_of(headers["WARC-Refers-To"])
    if (digest := hashlib.sha256(payload).hexdigest()) != stated:
        raise ValueError("a payload does not have its digest")
    return page, headers["WARC-Target-URI"], len(payload), digest, kind, None


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as legacy archives, convert them, and read the WARC files back."""
    spark = pages.sparkSession
    arc, out = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, out)
    return read_warc(spark, out)
