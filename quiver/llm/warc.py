"""WARC archives: writing with payload revisits, and a salvage reader.

Writing: pages with equal payloads of at least 100 bytes are found by digest;
the smallest page_id becomes a ``response`` record and the others ``revisit``
records that refer to it.  Each task packs its records, one gzip member each, into
archives of about 1 MB, which are rows (archive, content) of a written table;
files from elsewhere come in the same form from Spark's ``binaryFile`` source.

Reading: ``read_archives`` checks every record - the member's CRC, the version
line, header, length, and the block and payload digests.  After a failed check it
searches for the next gzip member or version line that reads as a whole valid
record, goes on there, and logs the bytes between as a quarantined gap with the
reason.  Inside a damaged member it does the same in the content inflated so far:
its valid records stay (at the member's offset), and each gap is logged with the
member's offset, the gap's bytes of content as its length, and ``in member`` with
the place in the content as its reason.  Damage to one record therefore costs that
record only; in a damaged member a record's own checks decide, and of a member of which the compressed data breaks off, what comes after
the break is lost up to the next member or version line.

Bounds: an archive is one row and is read in one task; hot payloads are joined
in 16 salted parts, and page bodies are shuffled only for pages that may be
revisits.

Defined cases: a null html is an empty payload; a null url leaves out the target; a
null page_id is written and read back as null and never revisited; rows that
repeat a page_id are records of their own, all of the smallest page_id being
responses; extra columns are ignored; no pages make no archives, and an
archive of no bytes has no records and no gaps.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C

MIN_REVISIT = 100
ARCHIVE_BYTES = 1 << 20
# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_MASK = (1 << 64) - 1


# ------------------------------------------------------------------- records

def record_id(page_id: int | None) -> str:
    """A urn:uuid that holds the page number (null: a number beyond 64 bits)."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 127) if page_id is None else page_id & _MASK)}>"


def page_of(value: str | None) -> int | None:
    digits = re.sub(r"[^0-9a-f]", "", (value or "").removeprefix("<urn:uuid:").lower())
    if len(digits) != 32 or int(digits, 16) > _MASK:
        return None
    n = int(digits, 16)
    return n - (1 << 64) if n >> 63 else n


def build_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION.decode(), f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers),
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def page_record(page_id, url, payload: bytes, refers_to) -> bytes:
    headers = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return build_record("response", headers, http + payload)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return build_record("revisit", headers, http)


# ------------------------------------------------------------ salvage reader

@dataclass
class Record:
    offset: int
    length: int
    kind: str
    headers: dict[str, str]
    block: bytes

    @property
    def http_length(self) -> int | None:
        """Content-Length of the HTTP header (for a revisit, of the payload it stands for)."""
        head = self.block.split(b"\r\n\r\n", 1)[0]
        m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return int(m[1]) if m else None

    @property
    def payload(self) -> bytes:
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Damaged(Exception):
    """``content``: what could be inflated of a gzip member, up to ``end``."""

    def __init__(self, reason: str, content: bytes = b"", end: int | None = None):
        super().__init__(reason)
        self.content, self.end = content, end


def parse_record(data: bytes, at: int) -> tuple[str, dict[str, str], bytes, int]:
    """(kind, headers, block, end) of the record at ``at``; raises Damaged."""
    if not _VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header not ended")
    headers: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", size):
        raise Damaged("bad content length")
    end = stop + 4 + int(size)
    if end > len(data):
        raise Damaged("truncated")
    block = data[stop + 4:end]
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record not closed")
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha256:") and told[7:].lower() != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest")
    kind = headers.get("warc-type", "")
    told = headers.get("warc-payload-digest", "")
    if kind == "response" and told.startswith("sha256:") and told[7:].lower() != hashlib.sha256(Record(0, 0, kind, headers, block).payload).hexdigest():
        raise Damaged("payload digest")
    return kind, headers, block, end + 4


def inflate(data: bytes, at: int, limit: int = 1 << 30) -> tuple[bytes, int]:
    """(content, end) of the gzip member at ``at``; raises Damaged with the content inflated so far."""
    d, view, out, pos, size = zlib.decompressobj(31), memoryview(data), [], at, 0
    try:
        while not d.eof:
            if pos >= len(data):
                raise Damaged("truncated member", b"".join(out), len(data))
            part = view[pos:pos + 65536]
            out.append(d.decompress(part, limit - size + 1))
            size += len(out[-1])
            if size > limit or d.unconsumed_tail:
                raise Damaged("member too large", b"".join(out), pos + len(part) - len(d.unconsumed_tail))
            pos += len(part)
    except zlib.error as e:
        # once more, the failed part byte by byte up to the damage
        d, end = zlib.decompressobj(31), pos
        for k in range(at, pos, 65536):
            d.decompress(view[k:k + 65536])
        try:
            while True:
                out.append(d.decompress(view[end:end + 1]))
                end += 1
        except zlib.error:
            pass
        crc = "check" in str(e)
        if crc:  # the content is complete; damaged is the trailer, or what it tells of
            end -= 7 if "length" in str(e) else 3
        raise Damaged(f"gzip: {'crc' if crc else 'data'}", b"".join(out), end) from e
    return b"".join(out), pos - len(d.unused_data)


def _in_member(content: bytes, at: int, length: int, reason: str = "") -> tuple[list[Record | Gap], bool]:
    """Valid records of a member's content and the gaps between them, and whether there was a record.

    ``reason``: why the content ends early; then what is left at its end is a gap for it."""
    found, pos, lost, why, some = [], 0, None, "", False
    while pos < len(content):
        try:
            kind, headers, block, end = parse_record(content, pos)
        except Damaged as e:
            if lost is None:
                lost, why = pos, str(e)
            m = _VERSION_LINE.search(content, pos + 1)
            pos = m.start() if m else len(content)
            continue
        if lost is not None:
            found.append(Gap(at, pos - lost, f"in member at {lost}: {why}"))
            lost = None
        found.append(Record(at, length, kind, headers, block))
        pos, some = end, True
    if lost is not None:
        found.append(Gap(at, pos - lost, f"in member at {lost}: {reason or why}"))
    return found, some


def _valid_at(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """Records of the member or plain record at ``at``, and where it ends; raises Damaged.

    A whole member with some valid record is returned with its inner gaps."""
    if data[at:at + 2] == b"\x1f\x8b":
        content, end = inflate(data, at)
        found, some = _in_member(content, at, end - at)
        if not some:
            raise Damaged(found[0].reason.partition(": ")[2] if found else "empty member")
        return found, end
    kind, headers, block, end = parse_record(data, at)
    return [Record(at, end - at, kind, headers, block)], end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive, and the byte gaps between them and inside members."""
    at, lost, reason = 0, None, ""
    while at < len(data):
        try:
            records, end = _valid_at(data, at)
        except Damaged as e:
            end = at + 1 if e.end is None else e.end
            inner, some = _in_member(e.content, at, end - at, str(e))
            if some:  # the records before the damage; the search goes on behind it
                if lost is not None:
                    yield Gap(lost, at - lost, reason)
                yield from inner
                if end == len(data) and not isinstance(inner[-1], Gap):
                    yield Gap(end, 0, str(e))
                lost, reason = end, str(e)
            elif lost is None:
                lost, reason = at, str(e)
            m = _NEXT.search(data, end if some else at + 1)
            at = m.start() if m else len(data)
            continue
        if lost is not None:
            if at > lost:
                yield Gap(lost, at - lost, reason)
            lost = None
        yield from records
        at = end
    if lost is not None and lost < len(data):
        yield Gap(lost, len(data) - lost, reason)


# ------------------------------------------------------------------- Spark

def revisits(pages: DataFrame, least_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload an earlier page has."""
    facts = C.written(pages.select("page_id", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("digest")), "payloads")
    long = facts.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull())
    shared = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    salts = 16
    spread = shared.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    found = long.withColumn("salt", F.pmod("page_id", F.lit(salts)).cast("int")).join(spread, ["digest", "salt"])
    return C.written(found.where("page_id > refers_to").select("page_id", "refers_to").distinct(), "revisits")


ARCHIVES = "archive string, content binary"


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A written table of archives (archive, content) with a record per row of ``pages`` (page_id, url, html)."""
    C.prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = revisits(pages)
    near, alone = C.split_by(pages, again, "page_id")
    rows = alone.withColumn("refers_to", F.lit(None).cast("long")).unionByName(
        near.join(again, "page_id", "left").select("page_id", "url", "html", "refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            name = f"part-{part:06d}-{k:06d}.warc.gz"
            info = build_record("warcinfo", [("WARC-Record-ID", record_id(None)), ("WARC-Date", "1970-01-01T00:00:00Z"),
                                             ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([member(info), *parts])], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                parts.append(member(page_record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield flush()
                    k, parts, size = k + 1, [], 0
        if parts:
            yield flush()

    return C.written(rows.mapInArrow(pack, ARCHIVES), "warc")


RECORDS = ("archive string, offset long, length long, gap boolean, reason string, record_type string, record_id string, target_uri string, "
           "refers_to string, payload_bytes long, payload_digest string, payload binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record and one per quarantined gap (``gap`` true, with offset,
    length and reason) of a table (archive, content).

    payload_bytes and payload_digest are of the full payload: a response's own,
    counted anew; a revisit's as its header tells (the digest, and the length in
    its HTTP header)."""

    def row(name: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return name, x.offset, x.length, True, x.reason, None, None, None, None, None, None, None
        h, body = x.headers, x.payload
        size, digest = len(body), hashlib.sha256(body).hexdigest()
        if x.kind == "revisit":
            size, digest = x.http_length, h.get("warc-payload-digest", "").removeprefix("sha256:") or None
        return (name, x.offset, x.length, False, None, x.kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"),
                size, digest, body if payloads else None)

    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(),
             pa.string(), pa.binary()]
    names = [c.strip().split(" ")[0] for c in RECORDS.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content")):
                rows = [row(name.as_py(), x) for x in salvage(content.as_py() or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.select(F.col("archive").cast("string").alias("archive"), F.col("content").cast("binary").alias("content")).mapInArrow(read, RECORDS)


def _page(column: str):
    """The page number in a record id, in the JVM; null for ids that hold none."""
    digits = F.regexp_replace(F.regexp_extract(column, r"urn:uuid:([0-9a-fA-F-]{36})", 1), "-", "")
    high, low = F.substr(digits, F.lit(1), F.lit(16)), F.substr(digits, F.lit(17), F.lit(16))
    # -10: read the unsigned 64-bit number as a signed one
    return F.when(high == "0" * 16, F.conv(low, 16, -10).cast("long"))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives and read back, one row per page."""
    found = read_archives(write_archives(C.table(spark, sf_dir, "pages")), payloads=False)
    return found.where("not gap and record_type in ('response', 'revisit')").select(
        _page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
g AS (SELECT digest, min(page_id) AS least FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least < page_id THEN least END AS refers_to
FROM d LEFT JOIN g ON d.digest = g.digest AND d.n >= 100
"""
