"""WARC archives: a writer with deduplicated payloads and a salvage reader.

Archives are gzip files of one member for each record. They are kept as rows of
bytes in a table (any store that Spark writes will do) or read as files.

The reader checks every member (gzip's own checksum, the version line, header
lines, the announced length) and the digests that a record states, in hexadecimal
or base32: the block's, and the payload's, which in an HTTP response is what
follows the HTTP header. After a failed check it searches for the next place
where a member or, in a plain archive, a version line is valid, goes on from
there, and logs the bytes between as a quarantined gap. No byte is lost silently:
records and gaps together cover the archive. Members are inflated window by
window, so that reading takes time in proportion to the archive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import common

#: An archive is closed when it has so many bytes, so that a reader's memory is bounded.
ARCHIVE_BYTES = 4 << 20
#: Bytes of an archive that are inflated at a time; a record may inflate to so many.
WINDOW, MAX_RECORD = 1 << 16, 1 << 30
#: Header lines end within so many bytes.
MAX_HEAD = 1 << 20
#: Rows and bytes handed on at a time.
OUT_ROWS, OUT_BYTES = 200, 8 << 20
#: Payloads of at least so many bytes are written once.
MIN_REVISIT = 1000
LEVEL = 3
_MAGIC = b"\x1f\x8b\x08"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass
class Record:
    """One record: where it is, its header lines and its block."""

    offset: int
    length: int
    version: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


@dataclass
class Gap:
    """Bytes that no valid record holds, and the check that failed at their start."""

    offset: int
    length: int
    reason: str


class Broken(ValueError):
    pass


def _clean(value: str) -> str:
    return " ".join(value.split())


def write_record(record_type: str, uri: str, headers: dict[str, str], block: bytes) -> bytes:
    """A record as one gzip member; header values lose their line breaks."""
    head = {"WARC-Type": record_type, "WARC-Target-URI": uri, **headers, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head.items() if v != "")
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The plain record at ``at`` and the offset behind it."""
    if data[at : at + 5] != b"WARC/":
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n", at, at + MAX_HEAD)
    if end < 0:
        raise Broken("headers without end")
    version, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not version[5:].replace(".", "").isdigit():
        raise Broken("bad version")
    headers: dict[str, str] = {}
    for line in lines:
        name, sep, value = line.partition(":")
        if not sep:
            raise Broken("bad header line")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise Broken("no content length")
    start = end + 4
    stop = start + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("block without its end")
    return Record(at, stop + 4 - at, version, headers, data[start:stop]), stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and the offset behind the member."""
    unpack, view = zlib.decompressobj(31), memoryview(data)
    parts, size, here = [], 0, at
    while not unpack.eof:
        if here >= len(data):
            raise Broken("gzip member without end")
        window = view[here : here + WINDOW]
        here += len(window)
        try:
            part = unpack.decompress(window, MAX_RECORD - size + 1)
        except zlib.error as e:
            raise Broken("damaged gzip member") from e
        parts.append(part)
        size += len(part)
        if size > MAX_RECORD:
            raise Broken("record too large")
    return b"".join(parts), here - len(unpack.unused_data)


def _member(data: bytes, at: int) -> tuple[Record, int]:
    """The record of the gzip member at ``at`` and the offset behind the member."""
    plain, stop = _inflate(data, at)
    record, end = _parse(plain, 0)
    if end != len(plain):
        raise Broken("bytes behind the record")
    record.offset, record.length = at, stop - at
    return record, stop


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that can be read, and the gaps between them, in order."""
    at = lost = 0
    reason = ""
    # where the next member and the next version line may begin; each byte is searched once for either
    ahead = {_MAGIC: -1, b"WARC/": -1}
    while at < len(data):
        try:
            record, end = _member(data, at) if data[at : at + 3] == _MAGIC else _parse(data, at)
        except (Broken, UnicodeDecodeError) as e:
            reason = reason or (str(e) if isinstance(e, Broken) else "headers are not UTF-8")
            for mark, place in ahead.items():
                if place <= at:
                    found = data.find(mark, at + 1)
                    ahead[mark] = found if found >= 0 else len(data)
            at = min(ahead.values())
            continue
        if at > lost:
            yield Gap(lost, at - lost, reason)
        reason = ""
        yield record
        at = lost = end
    if len(data) > lost:
        yield Gap(lost, len(data) - lost, reason)


def payload_of(record: Record) -> tuple[bytes | None, bytes]:
    """(HTTP header or None, payload): an HTTP message's payload follows its header."""
    if not record.headers.get("content-type", "").lower().startswith("application/http"):
        return None, record.block
    head, _, body = record.block.partition(b"\r\n\r\n")
    return head, body


def _dechunked(head: bytes, body: bytes) -> bytes | None:
    """The body without the framing of ``Transfer-Encoding: chunked``; None if it has none."""
    if b"chunked" not in head.lower():
        return None
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 64)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return None
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def stated_digest(value: str | None) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of ``algorithm:hex`` or ``algorithm:base32``; None if nothing is stated.

    A value that is neither comes back as it is, and equals no digest.
    """
    name, sep, said = (value or "").strip().partition(":")
    name = name.lower().replace("-", "")
    if not sep:
        return None
    size = hashlib.new(name).digest_size if name in ("md5", "sha1", "sha256", "sha512") else 0
    if size and len(said) != 2 * size:
        try:
            said = base64.b32decode(said.upper() + "=" * (-len(said) % 8)).hex()
        except (binascii.Error, ValueError):
            pass
    return name, said.lower()


def _agrees(stated: tuple[str, str] | None, *contents: bytes | None) -> bool:
    """Whether one of the contents has the stated digest; an unknown algorithm can't be checked."""
    if stated is None or stated[0] not in ("md5", "sha1", "sha256", "sha512"):
        return True
    return any(hashlib.new(stated[0], c).hexdigest() == stated[1] for c in contents if c is not None)


def roles(pages: DataFrame) -> DataFrame:
    """``page_id, payload`` with digest, payload_bytes and refers_to.

    Of records with equal payloads of MIN_REVISIT bytes or more, that with the
    largest id is the response; the others revisit it.
    """
    known = pages.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    long_ = known.where((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct()
    last = long_.groupBy("digest").agg(F.max("page_id").alias("response"), F.min("page_id").alias("first")).where("response > first")
    last = common.materialise(last.select("digest", "response"), "responses")
    # ids and digests only: payloads are not dealt out by digest, of which one may be frequent
    revisits = long_.join(last, "digest").where("page_id <> response").select("page_id", "digest", F.col("response").alias("refers_to"))
    revisits = common.materialise(revisits, "revisits")
    return known.join(revisits, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, path: str, url: str = "url", html: str = "html", id_col: str = "page_id") -> None:
    """Archive every row of ``pages``; rows (archive_id, content) are written to ``path``.

    A null html is an empty payload. A null id is archived as a response without an
    id. Repeated rows are all archived; equal payloads under one id are all responses.
    A very long html is one record. An empty table writes no archive. Extra columns
    are ignored.
    """
    common.small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(common.quoted(html)).cast("string"), F.lit("")).cast("binary")
    rows = roles(pages.select(F.col(common.quoted(id_col)).cast("long").alias("page_id"), F.coalesce(F.col(common.quoted(url)).cast("string"), F.lit("")).alias("url"), payload.alias("payload")))
    # a revisit carries no payload
    rows = rows.select("page_id", "url", "digest", "payload_bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def pack(batches):
        parts: list[bytes] = []
        size = 0
        for b in batches:
            for page, uri, digest, n, refers, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head = {
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}:{digest}')}>",
                    "WARC-Payload-Digest": f"sha1:{digest}",
                    "X-Page-ID": "" if page is None else str(page),
                    "X-Payload-Length": str(n),
                }
                if refers is None:
                    parts.append(write_record("response", uri, head | {"Content-Type": "text/html; charset=utf-8"}, block))
                else:
                    head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{refers}:{digest}')}>", "X-Refers-To-Page": str(refers)}
                    parts.append(write_record("revisit", uri, head, b""))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive(parts)
                    parts, size = [], 0
        if parts:
            yield archive(parts)

    def archive(parts):
        content = b"".join(parts)
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest()]), pa.array([content], pa.binary())], ["archive_id", "content"])

    # the bytes are compressed already
    rows.mapInArrow(pack, "archive_id string, content binary").write.option("compression", "uncompressed").parquet(path)


_READ = "archive_id string, offset long, length long, gap string, record_type string, uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, http_head string, payload binary"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record and each gap of ``archives(archive_id, content)``.

    ``gap`` is null for a record, else the check that failed. A response's length and
    SHA-1 are those of the payload that was read, without the HTTP header, which comes
    apart; a record that doesn't match a digest that it states is a gap ("block
    digest", "payload digest"). A null or empty archive has no rows, repeated
    archives are each read. A worker holds one archive and one record at a time, so
    archives have to fit in a worker's memory.
    """

    def run(batches):
        for b in batches:
            for name, content in zip(*b.columns, strict=True):
                rows, size = [], 0
                for x in salvage(content.as_py() or b""):
                    rows.append(_row(name.as_py(), x))
                    size += len(rows[-1][-1] or b"")
                    if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                        yield told(rows)
                        rows, size = [], 0
                if rows:
                    yield told(rows)

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [f.split()[0] for f in _READ.split(", ")])

    common.small_batches(archives.sparkSession)
    return archives.select("archive_id", "content").mapInArrow(run, _READ)


def _number(value: str | None) -> int | None:
    try:
        return int(value) if value else None
    except ValueError:
        return None


def _row(name: str, x: Record | Gap) -> tuple:
    def gap(reason):
        return name, x.offset, x.length, reason, None, None, None, None, None, None, None, None

    if isinstance(x, Gap):
        return gap(x.reason)
    h = x.headers
    kind, said = h.get("warc-type"), stated_digest(h.get("warc-payload-digest"))
    if not _agrees(stated_digest(h.get("warc-block-digest")), x.block):
        return gap("block digest")
    head, payload = payload_of(x)
    digest, size = said[1] if said else "", _number(h.get("x-payload-length"))
    if kind == "response":
        if not _agrees(said, payload, _dechunked(head, payload) if head else None):
            return gap("payload digest")
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return name, x.offset, x.length, None, kind, h.get("warc-target-uri"), _number(h.get("x-page-id")), size, digest, _number(h.get("x-refers-to-page")), None if head is None else head.decode("latin-1"), payload


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of the ``.warc`` and ``.warc.gz`` files under a path.

    A file is read whole by one task, as gzip can't be entered in the middle: files
    have to fit in a worker's memory and stay under Spark's limit of 2 GiB a value.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read_archives(files.select(F.col("path").alias("archive_id"), "content"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives and read back."""
    path = common.scratch(spark, "archives")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    read = read_archives(spark.read.schema("archive_id string, content binary").parquet(path)).where("gap is null")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN last END AS refers_to
FROM m
"""
