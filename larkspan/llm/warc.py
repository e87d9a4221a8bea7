"""Legacy ARC archives to WARC: version-specific header lines, declared lengths, synthesised WARC fields.

Archives are written and listed by Spark alone, so they can lie in any store it reaches. A record is one row
of the text writer, whose line separator is the end of a record; bytes are never decoded. Files are read
back whole as compressed bytes and inflated record by record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import pick

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"

CAPTURED = "20200101000000"
# Records of one Arrow batch hold at most about this many bytes of payload.
BATCH_BYTES = 8 << 20

_ARC = "record_id string, uri string, ip string, date string, page_id long, head binary, payload binary, payload_bytes long, digest string"
_WARC = "record_id string, type string, refers_to_id string, page_id long, payload_bytes long, digest string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), captured: str = CAPTURED) -> None:
    """Write (page_id, url, html) as gzipped ARC files, one a partition, the versions taking turns.

    The content block is an HTTP response whose payload is the UTF-8 html (NULL: empty) and whose headers
    hold the page id, unless it is NULL. White space and control characters of a URL are percent-encoded; a
    NULL or empty URL becomes ``about:blank``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        version = versions[number % len(versions)]
        name = f"pages-{number:05d}.arc"
        about = f"{version} 0 converter\n{ARC_FIELDS[version]}\n".encode()
        position = 0

        def line(url: str, ip: str, mime: str, length: int) -> bytes:
            more = "" if version == 1 else f" 200 - - {position} {name}"
            return f"{url} {ip} {captured} {mime}{more} {length}\n".encode()

        opening = line(f"filedesc://{name}", "0.0.0.0", "text/plain", len(about)) + about
        position += len(opening) + 1
        out = [opening]
        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html")), strict=True):
                url = re.sub(r"[\s\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
                payload = (html or "").encode()
                known = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n"
                block = head.encode() + payload
                out.append(line(url or "about:blank", "0.0.0.0", "text/html", len(block)) + block)
                position += len(out[-1]) + 1
                if len(out) >= 500:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])
                    out = []
        yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    records = pick(pages, id="page_id", url="url", html="html").select(F.col("id").cast("long"), "url", "html")
    lines = records.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Source:
    """Lines and byte counts of an archive that is inflated as it is read; gzip members may follow one another."""

    def __init__(self, content: bytes, step: int = 1 << 20):
        self._parts, self._held, self._read, self.at = self._inflate(content, step), b"", 0, 0

    @staticmethod
    def _inflate(content: bytes, step: int) -> Iterator[bytes]:
        if content[:2] != b"\x1f\x8b":
            yield from (content[i : i + step] for i in range(0, len(content), step))
            return
        while content:
            stream = zlib.decompressobj(31)
            while not stream.eof:
                part = stream.decompress(content, step)
                if not part and not stream.unconsumed_tail and not stream.eof:
                    raise ValueError("the archive ends within a gzip member")
                yield part
                content = stream.unconsumed_tail
            content = stream.unused_data

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (end := self._held.find(b"\n", self._read)) < 0:
            part = next(self._parts, None)
            self._held, self._read = self._held[self._read :] + (part or b""), 0
            if part is None:
                rest, self._held = self._held, b""
                self.at += len(rest)
                return rest or None
        out = self._held[self._read : end]
        self.at += end + 1 - self._read
        self._read = end + 1
        return out.removesuffix(b"\r")

    def take(self, count: int) -> bytes:
        self.at += count
        if len(self._held) - self._read >= count:
            self._read += count
            return self._held[self._read - count : self._read]
        parts = [self._held[self._read :]]
        missing = count - len(parts[0])
        while missing > 0:
            part = next(self._parts, None)
            if part is None:
                raise ValueError(f"a record declares {count} bytes, {count - missing} are left")
            parts.append(part[:missing])
            self._held, self._read = part, min(missing, len(part))
            missing -= len(part)
        return b"".join(parts)


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record after the version block; the fields are those that it names."""
    source = _Source(content)
    opening = source.line()
    if opening is None:
        return
    about = source.take(int(opening.rsplit(b" ", 1)[1])).decode().split("\n")
    fields = ARC_FIELDS.get(int(about[0].split(" ")[0]))
    if fields is None or about[1].strip() != fields:
        raise ValueError(f"unknown ARC version block: {about[:2]}")
    names = fields.split(" ")
    while True:
        start = source.at
        line = source.line()
        if line is None:
            return
        if not line:
            continue  # the line end between records
        values = line.decode().split(" ")
        if len(values) != len(names):
            raise ValueError(f"an ARC header line of {len(values)} fields instead of {len(names)} at {start}")
        record = dict(zip(names, values, strict=True))
        yield start, record, source.take(int(record["Archive-length"]))


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def _page_id(head: bytes) -> int | None:
    found = re.search(rb"^X-Page-Id: (-?\d+)\r$", head, re.M)
    return int(found[1]) if found else None


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_at: int | None) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[size_at] or b"") if size_at is not None else 100
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of ARC files of either version with the WARC fields synthesised from them.

    The id is a UUID of the file's name and the record's offset, the date the ISO form of the ARC date, the
    digest the base32 SHA-1 of the payload. Without ``payloads`` the two binary columns are NULL.
    """
    schema = pa.schema([("record_id", pa.string()), ("uri", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = file.as_py().rsplit("/", 1)[-1]
                for offset, field, block in arc_records(content.as_py()):
                    head, payload = _split_http(block)
                    when = field["Archive-date"].ljust(14, "0")[:14]
                    yield (
                        f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}",
                        field["URL"],
                        field["IP-address"],
                        f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:14]}Z",
                        _page_id(head),
                        head if payloads else None,
                        payload if payloads else None,
                        len(payload),
                        digest_of(payload),
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _batches(rows(batches), schema, 6), _ARC)


def write_warc(spark: SparkSession, arc_path: str, path: str, min_bytes: int = 0) -> None:
    """Convert ARC files to gzipped WARC files.

    Of records with equal payloads of at least ``min_bytes`` bytes that with the largest page id (NULL: the
    smallest, ties to the larger record id) is a response, the others are revisits that refer to it.
    """
    latest = (
        read_arc(spark, arc_path, payloads=False)
        .where(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "record_id", "uri", "date")).alias("latest"))
    )
    joined = read_arc(spark, arc_path).join(latest, "digest", "left")
    revisit = F.col("latest").isNotNull() & (F.col("latest.record_id") != F.col("record_id"))
    head = F.col("head").cast("string")
    payload = F.col("payload").cast("string")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    angled = lambda value: F.concat(F.lit("<"), value, F.lit(">"))
    refers = F.concat(
        line("WARC-Refers-To", angled(F.col("latest.record_id"))),
        line("WARC-Refers-To-Target-URI", F.col("latest.uri")),
        line("WARC-Refers-To-Date", F.col("latest.date")),
        F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"),
    )
    length = F.octet_length("head") + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    record = F.concat(
        F.lit(f"{WARC_VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", angled(F.col("record_id"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        head,
        F.when(revisit, F.lit("")).otherwise(payload),
    )
    joined.select(record.alias("value")).write.option("lineSep", WARC_END).option("compression", "gzip").text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    source = _Source(content)
    while (version := source.line()) is not None:
        if not version:
            continue  # the ends of the record before
        if version != WARC_VERSION.encode():
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {}
        while line := source.line():
            name, _, value = line.decode().partition(": ")
            headers[name.lower()] = value
        yield headers, source.take(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; the digest of a response is taken anew and must equal the declared one."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in warc_records(content.as_py()):
                    head, payload = _split_http(block)
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
                    refers = headers.get("warc-refers-to")
                    yield (
                        headers["warc-record-id"][1:-1], kind, refers[1:-1] if refers else None, _page_id(head),
                        len(payload) if kind == "response" else None, digest,
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _batches(rows(batches), schema, None), _WARC)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload size of what a revisit refers to, and the page id of that response."""
    responses = records.where("type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full")
    )
    return records.join(responses, "refers_to_id", "left").select(
        "record_id", "page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "digest", "type", "refers_to"
    )
