"""Legacy web archives to WARC: ARC headers in, WARC/1.1 records out, and both ends of it as files.

An ARC archive is a filedesc record, whose version block names version 1 or 2 and its header fields, then records: a
header line, as many bytes as its last field declares, and a line break. Version 1 lines are
"URL IP date type length"; version 2 lines are "URL IP date type result-code checksum location offset filename length".
Lengths decide where a record ends, never its content.

The converter makes for each record the WARC identifier (a name-based UUID of URL, date and payload digest), date
(14 digits to ISO 8601), type and digests (SHA-1 of payload and block). What came over HTTP, or from no named place, is a
response: its block is an HTTP head of the ARC's result code and content type, and the payload. Other schemes give a resource
of the ARC's content type, and a payload that is kept elsewhere a revisit, which names the identifier, URL and date of that
record. The filedesc record becomes a warcinfo record at the head of each file.

A WARC file here is a text row of Spark's: gzip members, one a record (more where a record is over MEMBER bytes), whose last
byte, always zero, is the line separator. So Spark's committer writes the files to any store, a lost task is simply run
again, and binaryFile reads them back. A file has at most FILE_BYTES, or one longer record.

Defined cases: a null or empty html is an empty payload; a null URL is written as "-"; rows of equal page_id give a record
each, and those that are equal in URL and payload as well are one capture and share their identifier; a null page_id is
written and read back as null; an empty table gives no archive rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, new_path, small_batches

#: Payloads shorter than this are never written as revisits.
LEAST_REVISIT = 1000
#: Bytes of a file, which must fit in a reader's memory; bytes of a gzip member before it is compressed (below 2^24).
FILE_BYTES, MEMBER = 32 << 20, 8 << 20
#: Header fields of each version, in order (fixed values of the format).
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_EPOCH = datetime(2000, 1, 1)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    status: str
    payload: bytes


def arc_bytes(rows: list[tuple[str, str, str, bytes]], version: int, name: str) -> bytes:
    """An ARC archive of (url, date of 14 digits, content type, payload) rows."""
    block = f"{version} 0 brindle\n{' '.join(FIELDS[version])}\n\n".encode()
    out = [_arc_record(version, f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", name, 0, block)]
    at = len(out[0])
    for url, date, kind, payload in rows:
        out.append(_arc_record(version, url, "0.0.0.0", date, kind, name, at, payload))
        at += len(out[-1])
    return b"".join(out)


def _arc_record(version: int, url: str, ip: str, date: str, kind: str, name: str, at: int, payload: bytes) -> bytes:
    fields = {"URL": _sanitised(url), "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(at), "Filename": name, "Archive-length": str(len(payload))}
    return " ".join(fields[f] for f in FIELDS[version]).encode() + b"\n" + payload + b"\n"


def read_arc(archive: bytes) -> Iterator[ArcRecord]:
    """The records after the filedesc record; ValueError where a header line or a length is wrong."""
    end = archive.find(b"\n")
    head = archive[:end].decode().split(" ")
    if not head[0].startswith("filedesc://"):
        raise ValueError("no filedesc record")
    block = archive[end + 1 : (at := end + 1 + int(head[-1]))]
    version = int(block.split(b" ", 1)[0])
    if version not in FIELDS or len(head) != len(FIELDS[version]):
        raise ValueError(f"ARC version {version} with {len(head)} fields")
    at += 1
    while at < len(archive):
        if (end := archive.find(b"\n", at)) < 0:
            raise ValueError("no header line")
        line = archive[at:end].decode().split(" ")
        if len(line) != len(FIELDS[version]):
            raise ValueError(f"{len(line)} header fields in version {version}")
        f = dict(zip(FIELDS[version], line, strict=True))
        at, end = end + 1, end + 1 + int(f["Archive-length"])
        if end >= len(archive) or archive[end : end + 1] != b"\n":
            raise ValueError("a declared length doesn't end at a line break")
        yield ArcRecord(f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], f.get("Result-code", "200"), archive[at:end])
        at = end + 1


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def identifier(url: str, date: str, digest: str) -> str:
    """The record identifier of a capture, from what any record that refers to it knows as well."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{url} {date} {digest}'.encode()).digest()[:16], version=5)}>"


def _warc(head: dict[str, str], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_record(r: ArcRecord, more: dict[str, str], refers_to: tuple[str, str] | None) -> bytes:
    """A record's WARC/1.1 equivalent, with its closing blank lines. refers_to: URL and date of the capture that holds an equal payload; a revisit has its HTTP head only."""
    digest = hashlib.sha1(r.payload).hexdigest()
    web = re.match("(?i)https?:|-$", r.url)
    http = f"HTTP/1.1 {r.status} \r\nContent-Type: {r.kind}\r\nContent-Length: {len(r.payload)}\r\n\r\n".encode() if web else b""
    block = http if refers_to is not None else http + r.payload
    head = {
        "WARC-Type": "revisit" if refers_to is not None else "response" if web else "resource",
        "WARC-Record-ID": identifier(r.url, r.date, digest),
        "WARC-Date": iso(r.date),
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
    }
    if refers_to is not None:
        url, date = refers_to
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": identifier(url, date, digest), "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": iso(date)}
    head |= more | {"Content-Type": "application/http; msgtype=response" if web else r.kind, "Content-Length": str(len(block))}
    return _warc(head, block)


def warc_info(name: str, date: str) -> bytes:
    """The record that begins a file."""
    block = b"software: brindle\r\nformat: WARC File Format 1.1\r\n"
    return _warc({"WARC-Type": "warcinfo", "WARC-Record-ID": identifier(name, date, hashlib.sha1(block).hexdigest()), "WARC-Date": iso(date), "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}, block)


def zipped(record: bytes) -> bytes:
    """gzip members of a record, each of at most MEMBER bytes, so that the size at a member's end has zero for its highest byte."""
    out = []
    for a in range(0, len(record), MEMBER):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(c.compress(record[a : a + MEMBER]) + c.flush())
    return b"".join(out)


def unzipped(archive: bytes) -> Iterator[bytes]:
    """The contents of the members of an archive, or the archive itself."""
    if archive[:2] != b"\x1f\x8b":
        yield archive
        return
    while archive:
        member = zlib.decompressobj(31)
        yield member.decompress(archive)
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        archive = member.unused_data


def read_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; ValueError where a length is wrong."""
    left = b""
    for part in unzipped(archive):
        part, at = left + part if left else part, 0
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            lines = part[at:end].decode().split("\r\n") if end >= 0 else []
            if lines and not lines[0].startswith("WARC/"):
                raise ValueError("no WARC header")
            head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            start = end + 4
            if end < 0 or (end := start + int(head["content-length"])) + 4 > len(part):
                break  # goes on in the next member
            if part[end : end + 4] != b"\r\n\r\n":
                raise ValueError("a declared length doesn't end at the blank lines")
            yield head, part[start:end]
            at = end + 4
        left = part[at:]
    if left:
        raise ValueError("a record is cut short")


def payload(head: dict[str, str], block: bytes) -> bytes:
    """What a record's payload digest is of: its block, without the HTTP head if it has one."""
    return block[block.find(b"\r\n\r\n") + 4 :] if head["content-type"].startswith("application/http") else block


def _sanitised(url: str | None) -> str:
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


def _date(page_id: int | None) -> str:
    """When a page counts as fetched: pages have no time of their own."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 800_000_000)).strftime("%Y%m%d%H%M%S")


def with_targets(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and refers_to and its URL: the largest page_id of those with an equal payload, null for that page, small payloads and single ones.

    Only digests, ids and URLs are aggregated; where they are few, the join with the pages moves no html.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= LEAST_REVISIT, F.sha2(F.col("html"), 256)))
    kept = rows.where("key is not null").groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("key", "kept")
    target = F.when(~F.col("page_id").eqNullSafe(F.col("kept.page_id")), F.col("kept"))
    return rows.join(kept, "key", "left").select("page_id", "url", "html", target["page_id"].alias("refers_to"), target["url"].alias("refers_to_url"))


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Puts the pages into ARC archives, batch by batch and in either version, and converts those to WARC files."""
    small_batches(pages.sparkSession)
    schema = pa.schema([pa.field("archive", pa.binary())])

    def records(b: pa.RecordBatch, k: int) -> Iterator[bytes]:
        ids, urls, refers, targets = (b.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "refers_to_url"))
        payloads = [(h or "").encode() for h in b.column("html").to_pylist()]
        archive = arc_bytes([(_sanitised(u), _date(i), "text/html", p) for i, u, p in zip(ids, urls, payloads, strict=True)], 1 + k % 2, f"batch-{k}.arc")
        for page, ref, url, r in zip(ids, refers, targets, read_arc(archive), strict=True):
            more = {"X-Page-Id": "-" if page is None else str(page), "X-Payload-Bytes": str(len(r.payload))}
            if ref is not None:
                more["X-Refers-To-Page-Id"] = str(ref)
            yield zipped(warc_record(r, more, None if ref is None else (_sanitised(url), _date(ref))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for k, b in enumerate(batches):
            for r in records(b, k):
                if held and size + len(r) > file_bytes:
                    yield batch(schema, [b"".join(held)[:-1]])
                    held, size = [], 0
                if not held:
                    held.append(zipped(warc_info(hashlib.sha1(r).hexdigest(), "20000101000000")))
                    size = len(held[0])
                held.append(r)
                size += len(r)
        if held:
            yield batch(schema, [b"".join(held)[:-1]])

    pages.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record in a folder of archives."""
    schema = pa.schema([pa.field("page_id", pa.int64()), pa.field("payload_bytes", pa.int64()), pa.field("payload_digest", pa.string()), pa.field("record_type", pa.string()), pa.field("refers_to", pa.int64())])
    number = lambda x: None if x in (None, "-") else int(x)

    def row(head: dict[str, str], block: bytes) -> tuple:
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] != "revisit" and (hashlib.sha1(p := payload(head, block)).hexdigest() != digest or len(p) != int(head["x-payload-bytes"])):
            raise ValueError("a payload doesn't have its digest")
        return number(head["x-page-id"]), int(head["x-payload-bytes"]), digest, head["warc-type"], number(head.get("x-refers-to-page-id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = [row(h, x) for h, x in read_warc(content.as_py()) if h["warc-type"] != "warcinfo"]
                yield batch(schema, *([list(c) for c in zip(*rows, strict=True)] or [[]] * 5))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def converted(pages: DataFrame) -> DataFrame:
    """Writes archives to a new place in the shared folder and reads them back."""
    spark = pages.sparkSession
    write(with_targets(pages), path := new_path(spark, "warc"))
    return read(spark, path)
