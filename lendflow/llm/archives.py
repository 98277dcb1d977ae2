"""Legacy archive files to WARC: pages are kept in ARC files, which are converted and read back.

An ARC file starts with a version block that names the fields of every record's header line (version 1:
URL, address, date, type, length; version 2 adds result code, checksum, location, offset and file name).
A record is that line and as many bytes as it declares.  The converter parses both versions and gives each
record what WARC wants and ARC lacks: an identifier derived from the record, an ISO timestamp, a record
type, block and payload digests, and, for a payload that another record holds, a revisit in its place.

Archives are bounded: a task starts a new one every ``ARCHIVE_BYTES``, and each is written as one gzip
file in the shared folder by Spark's text writer and read by its binary reader.  What decides between
response and revisit is one small row per record; payloads never meet in one place.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow.llm.common import scratch_path, stored

ARCHIVE_BYTES = 4 << 20              # uncompressed; a larger record has an archive to itself
LEAST_REVISIT = 1000                 # bytes; smaller payloads are always stored
FETCHED = "20240101000000"           # date of pages that carry none

# The field names of the two ARC versions, and WARC's revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE, _SIZE = "X-Page-Id", "Content-Length"


# --- ARC ---------------------------------------------------------------------------------------------
def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 Origin\n{ARC_FIELDS[version]}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {FETCHED} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, at: int, url: str, page_id: int | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{_SIZE}: {len(payload)}\r\n"
    http += "" if page_id is None else f"{_PAGE}: {page_id}\r\n"
    block = http.encode() + b"\r\n" + payload
    extra = f" 200 {hashlib.md5(payload).hexdigest()} - {at} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {FETCHED} text/html{extra} {len(block)}\n".encode() + block + b"\n"


def clean_url(url: str | None) -> str:
    """The URL as a header line can hold it: no white space or control characters, and not the scheme of a version
    block; null as an own URN."""
    if not url:
        return "urn:unknown"
    if url.startswith("filedesc:"):
        url = f"%{ord(url[0]):02X}{url[1:]}"
    return "".join(c if c.isprintable() and not c.isspace() else f"%{ord(c):02X}" for c in url)


def parse_arc(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of every record; version blocks set the fields of what follows."""
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(raw):
        stop = raw.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"ARC header line at {at} has no end")
        line = raw[at:stop].decode("utf-8")
        version_block = line.startswith("filedesc://")
        # A URL may hold spaces: the other fields are counted from the right.
        names = fields
        if version_block:
            body = raw[stop + 1:stop + 1 + int(line.rsplit(" ", 1)[1])].decode("utf-8").split("\n")
            names = fields = body[1].split()
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"ARC header line at {at} does not have the fields {names}")
        header = dict(zip(names, values, strict=True))
        end = stop + 1 + int(header["Archive-length"])
        if end > len(raw):
            raise ValueError(f"ARC record at {at} is cut short")
        if not version_block:
            yield at, header, raw[stop + 1:end]
        at = end + (raw[end:end + 1] == b"\n")


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(HTTP head with its blank line, payload, header fields) of a record's block."""
    cut = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or cut < 0:
        return b"", block, {}
    head = block[:cut + 4]
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head, block[cut + 4:], dict(x.split(": ", 1) for x in lines if ": " in x)


# --- WARC --------------------------------------------------------------------------------------------
def record_id(url: str, date: str, sha1: bytes, page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, date, sha1.hex(), page or '-')))}>"


def warc_digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(header: dict[str, str], block: bytes, refers: dict | None) -> bytes:
    """A response record, or with ``refers`` (id and url of the record that has the payload) a revisit."""
    head, payload, fields = split_http(block)
    sha1 = hashlib.sha1(payload).digest()
    stored_block = head if refers else block
    lines = [f"WARC-Type: {'revisit' if refers else 'response'}",
             f"WARC-Record-ID: {record_id(header['URL'], header['Archive-date'], sha1, fields.get(_PAGE))}",
             f"WARC-Target-URI: {header['URL']}", f"WARC-Date: {warc_date(header['Archive-date'])}",
             f"WARC-Payload-Digest: {warc_digest(sha1)}",
             f"WARC-Block-Digest: {warc_digest(hashlib.sha1(stored_block).digest())}",
             "Content-Type: application/http; msgtype=response"]
    if refers:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers['id']}",
                  f"WARC-Refers-To-Target-URI: {refers['url']}"]
    lines.append(f"Content-Length: {len(stored_block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + stored_block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(raw):
        cut = raw.find(b"\r\n\r\n", at)
        lines = raw[at:cut].decode("utf-8").split("\r\n")
        if cut < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        header = dict(x.split(": ", 1) for x in lines[1:])
        end = cut + 4 + int(header["Content-Length"])
        if raw[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at {at} is cut short")
        yield header, raw[cut + 4:end]
        at = end + 4


# --- jobs --------------------------------------------------------------------------------------------
def _write(archives: DataFrame, path: str) -> None:
    """One gzip file per row: the writer adds the line feed that ends each archive."""
    archives.write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _inflate(content: pa.Scalar) -> bytes:
    return zlib.decompress(content.as_buffer(), 31)


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
              archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Keep ``pages`` in ARC files of both versions in turn."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = number = 0
        for batch in batches:
            for i in range(batch.num_rows):
                key, link, body = (batch.column(c)[i].as_py() for c in range(3))
                version = 1 + number % 2
                name = f"pages-{number:05d}.arc"
                if not parts:
                    parts.append(arc_head(version, name))
                    size = len(parts[0])
                parts.append(arc_record(version, name, size, clean_url(link), key, body or b""))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield _row(parts)
                    parts, number = [], number + 1
        if parts:
            yield _row(parts)

    def _row(parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1].decode("utf-8")])], names=["value"])

    chosen = pages.select(F.col(page_id).cast("long"), F.col(url), F.col(html).cast("binary"))
    _write(chosen.mapInArrow(build, "value string"), path)


def scan_arc(spark, path: str) -> DataFrame:
    """One row per ARC record: path, at, page_id, url, id, size and SHA-256 of its payload."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, header, block in parse_arc(_inflate(content)):
                    _, payload, fields = split_http(block)
                    page = fields.get(_PAGE)
                    rows.append((name, at, None if page is None else int(page), header["URL"],
                                 record_id(header["URL"], header["Archive-date"], hashlib.sha1(payload).digest(), page),
                                 len(payload), hashlib.sha256(payload).digest()))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(),
                                                                   pa.string(), pa.int64(), pa.binary()), strict=True)],
                    names=["path", "at", "page_id", "url", "id", "size", "sha"])
    return _files(spark, path).mapInArrow(
        scan, "path string, at long, page_id long, url string, id string, size long, sha binary")


def convert(spark, arc_path: str, warc_path: str, least: int = LEAST_REVISIT) -> None:
    """ARC files to WARC files, one for one.  Of records with equal payloads of at least ``least`` bytes
    the one with the largest page id is a response and the others revisit it."""
    records = stored(scan_arc(spark, arc_path), "arc-records")
    long_ones = records.where(F.col("size") >= least)
    holders = (long_ones.where("page_id is not null").groupBy("sha", "size")
               .agg(F.max(F.struct("page_id", "id", "url")).alias("holder")))
    revisits = (long_ones.join(holders, ["sha", "size"]).where(~F.col("page_id").eqNullSafe(F.col("holder.page_id")))
                .groupBy("path").agg(F.collect_list(F.struct("at", "holder.id", "holder.url")).alias("revisits")))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, refers in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held = {r["at"]: r for r in refers or []}
                out = b"".join(warc_record(h, block, held.get(at)) for at, h, block in parse_arc(_inflate(content)))
                if out:                                     # an empty table leaves an empty file
                    yield pa.RecordBatch.from_arrays([pa.array([out[:-1].decode("utf-8")])], names=["value"])

    # A file's revisits are at most its records, and a file is at most an archive.
    files = _files(spark, arc_path).join(revisits, "path", "left").select("content", "revisits")
    _write(files.mapInArrow(rewrite, "value string"), warc_path)


def read_warc(spark, path: str) -> DataFrame:
    """One row per WARC record: page_id, payload_bytes, payload_digest, record_type, id, refers_to_id."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for header, block in parse_warc(_inflate(content)):
                    _, payload, fields = split_http(block)
                    page, kind = fields.get(_PAGE), header["WARC-Type"]
                    digest = header["WARC-Payload-Digest"]
                    if kind == "response" and warc_digest(hashlib.sha1(payload).digest()) != digest:
                        raise ValueError(f"payload of {header['WARC-Record-ID']} does not match its digest")
                    size = len(payload) if kind == "response" else int(fields[_SIZE])
                    rows.append((None if page is None else int(page), size,
                                 base64.b32decode(digest.removeprefix("sha1:")).hex(), kind,
                                 header["WARC-Record-ID"], header.get("WARC-Refers-To")))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.string()] * 4),
                                                         strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "id", "refers_to_id"])
    return _files(spark, path).select("content").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, id string, "
              "refers_to_id string")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
               archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    A null page is an empty payload; a null URL gets an own URN; a null page_id is never referred to
    and revisits an equal page that has one; pages that repeat an id are responses alike.  Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, page_id, url, html, archive_bytes)
    convert(spark, arc, warc, least)
    records = stored(read_warc(spark, warc), "warc-records")
    targets = (records.where("record_type = 'response'").groupBy("id").agg(F.max("page_id").alias("refers_to"))
               .withColumnRenamed("id", "refers_to_id"))
    # Responses refer to nothing: only revisits are shuffled to their targets.
    revisits = records.where(F.col("refers_to_id").isNotNull()).join(targets, "refers_to_id", "left")
    rest = records.where(F.col("refers_to_id").isNull()).withColumn("refers_to", F.lit(None).cast("long"))
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return revisits.select(*out).unionByName(rest.select(*out))
