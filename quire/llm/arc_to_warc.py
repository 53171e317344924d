r"""Converter of legacy ARC archives to WARC records.

An ARC file (plain, or gzip members one after the other) begins with a ``filedesc:`` block whose second line names the
version. Version 1 header lines have five fields (URL, IP, date, content type, length), version 2 lines ten (with result
code, checksum, location, offset and file name); both are read from the right, as URLs may hold spaces. The declared
length takes the block, so nothing inside a block can be taken for a header.

Every record comes with its block, and ``write`` makes WARC files of them. Gzip members are taken one by one: where one is
broken, what it gave is kept, an error record says so, and reading goes on at the next member that can be read.

Equivalents made up for WARC: a name-based record id (a digest of source, position, URI and date, so conversion is
repeatable), the ISO date of the ARC date (a shorter one is filled up with the first month, day and zeros, and what no calendar or clock has in it counts as the first too), the type (filedesc:
warcinfo; http and https: response; other schemes: resource), the content type (application/http for responses), the
SHA-1 of the block and, for responses, of the body behind the HTTP header.

Defined results: a null or empty archive gives no records; broken bytes that end an archive and give nothing are left out; a block cut short is marked ``truncated`` and ends its archive; a line
that is no header makes one record of type null with the line as its error, and reading goes on at the next line that is one; repeated
archives and records are converted each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import calendar
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b"
STEP = 1 << 20
_TAIL = {
    1: re.compile(rb"^(\S.*) (\S+) (\d{4,17}) (\S+) (\d+)\s*$"),
    2: re.compile(rb"^(\S.*) (\S+) (\d{4,17}) (\S+) (\S+) (\S+) (\S+) (\d+|-) (\S+) (\d+)\s*$"),
}
_SCHEME = re.compile(rb"^[a-zA-Z][a-zA-Z0-9+.-]*:")
SCHEMA = (
    "source string, ordinal int, arc_version int, record_id string, warc_type string, warc_date string, target_uri string, ip string, "
    "content_type string, content_length long, block_digest string, payload_digest string, truncated boolean, error string, block binary"
)


def segments(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """The readable stretches of ``data``, and whether something broken follows each; all of it if it isn't gzipped."""
    if data[:2] != MAGIC:
        yield data, False
        return
    held, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        broken, rest = False, memoryview(data)[at:]
        got = 0
        try:
            for k in range(0, len(rest), STEP):
                held.append(member.decompress(rest[k : k + STEP]))
                got += len(held[-1])
                if member.eof:
                    at += min(k + STEP, len(rest)) - len(member.unused_data)
                    break
            broken = not member.eof
        except zlib.error:
            broken = True
        if broken:
            at = data.find(MAGIC, at + 2)
            if got or at >= 0:
                yield b"".join(held), True
                held = []
            if at < 0:
                break
        elif data[at : at + 2] != MAGIC and at < len(data):  # padding or damage between members
            padding, begin = data[at : at + 64].strip(b"\0\r\n"), at
            at = data.find(MAGIC, begin)
            if at < 0:
                break
            if padding[:2] != MAGIC:
                yield b"".join(held), True
                held = []
    if held:
        yield b"".join(held), False


def iso_date(date: str) -> str:
    """ISO form of an ARC date of 4 to 17 digits."""
    d = date[:14] + "00000101000000"[len(date[:14]) :]
    year, month, day, hour, minute, second = (int(x) for x in (d[:4], d[4:6], d[6:8], d[8:10], d[10:12], d[12:14]))
    month = month if 1 <= month <= 12 else 1
    day = day if 1 <= day <= calendar.monthrange(year or 4, month)[1] else 1
    hour, minute, second = (x if x < most else 0 for x, most in ((hour, 24), (minute, 60), (second, 60)))
    return f"{year:04}-{month:02}-{day:02}T{hour:02}:{minute:02}:{second:02}Z"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source: str, ordinal: int, uri: str, date: str) -> str:
    """A version 3 style UUID of the record's place and name."""
    h = hashlib.md5(f"{source} {ordinal} {uri} {date}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-3{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:]}>"


def header(line: bytes, version: int) -> tuple[bytes, ...] | None:
    m = _TAIL[version].match(line)
    return m.groups() if m and _SCHEME.match(m[1]) else None


def records(source: str, data: bytes) -> Iterator[dict]:
    """Every record of one archive."""
    ordinal = version = 0
    for part, broken in segments(data):
        for record in _records(source, part, ordinal, version):
            ordinal, version = record["ordinal"] + 1, record["arc_version"]
            yield record
        if broken:
            yield {"source": source, "ordinal": ordinal, "arc_version": version, "error": "broken gzip member"}
            ordinal += 1


def _records(source: str, data: bytes, ordinal: int, version: int) -> Iterator[dict]:
    at, bad = 0, False
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        if not version:  # the first block tells; without one the first header does
            found = header(line, 1)
            if found and found[0].startswith(b"filedesc:"):
                second = data[end + 1 : end + 1 + int(found[4])].split(b" ", 1)[0].strip()
                version = 2 if second == b"2" or header(line, 2) else 1
            else:
                version = 2 if header(line, 2) else 1
        kind = version
        found = header(line, 2) if version == 2 else header(line, 1)
        if found is None and version == 2:
            kind, found = 1, header(line, 1)  # version blocks have the short form in both
        if found is None:
            if not bad:
                yield {"source": source, "ordinal": ordinal, "arc_version": version, "error": line.decode("utf-8", "replace")}
                ordinal += 1
            bad, at = True, end + 1
            continue
        bad = False
        uri, ip, date, mime, length = (x.decode("utf-8", "replace") for x in (found[0], found[1], found[2], found[3], found[-1]))
        block = data[end + 1 : end + 1 + int(length)]
        cut = len(block) < int(length)
        scheme = uri.split(":", 1)[0].lower()
        made = {"filedesc": "warcinfo", "http": "response", "https": "response"}.get(scheme, "resource")
        payload = None
        if made == "response":
            m = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
            payload = sha1(block[m.end() :] if m else block)
            mime = "application/http; msgtype=response" if block.startswith(b"HTTP/") else mime
        yield {
            "source": source,
            "ordinal": ordinal,
            "arc_version": version if kind == version or made == "warcinfo" else kind,
            "record_id": record_id(source, ordinal, uri, date),
            "warc_type": made,
            "warc_date": iso_date(date),
            "target_uri": uri,
            "ip": None if ip in ("0.0.0.0", "-") else ip,
            "content_type": mime,
            "content_length": len(block),
            "block_digest": sha1(block),
            "payload_digest": payload,
            "truncated": cut,
            "block": block,
        }
        ordinal += 1
        at = end + 1 + int(length)


def rendered(record: dict, block: bytes) -> bytes:
    """The WARC/1.0 record of a converted record and its block."""
    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-IP-Address", "ip"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = ["WARC/1.0"] + [f"{name}: {record[key]}" for name, key in names if record.get(key) is not None]
    if record.get("truncated"):
        lines.append("WARC-Truncated: unspecified")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(archives: DataFrame) -> DataFrame:
    """One row a record of the archives (source, content)."""
    fields = [f.split() for f in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def made(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            size = 0
            for source, data in zip(common.column(batch, "source").to_pylist(), common.column(batch, "content")):
                for record in records(source or "", data.as_py() or b""):
                    found.append(record)
                    size += record.get("content_length", 0)
                    if len(found) > 5000 or size > 16 << 20:
                        yield made(found)
                        found, size = [], 0
            yield made(found)

    return archives.select("source", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files at ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return convert(files.select(F.col("path").alias("source"), "content"))


def write(converted: DataFrame, folder: str) -> None:
    """A gzipped WARC file of each partition of ``convert``'s rows, a member a record, in ``folder`` (a URI that all executors reach); error records are left out.

    A file gets its name when it is whole, always the same for a partition, so a task that is run again replaces it.
    """

    def run(rows: Iterator) -> None:
        found = (r for r in rows if r["error"] is None)
        first = next(found, None)
        if first is None:
            return
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():05}.warc.gz"
        with files.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp", compression=None) as out:
            for r in chain([first], found):
                out.write(gzip.compress(rendered(r.asDict(), bytes(r["block"])), mtime=0))
        files.move(f"{name}.{task.taskAttemptId()}.tmp", name)

    converted.foreachPartition(run)


def arc_of(pages: DataFrame) -> DataFrame:
    """(source, content): an ARC archive for each page, with its version block, its host's DNS record and the page; versions take turns. A null page_id is named ``null`` and dated as 0."""
    c, lit = F.col, F.lit
    pages = pages.withColumn("page_label", F.coalesce(c("page_id").cast("string"), lit("null"))).withColumn("page_id", F.coalesce("page_id", lit(0)))
    two = (c("page_id") % 2) == 1
    size = lambda x: F.octet_length(x).cast("string")
    part = lambda n, add=0: F.lpad((c("page_id") % n + add).cast("string"), 2, "0")
    date = F.concat(lit("2001"), part(12, 1), part(28, 1), part(24), part(60), lit("00"))
    host = F.regexp_extract("url", "//([^/:?#]+)", 1)
    desc = F.when(two, lit("2 0 archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n")).otherwise(lit("1 0 archive\nURL IP-address Archive-date Content-type Archive-length\n"))
    dns = F.concat(lit("20010101000000\n"), host, lit(".\t3600\tIN\tA\t192.0.2.7\n"))
    body = F.coalesce("html", lit(""))
    page = F.concat(lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), body)
    name = F.concat(lit("page-"), c("page_label"), lit(".arc"))

    def line(uri: Column, ip: str, mime: str, code: str, block: Column) -> Column:
        start = F.concat(uri, lit(f" {ip} "), date, lit(f" {mime} "))
        return F.concat(start, F.when(two & lit(bool(code)), F.concat(lit(f"{code} - - 0 "), name, lit(" "))).otherwise(lit("")), size(block), lit("\n"), block, lit("\n"))

    url = F.coalesce("url", lit("unknown:"))
    content = F.concat(line(F.concat(lit("filedesc://"), name), "0.0.0.0", "text/plain", "", desc), line(F.concat(lit("dns:"), F.coalesce(host, lit(""))), "192.0.2.1", "text/dns", "200", F.coalesce(dns, lit(""))), line(url, "192.0.2.7", "text/html", "200", page))
    return pages.select(name.alias("source"), F.encode(content, "UTF-8").alias("content"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(arc_of(common.table(spark, sf_dir, "pages"))).withColumn("block", F.translate(F.base64("block"), "\r\n", ""))


def _base32(hexed: str) -> str:
    """SQL for the base-32 form of 40 hexadecimal digits."""
    digit = "(strpos('0123456789abcdef', substr({h}, {k}, 1)) - 1)"
    pair = digit.format(h=hexed, k="(i * 5) // 4 + 1") + " * 16 + " + digit.format(h=hexed, k="(i * 5) // 4 + 2")
    return f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({pair}) >> (3 - (i * 5) % 4)) & 31)::INT + 1, 1)), '')"


SQL = (
    r"""
WITH base AS (SELECT page_id, url, coalesce(html, '') AS body, regexp_extract(url, '//([^/:?#]+)', 1) AS host, 'page-' || page_id || '.arc' AS source,
              page_id % 2 + 1 AS arc_version, '2001' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || lpad((page_id % 28 + 1)::VARCHAR, 2, '0')
              || lpad((page_id % 24)::VARCHAR, 2, '0') || lpad((page_id % 60)::VARCHAR, 2, '0') || '00' AS d FROM pages),
blocks AS (
  SELECT source, 0 AS ordinal, arc_version, d, 'warcinfo' AS warc_type, 'filedesc://' || source AS target_uri, NULL AS ip, 'text/plain' AS content_type, NULL AS payload,
         CASE WHEN arc_version = 2 THEN '2 0 archive' || chr(10) || 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length' || chr(10)
              ELSE '1 0 archive' || chr(10) || 'URL IP-address Archive-date Content-type Archive-length' || chr(10) END AS block FROM base
  UNION ALL SELECT source, 1, arc_version, d, 'resource', 'dns:' || host, '192.0.2.1', 'text/dns', NULL,
         '20010101000000' || chr(10) || host || '.' || chr(9) || '3600' || chr(9) || 'IN' || chr(9) || 'A' || chr(9) || '192.0.2.7' || chr(10) FROM base
  UNION ALL SELECT source, 2, arc_version, d, 'response', url, '192.0.2.7', 'application/http; msgtype=response', body,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || body FROM base),
hashed AS (SELECT *, sha1(block) AS bh, sha1(payload) AS ph, md5(source || ' ' || ordinal || ' ' || target_uri || ' ' || d) AS m FROM blocks)
SELECT source, ordinal::INT AS ordinal, arc_version::INT AS arc_version,
       '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-3' || m[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', m[17:17]) - 1) % 4 + 1, 1) || m[18:20] || '-' || m[21:32] || '>' AS record_id,
       warc_type, d[1:4] || '-' || d[5:6] || '-' || d[7:8] || 'T' || d[9:10] || ':' || d[11:12] || ':' || d[13:14] || 'Z' AS warc_date, target_uri, ip, content_type,
       strlen(block)::BIGINT AS content_length, 'sha1:' || """
    + _base32("bh")
    + " AS block_digest, CASE WHEN ph IS NOT NULL THEN 'sha1:' || "
    + _base32("ph")
    + " END AS payload_digest, false AS truncated, NULL::VARCHAR AS error, base64(encode(block)) AS block FROM hashed"
)
