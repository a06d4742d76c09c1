"""Legacy archive converter: ARC files in, WARC files out.

An ARC file starts with a version block that names the version and lists the fields of each record's header line; a
record is that line, then as many bytes as its last field declares, then a newline. Version 1 lines have five fields
(url, ip, date, type, length), version 2 lines ten (result code, checksum, location, offset and file name besides).
Records are read by their declared lengths only, so payloads may hold anything.

The converter derives what ARC lacks: WARC-Record-ID is a UUID of the record's key and payload digest, so converting
twice gives the same ids; WARC-Date comes from the 14-digit date; WARC-Payload-Digest is the base-32 SHA-1 of the
payload; the record of the least key among equal payloads is a response, the others are revisits that name it and
carry no payload.

Archives are written by Spark's text sink (each value is one whole record, written byte for byte) and read whole by
its binary file source, so they may lie in any store Spark reads; an archive holds at most ARCHIVE_BYTES of payload
unless one record alone is larger.

Defined results. A null payload is an empty payload; equal empty payloads are revisits too (min_bytes 0). A null key
is written as '-'; it is the response only if no equal payload has a key. Rows that repeat a key and a payload are
records of their own: all records that bear the least key are responses. Empty tables give empty results. Null or odd
URLs are percent-encoded, an empty one is '-'. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch_path, table

#: Payload bytes of an archive, and the least payload for which copies become revisits.
ARCHIVE_BYTES, MIN_REVISIT_BYTES = 16 << 20, 0
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

# The version blocks of the two ARC formats.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20200101000000"


class ArchiveError(ValueError):
    """An archive that doesn't follow its format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_header(version: int, name: str) -> bytes:
    body = b"%d 0 tideline\n%s\n" % (version, ARC_FIELDS[version])
    fields = {1: b"filedesc://%s 0.0.0.0 %s text/plain %d", 2: b"filedesc://%s 0.0.0.0 %s text/plain 200 - - 0 %s %d"}
    args = (name.encode(), DATE.encode(), len(body)) if version == 1 else (name.encode(), DATE.encode(), name.encode(), len(body))
    return fields[version] % args + b"\n" + body


def arc_record(version: int, url: str | None, payload: bytes, name: str, date: str = DATE) -> bytes:
    where = urllib.parse.quote(url or "-", safe="/:?#[]@!$&'()*+,;=%-._~").encode()
    line = b"%s 0.0.0.0 %s text/html" % (where, date.encode())
    if version == 2:
        line += b" 200 %s - 0 %s" % (digest(payload).encode(), name.encode())
    return b"%s %d\n%s" % (line, len(payload), payload)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record after the version block."""
    end = data.index(b"\n")
    first = data[:end].split(b" ")
    if not first[0].startswith(b"filedesc://"):
        raise ArchiveError("no version block")
    size = int(first[-1])
    block = data[end + 1 : end + 1 + size]
    version_line, _, fields = block.partition(b"\n")
    version = int(version_line.split(b" ")[0])
    names = fields.strip().split(b"\n")[0].split(b" ")
    if version not in ARC_FIELDS or len(names) != len(ARC_FIELDS[version].split(b" ")):
        raise ArchiveError(f"unknown version or fields: {version_line!r} {fields!r}")
    at = end + 1 + size
    while at < len(data):
        if data[at : at + 1] == b"\n":  # what ends a record
            at += 1
            continue
        end = data.find(b"\n", at)
        values = data[at:end].split(b" ")
        if end < 0 or len(values) != len(names):
            raise ArchiveError(f"bad header line at {at}: {data[at : at + 80]!r}")
        size = int(values[-1])
        if end + 1 + size > len(data):
            raise ArchiveError(f"record at {at} declares {size} bytes, {len(data) - end - 1} are left")
        yield {n.decode(): v.decode() for n, v in zip(names, values, strict=True)}, data[end + 1 : end + 1 + size]
        at = end + 1 + size


def warc_date(arc_date: str) -> str:
    d = (arc_date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key} {payload_digest}')}>"


def warc_record(fields: dict[str, str], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; blocks are taken by Content-Length."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ArchiveError(f"no record at {at}: {data[at : at + 40]!r}")
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        if end + 4 + size > len(data):
            raise ArchiveError(f"record at {at} declares {size} bytes, {len(data) - end - 4} are left")
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def _key(value) -> str:
    return "-" if value is None else str(value)


def write_arcs(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write ARC archives of both versions. The key travels in the URL's fragment, as ARC has no field for it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            for k, u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = p or b""
                if not held or size + len(p) > ARCHIVE_BYTES:
                    if held:
                        yield pa.record_batch([pa.array([b"\n".join(held)], pa.binary())], names=["value"])
                    number += 1
                    version, name = 1 + number % 2, f"tideline-{number:05d}.arc"
                    held, size = [arc_header(version, name)], 0
                held.append(arc_record(version, f"{u or ''}#key={urllib.parse.quote(_key(k), safe='')}", p, name))
                size += len(p)
        if held:
            yield pa.record_batch([pa.array([b"\n".join(held)], pa.binary())], names=["value"])

    source = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(payload).cast("string").cast("binary").alias("p"))
    # One archive is one value and one file: the sink's cast keeps bytes as they are.
    archives = source.mapInArrow(each, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _each_archive(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for i in range(len(batch)):
            data = batch.column(0)[i].as_py()
            data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
            if data:  # a task without rows leaves an empty file
                yield data


_FACTS = "key string, url string, date string, digest string, bytes long"


def arc_rows(spark: SparkSession, path: str, with_payload: bool) -> DataFrame:
    """Records of ARC archives: key, url, date, digest, bytes and, if asked for, payload."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _each_archive(batches):
            rows = []
            for fields, payload in read_arc(data):
                url, _, key = fields["URL"].rpartition("#key=")
                row = {"key": urllib.parse.unquote(key), "url": url or "-", "date": warc_date(fields["Archive-date"]), "digest": digest(payload), "bytes": len(payload)}
                rows.append(row | ({"payload": payload} if with_payload else {}))
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return _archives(spark, path).mapInArrow(each, _FACTS + ", payload binary" * with_payload)


def _one_archive(records: list[bytes]) -> pa.RecordBatch:
    """Without its last line end, which the sink adds."""
    return pa.record_batch([pa.array([b"".join(records)[:-2]], pa.binary())], names=["value"])


def convert(spark: SparkSession, arcs: str, warcs: str, key_type: str = "long", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Convert the ARC archives in one folder to WARC archives in another."""
    facts = arc_rows(spark, arcs, False).select("digest", "bytes", F.expr(f"try_cast(key as {key_type})").alias("key"))
    least = saved(facts.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1"), "warc-least")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                copy = r["shared"] and r["first"] != r["key"]
                body = b"" if copy else r["payload"]
                fields = {
                    "WARC-Type": "revisit" if copy else "response",
                    "WARC-Record-ID": record_id(r["key"], r["digest"]),
                    "WARC-Date": r["date"],
                    "WARC-Target-URI": r["url"],
                    "WARC-Payload-Digest": f"sha1:{r['digest']}",
                    "Content-Type": "text/html",
                    "X-Tideline-Key": r["key"],
                    "X-Tideline-Payload-Length": str(r["bytes"]),
                }
                if copy:
                    fields |= {
                        "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                        "WARC-Refers-To": record_id(r["first"], r["digest"]),
                        "X-Tideline-Refers-To-Key": r["first"],
                    }
                if held and size + len(body) > ARCHIVE_BYTES:
                    yield _one_archive(held)
                    held, size = [], 0
                held.append(warc_record(fields, body) + b"\r\n\r\n")
                size += len(body)
        if held:
            yield _one_archive(held)

    firsts = least.select("digest", F.coalesce(F.col("first").cast("string"), F.lit("-")).alias("first"), F.lit(True).alias("shared"))
    rows = arc_rows(spark, arcs, True).join(firsts, "digest", "left").select("key", "url", "date", "digest", "bytes", "payload", "first", F.coalesce("shared", F.lit(False)).alias("shared"))
    archives = rows.mapInArrow(each, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("compression", "gzip").option("maxRecordsPerFile", 1).option("lineSep", "\r\n").text(warcs)


def warc_rows(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC archives: key, url, record_id, date, record_type, refers_to, digest, bytes (all of the full payload).

    The digest of a response is computed anew from its block and must equal its header."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _each_archive(batches):
            rows = []
            for f, block in read_warc(data):
                said = re.sub("^sha1:", "", f["WARC-Payload-Digest"])
                if f["WARC-Type"] == "response" and digest(block) != said:
                    raise ArchiveError(f"digest of {f['WARC-Record-ID']} differs")
                size = len(block) if f["WARC-Type"] == "response" else int(f["X-Tideline-Payload-Length"])
                rows.append((f["X-Tideline-Key"], f["WARC-Target-URI"], f["WARC-Record-ID"], f["WARC-Date"], f["WARC-Type"], f.get("X-Tideline-Refers-To-Key"), said, size))
            if rows:
                columns = [pa.array(c, pa.string()) for c in list(zip(*rows, strict=True))[:7]] + [pa.array([r[7] for r in rows], pa.int64())]
                yield pa.record_batch(columns, names=["key", "url", "record_id", "date", "record_type", "refers_to", "digest", "bytes"])

    return _archives(spark, path).mapInArrow(each, "key string, url string, record_id string, date string, record_type string, refers_to string, digest string, bytes long")


def op1_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arcs(pages, arcs)
    convert(spark, arcs, warcs)
    number = lambda c: F.expr(f"try_cast({c} as long)")
    return warc_rows(spark, warcs).select(
        number("key").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")
    )


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p),
bits AS (
  SELECT *, list_transform(range(32), lambda i: (
    (strpos('0123456789abcdef', substr(hex, i * 5 // 4 + 1, 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(hex, i * 5 // 4 + 2, 1)) - 1) >> (3 - (i * 5) % 4)) AS fives
  FROM g)
SELECT page_id, octet_length(body) AS payload_bytes,
  array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM bits
"""
