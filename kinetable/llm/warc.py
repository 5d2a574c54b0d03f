"""WARC archives: a writer with revisit records and a salvaging reader.

Writer: one record per page.  Of pages with equal payloads (SHA-1 and length) the one with the smallest id is stored as
a response, the others as revisits that refer to it; digests of payload and block are computed by the engine, and its text
writer puts the records into files of at most ``RECORDS`` in any store that the engine can write.

Reader: every record is checked (version line, headers, length, the two line ends behind the block, digests; a gzip
member also its checksum, which is that of a record alone in it).  Where a check fails, the reader searches on for the next version line or member from which a valid record
can be read, goes on there, and logs the bytes in between as quarantined.  Plain files, files with a gzip member per
record and files with several records in a member are read; the content of such a member is searched in the same way.  Of one that
is cut off, the whole records are kept, of one that can't be unpacked to its end those whose block digest holds.

Edge cases: a null payload is empty; empty payloads are payloads like others; a null url gives a record without target;
a null id is written as an empty one and read as null, and is no one's response unless all ids of its payload are null;
pages with equal ids and payloads at the smallest id are all responses; empty tables give no records; extra columns
play no part.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import new_folder, query, table, written

#: Records in a file; at some kilobytes a page, files of about ten megabytes.
RECORDS = 2000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
PAGE = "urn:kinetable:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MEMBER = b"\x1f\x8b\x08"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits make four signs."""
    digits = F.sha1(data)
    signs = []
    for k in range(8):
        value = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        signs += [F.substr(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*signs)


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes and refers_to (null for responses) of each row.

    Only digests and ids are aggregated, in the tasks first; the payloads of repeated digests are few or are met by a
    join of two plain inputs, whose hot partitions the engine splits.
    """
    payload = pages.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = payload.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    repeated = keys.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    repeated = written(repeated.drop("n"), "repeated-payloads")
    joined = payload.join(repeated, ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def records(pages: DataFrame) -> DataFrame:
    """Column ``value``: each page's record but for the two line ends behind its block."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", uri), F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{PAGE}"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), line("Content-Length", F.octet_length("block").cast("string")),
    )
    return pages.withColumn("block", block).select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row into WARC files below ``folder``."""
    some = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    records(with_roles(some, least)).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(folder)


# reading


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


class Damaged(ValueError):
    """A check failed."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; raises Damaged if a check fails."""
    if data[at : at + 7] != b"WARC/1.":
        raise Damaged("version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damaged("headers")
    headers = {}
    for text in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            raise Damaged("headers")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise Damaged("length")
    start, end = head + 4, head + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length")
    block = data[start:end]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told != _digest(block):
        raise Damaged("block digest")
    told = headers.get("warc-payload-digest", "")
    if told.startswith("sha1:") and headers.get("warc-type") == "response" and told != _digest(payload_of(block)):
        raise Damaged("payload digest")
    return headers, block, end + 4


def payload_of(block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else block


def _read_at(data: bytes, at: int, members: bool = True) -> tuple[list[Record | tuple[int, int, str]], int, str]:
    """The records that begin at ``at`` (one, or those of a gzip member with the gaps between them), the place behind them, and what ends a member before its end."""
    if not members or data[at : at + 3] != MEMBER:
        headers, block, end = read_record(data, at)
        return [Record(at, end - at, headers, block)], end, ""
    unzip = zlib.decompressobj(31)
    try:
        inner = unzip.decompress(memoryview(data)[at:])
        end, broken = len(data) - len(unzip.unused_data), not unzip.eof
        garbled = False
    except zlib.error:
        inner, end = _unpacked(data, at)
        broken = garbled = True
    if broken:  # what was unpacked may run on into a whole member
        start = _next(data, at, (MEMBER,))
        while start < end:
            try:
                _read_at(data, start)
            except Damaged:
                start = _next(data, start, (MEMBER,))
                continue
            return _read_at(data[:start], at)
    found = list(salvage(inner, members=False))
    kept = [x for x in found if isinstance(x, Record) and (not garbled or x.headers.get("warc-block-digest", "").startswith("sha1:"))]
    if not kept or broken and kept[0].length == len(inner):
        raise Damaged("member" if broken else found[0][2] if found else "version line")
    out: list[Record | tuple[int, int, str]] = []
    done = 0
    for x in [*kept, None]:  # what lies between the records that are kept
        to = x.offset if x else len(inner)
        if to > done:
            why = next((y[2] for y in found if isinstance(y, tuple) and done <= y[0] < to), "member")
            out.append((at, end - at, f"{why}: bytes {done} to {to} of the member's content"))
        if x:
            out.append(Record(at, end - at, x.headers, x.block))
            done = x.offset + x.length
    return out, end, f"member: content behind byte {len(inner)}" if broken else ""


def _unpacked(data: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """Content of a damaged member as far as it can be unpacked, and the place at which that ends."""
    unzip, out = zlib.decompressobj(31), []
    while at < len(data):
        before = unzip.copy()
        try:
            out.append(unzip.decompress(data[at : at + step]))
        except zlib.error:
            if step == 1:
                break
            unzip, step = before, 1  # byte by byte up to the error
            continue
        at += step
    return b"".join(out), min(at, len(data))


def _next(data: bytes, at: int, signs: tuple[bytes, ...] = (b"WARC/1.", MEMBER)) -> int:
    """Next place behind ``at`` at which a version line or a member may begin, or the end."""
    places = [data.find(sign, at + 1) for sign in signs]
    return min([x for x in places if x >= 0], default=len(data))


def salvage(data: bytes, members: bool = True) -> Iterator[Record | tuple[int, int, str]]:
    """Records of an archive in order, and (offset, length, reason) of the gaps between them.

    Gaps in a member have the member's offset and length, and their place in its content in the reason.
    """
    at, gap, reason = 0, -1, ""
    while at < len(data):
        try:
            found, end, broken = _read_at(data, at, members)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            at = _next(data, at, (b"WARC/1.", MEMBER) if members else (b"WARC/1.",))
            continue
        if gap >= 0:
            yield gap, at - gap, reason
            gap = -1
        yield from found
        if broken:
            gap, reason = at, broken
            at = _next(data, end - 1)
        else:
            at = end
    if gap >= 0:
        yield gap, len(data) - gap, reason


FOUND = (
    "file string, kind string, offset long, length long, reason string, record_type string, page_id long, url string, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)


def _page(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").removeprefix(PAGE)
    return int(name) if name.lstrip("-").isdigit() else None


def _row(file: str, x: Record | tuple[int, int, str], keep: bool) -> tuple:
    if isinstance(x, tuple):
        return file, "gap", *x, *(None,) * 7
    h = x.headers
    payload = payload_of(x.block)
    size = len(payload)
    if h.get("warc-type") == "revisit":  # its block has the headers of the response, with the length of the payload
        told = [v.strip() for n, _, v in (s.partition(":") for s in x.block.decode("utf-8", "replace").split("\r\n")) if n.lower() == "content-length"]
        size, payload = int(told[0]) if told and told[0].isdigit() else None, None
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (
        file, "record", x.offset, x.length, None, h.get("warc-type"), _page(h.get("warc-record-id")), h.get("warc-target-uri"), _page(h.get("warc-refers-to")),
        digest, size, payload if keep else None,
    )


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row per record (kind ``record``) and per quarantined gap (kind ``gap``) of all archives below ``folder``.

    A task holds one file at a time besides the files of its split.
    """
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in FOUND.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, data = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                rows = [_row(file, x, payload) for x in salvage(data)]
                for a in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 500], strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(folder)
    return files.select("path", "content").mapInArrow(run, FOUND)


SQL = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS x FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', CAST(((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest FROM h),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""


@query("op2_warc", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), folder)
    found = read_archives(spark, folder, payload=False)
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
