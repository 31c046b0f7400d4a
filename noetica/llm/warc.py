"""WARC writing, and a reader that salvages damaged archives.

The writer makes one record per row: of records with equal payloads the one with the
largest id is a response with the payload, the others are revisits that refer to it and
have no block of their own.  Archives are written by Spark's text writer, the records'
separator as line separator, so files are committed like any output.

The reader walks an archive record by record and checks each: version line, header lines,
Content-Length, the closing blank lines, the block and payload digests, and, in compressed
archives, the gzip member's checksum.  After a failed check it searches for the next gzip member or
version line that passes them, goes on from there, and logs the bytes between as a
quarantined gap.  Compressed members may hold one record or many; inside a member damage is
handled alike, with offsets in the member's own bytes.  Gaps are rows of ``read`` like the records;
``round_trip``, whose archives are its own, fails on any.  ``loose_revisits`` finds the
revisits whose response is missing or has another digest.

Cases: a null payload is an empty one.  Rows that repeat an id and a payload are one
response each if theirs is the largest id, else revisits; a null id counts as the least, and
if all ids of a payload are null its records are responses.  A payload of any length is one
record; an archive is read whole by one task, so writers keep archives to a partition's
size.  An empty table gives no records.  Only the id, url and payload columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, written

#: Payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 0
#: Repeated payloads up to this number (some 100 bytes each) are broadcast to the writers.
BROADCAST_OWNERS = 100_000
DATE = "2024-01-01T00:00:00Z"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Bytes that no record was found in, and the check that failed at their start."""

    offset: int
    size: int
    reason: str


def parse_record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at an offset and where it ends, or None and the check that failed."""
    version = _VERSION.match(data, at)
    if not version:
        return None, at, "version line"
    end = data.find(_END, version.end() - 2)
    if end < 0:
        return None, at, "headers"
    headers = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and (not colon or not name or name != name.strip()):
            return None, at, "headers"
        if line:
            headers[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None, at, "content length"
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != _END:
        return None, at, "record end"
    block = data[start:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        return None, at, "block digest"
    digest = headers.get("warc-payload-digest", "")
    # the payload of a response to a request is what follows its own header; others are payload as a whole
    if headers.get("warc-type") in ("response", "resource") and digest.startswith("sha1:") and "msgtype=" not in headers.get("content-type", "") and digest[5:] != base32_sha1(block):
        return None, at, "payload digest"
    return Record(at, headers, block), stop + 4, ""


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at an offset and its end; zlib.error if damaged."""
    member = zlib.decompressobj(31)
    out = member.decompress(memoryview(data)[at:]) + member.flush()
    if not member.eof:
        raise zlib.error("cut off")
    return out, len(data) - len(member.unused_data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive that pass the checks, and the gaps between them, in order."""
    at, size = 0, len(data)
    bad_from, reason = -1, ""
    while at < size:
        found: Iterator[Record | Gap] = iter(())
        if data.startswith(b"\x1f\x8b\x08", at):
            try:
                content, next_at = _inflate(data, at)
            except zlib.error:
                ok, why = False, "gzip member"
            else:
                found = _of_member(at, content)
                first = next(found, None)
                ok, why = first is not None or not content, "no record in member"
                found = chain([first] if first else (), found)
        else:
            record, next_at, why = parse_record(data, at)
            ok = record is not None
            found = iter([record] if record else ())
        if ok:
            if bad_from >= 0:
                yield Gap(bad_from, at - bad_from, reason)
                bad_from = -1
            yield from found
            at = next_at
            continue
        if bad_from < 0:
            bad_from, reason = at, why
        later = _START.search(data, at + 1)
        at = later.start() if later else size
    if bad_from >= 0:
        yield Gap(bad_from, size - bad_from, reason)


def _of_member(at: int, content: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of a gzip member; nothing if it has no record."""
    inner = salvage(content)
    before = []
    for x in inner:
        before.append(x)
        if isinstance(x, Record):
            break
    else:
        return
    for x in chain(before, inner):
        yield Record(at, x.headers, x.block) if isinstance(x, Record) else Gap(at, x.size, f"in member at {x.offset}: {x.reason}")


# -- Spark


def _base32(hex_digest):
    """Base32 of 40 hexadecimal digits: every five of them make four letters."""
    number = lambda i: F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda n, k: F.substring(F.lit(_ALPHABET), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(letter(number(i), k) for i in range(8) for k in range(4)))


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``value``: the text of each row's record, without the blank lines that close it."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    owners = rows.select("id", "size", "sha1").where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("sha1", "size", "owner")
    owners = written(owners, "owners")
    if owners.count() <= BROADCAST_OWNERS:
        owners = F.broadcast(owners)  # payloads then stay where they are; beyond that they are dealt by digest
    joined = rows.join(owners, ["sha1", "size"], "left").withColumn("revisit", F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner")))
    digest = _base32(F.col("sha1"))
    name = lambda i: F.concat(F.lit("<urn:noetica:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("owner"))))).otherwise(
            line("WARC-Block-Digest", F.concat(F.lit("sha1:"), digest))
        ),
        line("Content-Length", F.when(F.col("revisit"), "0").otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("payload"))).alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    records(pages, id_col, url_col, payload_col).write.option("lineSep", "\r\n\r\n").text(path)


_ROW = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("gap_bytes", T.LongType()), T.StructField("gap_reason", T.StringType())]
    + [T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("block", T.BinaryType())]
)


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record, and one per quarantined gap (``gap_bytes`` not null), of all archives under ``path``."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = salvage(content.as_buffer().to_pybytes())
                rows = ((file, x.offset, x.size, x.reason, None, None) if isinstance(x, Gap) else (file, x.offset, None, None, list(x.headers.items()), x.block if blocks else None) for x in found)
                for some in batched(rows, 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=_ROW.names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(run, _ROW)


def _header(name: str):
    return F.try_element_at("headers", F.lit(name))


def loose_revisits(rows: DataFrame) -> DataFrame:
    """Of the rows of ``read`` the revisits that refer to no response with their payload digest."""
    answers = rows.where(_header("warc-type") == "response").select(_header("warc-record-id").alias("id"), _header("warc-payload-digest").alias("digest")).distinct()
    revisits = rows.where(_header("warc-type") == "revisit")
    return revisits.join(answers, (_header("warc-refers-to") == answers["id"]) & (_header("warc-payload-digest") == answers["digest"]), "left_anti")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows to archives in the shared folder, read them back, one row per record."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, id_col, url_col, payload_col)
    number = lambda name: F.regexp_extract(_header(name), r"page:(-?\d+)>", 1).try_cast("long")
    damaged = F.raise_error(F.concat_ws(" ", F.lit("quarantined bytes in an archive just written:"), "file", F.col("offset").cast("string"), F.col("gap_bytes").cast("string"), "gap_reason"))
    return read(spark, path, blocks=False).select(
        F.when(F.col("gap_bytes").isNotNull(), damaged.cast("long")).otherwise(number("warc-record-id")).alias(id_col),
        _header("warc-payload-length").try_cast("long").alias("payload_bytes"),
        F.substring(_header("warc-payload-digest"), 6, 32).alias("payload_digest"),
        _header("warc-type").alias("record_type"),
        F.when(_header("warc-type") == "revisit", number("warc-refers-to")).alias("refers_to"),
    )


_B32 = f"list_aggregate(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::int >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), 'string_agg', '')"
ORACLE_SQL = f"""
with rows_ as (select page_id, coalesce(html, '') p, strlen(coalesce(html, ''))::bigint n, sha1(coalesce(html, '')) h from pages),
owned as (select *, max(page_id) over (partition by h, n) owner from rows_)
select page_id, n payload_bytes, {_B32} payload_digest,
  case when n >= {MIN_REVISIT_BYTES} and page_id is distinct from owner then 'revisit' else 'response' end record_type,
  case when n >= {MIN_REVISIT_BYTES} and page_id is distinct from owner then owner end refers_to
from owned
"""
