"""Files of any supported kind to quads: folders, zip members, and location histories."""

from __future__ import annotations

import io
import pickle
import re
import zipfile
import zlib
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import geo_uri
from ..model import QUADS_DDL, TYPE, iri, literal, schema
from ..model import personal as personal_term
from . import personal


def kind_of(path: str) -> str | None:
    name = path.lower()
    return next((kind for extension, kind in personal.EXTENSIONS.items() if name.endswith(extension)), None)


def members(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """The file itself, or the members of an archive, at any depth; a ``FileFault`` for what
    cannot be read."""
    if not path.lower().endswith(".zip"):
        yield path, content
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        yield path, FileFault(str(e))
        return
    for info in archive.infolist():
        if info.is_dir():
            continue
        try:
            data = archive.read(info)
        except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, EOFError) as e:  # encrypted, unknown method, damaged
            yield f"{path}/{info.filename}", FileFault(str(e))
            continue
        yield from members(f"{path}/{info.filename}", data)


class FileFault(str):
    """Why a file could not be read."""


def kind_in(data: bytes) -> str | None:
    """The kind that a content declares itself, for files whose name tells none."""
    head = data[:4096].lstrip(b"\xef\xbb\xbf \t\r\n")
    if head.upper().startswith(b"BEGIN:VCARD"):
        return "text/vcard"
    if head.upper().startswith(b"BEGIN:VCALENDAR"):
        return "text/calendar"
    declared = re.search(rb"(?im)^content-type:\s*([\w.+-]+/[\w.+-]+)", head)
    if re.match(rb"(?i)(from|to|subject|date|received|message-id|return-path|mime-version|delivered-to):", head):
        return "message/rfc822"
    found = declared[1].decode().lower() if declared else None
    return found if found in personal.PARSERS else None


def parse_file(path: str, content: bytes) -> Iterator[tuple]:
    """Quads with a null error, or a row with nothing but the error of a document."""
    for name, data in members(path, content):
        fault = data if isinstance(data, FileFault) else None
        if fault is None:
            kind = kind_of(name)
            kind = kind if kind in personal.PARSERS else kind_in(data)
            try:
                # a document in error gives no quads, so they wait for its end, packed
                found = [zlib.compress(pickle.dumps(rows), 1) for rows in batched(personal.PARSERS[kind](data, name.replace(" ", "%20")) if kind else [], 10_000)]
            except Exception as e:  # any fault of a document is that document's
                fault = FileFault(f"{type(e).__name__}: {e}")
            else:
                for rows in found:
                    yield from ((*q, None) for q in pickle.loads(zlib.decompress(rows)))
        if fault is not None:
            yield (None, None, None, f"<{name.replace(' ', '%20')}>", str(fault))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            for rows in batched(parse_file(path, content), 10_000):
                yield pd.DataFrame(rows, columns=["s", "p", "o", "g", "error"])


_DOCUMENT = QUADS_DDL + ", error string"


def read_documents_and_errors(spark: SparkSession, path: str) -> DataFrame:
    """Quads of all supported files under a path, and a row for each file that gave an error:
    ``s, p, o, g, error``; the document is the graph."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(_parse, _DOCUMENT)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Quads of all supported files under a path; files in error give none."""
    return read_documents_and_errors(spark, path).where("error is null").drop("error")


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream of arriving files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select("path", "content").mapInPandas(_parse, _DOCUMENT).where("error is null").drop("error")


_HISTORY = "locations array<struct<timestampMs:string,latitudeE7:bigint,longitudeE7:bigint,accuracy:float,velocity:float,altitude:double,heading:float>>"


def read_location_history(spark: SparkSession, path: str) -> DataFrame:
    """Locations of history files: ``id, ts, lon, lat, acc, velocity, altitude, heading, day``;
    rows whose time cannot be read are dropped."""
    rows = spark.read.schema(_HISTORY).json(path, multiLine=True).select(F.explode("locations").alias("l"))
    ms = F.col("l.timestampMs").try_cast("bigint")
    ts = F.timestamp_millis(ms)
    out = rows.where(ms.isNotNull()).select(F.concat(F.lit("urn:location:"), ms.cast("string")).alias("id"), ts.alias("ts"), (F.col("l.longitudeE7") / 1e7).alias("lon"), (F.col("l.latitudeE7") / 1e7).alias("lat"), F.col("l.accuracy").cast("double").alias("acc"), "l.velocity", "l.altitude", "l.heading")
    return out.withColumn("day", F.date_trunc("day", "ts"))


def location_quads(history: DataFrame, graph: str = "urn:location-history:") -> DataFrame:
    """Locations of ``read_location_history`` as quads; each UTC day is a document."""
    text = lambda c, kind: literal(c, kind)
    node, point = iri(F.col("id")), iri(geo_uri(F.col("lon"), F.col("lat"), F.col("altitude"), F.col("acc")))
    pairs = [
        (TYPE, F.lit(personal_term("Location"))), (schema("geo"), point), (personal_term("time"), text(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "dateTime")),
        (schema("velocity"), text(F.col("velocity").cast("double"), "double")), (schema("heading"), text(F.col("heading").cast("double"), "double")),
    ]
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs))).alias("q")
    g = F.concat(F.lit(f"<{graph}"), F.date_format("day", "yyyy-MM-dd"), F.lit(">"))
    return history.select(node.alias("s"), rows, g.alias("g")).select("s", "q.p", "q.o", "g").where("o is not null")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth samples ``threshold, a, b``."""
    return spark.read.schema("threshold decimal(4,2), a string, b string").csv(path, header=True)
