"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import saved as written
from ..checkpoints import scratch, shared_dir

__all__ = ["SPACES", "STEP_BYTES", "numbered", "pieces", "places", "scratch", "shared_dir", "sql_literal", "table", "words_of", "written"]

#: ASCII white space: what separates words where a contract says ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that one step of a Python stage works on; bounds a worker's memory.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut batches so that each holds about STEP_BYTES of ``column`` (one row at least)."""
    for batch in batches:
        at, n = 0, batch.num_rows
        sizes = None
        if batch.nbytes > STEP_BYTES:
            col = batch.column(column)
            sizes = pa.compute.binary_length(col).fill_null(0).to_pylist()
        while at < n:
            end = n
            if sizes:
                end, held = at, 0
                while end < n and (end == at or held + sizes[end] <= STEP_BYTES):
                    held += sizes[end]
                    end += 1
            part = batch.slice(at, end - at)
            yield part, part.column(column).to_pylist()
            at = end


def places(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places, ``c0``, ``c1``, ...: no name of its own can
    clash with a working column."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def numbered(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` and a column ``_id``: a long that no two rows share, in order of the ids.

    Whole numbers that are neither null nor repeated are their own; else rows are sorted by id
    (without one first) and text, numbered, and written, so that the numbers stay.
    """
    if isinstance(rows.schema[id_col].dataType, _WHOLE):
        counts = rows.groupBy(F.col(id_col).alias("i")).agg(F.count("*").alias("n"))
        if counts.where("n > 1 or i is null").isEmpty():
            return rows.withColumn("_id", F.col(id_col).cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=schema.names)
            at += batch.num_rows

    by = [F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first()]
    return written(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), "numbered")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def sql_literal(text: str) -> str:
    return "'" + re.sub("'", "''", text) + "'"
