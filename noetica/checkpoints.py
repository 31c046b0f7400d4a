"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local folder where it is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="noetica-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_with_state(df: DataFrame, name: str, columns: list[str]) -> tuple[DataFrame, tuple]:
    """``saved``, and the number of rows and a checksum of them, taken while they are written."""
    seen = Observation()
    marks = [F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum")]
    out = saved(df.observe(seen, *marks), name)
    return out, (seen.get["n"], seen.get["sum"])


def saved_with_count(df: DataFrame, name: str, where: str) -> tuple[DataFrame, int]:
    """``saved``, and in how many rows a condition holds, counted while they are written."""
    seen = Observation()
    out = saved(df.observe(seen, F.count_if(F.expr(where)).alias("n")), name)
    return out, seen.get["n"]
