"""Stores of the quad table: on disk by buckets of graphs, and in memory with snapshots.

The disk store keeps quads in BUCKETS folders by a hash of the graph, sorted by predicate and
subject, so that filters on those skip row groups.  A commit rewrites the buckets that its diff
touches and then writes a manifest, which lists the folder of each bucket; the manifest is
renamed into place as the last step, so a store is always that of its last whole commit.
Opening a path finds that manifest: what was stored before is there again.

A manifest also holds the last batch of each stream that was committed with it.  A batch that
comes again after a failure is skipped, or, if only its quads were stored, goes on with its
enrichers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import scratch
from ..model import QUAD, QUADS_DDL, apply_diff, document_diff

BUCKETS = 64
#: Manifests (and the folders that only they name) that are kept besides the last.
KEPT = 2


class Files:
    """Small files of a folder, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none: written aside, then renamed.  An existing one is not replaced."""
        aside = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(self.at(aside), self.at(name)):
            self.fs.delete(self.at(aside), False)
            raise RuntimeError(f"{name} exists: another writer committed first")

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class KnowledgeBase:
    """A quad table in a folder; opening it again gives the last commit."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path or scratch(spark, "knowledge")
        self.files = Files(spark, self.path)
        found = [n for n in self.files.names("manifest") if n.endswith(".json")]
        if found:
            self.state = json.loads(self.files.read(f"manifest/{found[-1]}"))
        else:
            self.state = {"version": 0, "buckets": buckets, "folders": {}, "batches": {}, "rounds": {}}

    @property
    def version(self) -> int:
        return self.state["version"]

    def _bucket(self, g: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(g, F.lit(""))), F.lit(self.state["buckets"])).cast("int")

    def _read(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(QUADS_DDL).parquet(*paths) if paths else self.spark.createDataFrame([], QUADS_DDL)

    def quads(self, graphs: list[str] | None = None) -> DataFrame:
        """All quads, or those of some graphs, read from their buckets only."""
        if graphs is None:
            return self._read(self.state["folders"].values())
        wanted = self.spark.createDataFrame([(g,) for g in graphs], "g string").select(self._bucket(F.col("g")).alias("b")).distinct().collect()
        return self._read(f for b, f in self.state["folders"].items() if int(b) in {r["b"] for r in wanted}).where(F.col("g").isin(graphs))

    def commit(self, diff: DataFrame, batch: tuple[str, int, int] | None = None) -> None:
        """Apply a diff; ``batch`` is (stream, number, how many enrichers have run)."""
        diff = diff.select(*QUAD, "op").withColumn("bucket", self._bucket(F.col("g")))
        touched = sorted(r["bucket"] for r in diff.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        version = self.version + 1
        folders = dict(self.state["folders"])
        if touched:
            old = self._read(folders[str(b)] for b in touched if str(b) in folders)
            new = apply_diff(old, diff).withColumn("bucket", self._bucket(F.col("g")))
            data = f"data/{version}-{uuid.uuid4().hex}"
            new.repartition("bucket", F.pmod(F.xxhash64("s"), F.lit(8))).sortWithinPartitions("bucket", "p", "s").write.partitionBy("bucket").parquet(f"{self.path}/{data}")
            for b in touched:
                folders.pop(str(b), None)
            folders |= {n.removeprefix("bucket="): f"{data}/{n}" for n in self.files.names(data) if n.startswith("bucket=")}
        state = {**self.state, "version": version, "folders": folders}
        if batch:
            stream, number, done = batch
            state |= {"batches": {**self.state["batches"], stream: number}, "rounds": {**self.state["rounds"], stream: done}}
        self.files.write(f"manifest/{version:012d}.json", json.dumps(state))
        self.state = state
        self._tidy()

    def _tidy(self) -> None:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        for n in names[: -KEPT - 1]:
            self.files.remove(f"manifest/{n}")
        named = {f.split("/")[1] for n in names[-KEPT - 1 :] for f in json.loads(self.files.read(f"manifest/{n}"))["folders"].values()}
        for n in self.files.names("data"):
            if n not in named and int(n.partition("-")[0]) < self.version:
                self.files.remove(f"data/{n}")

    def ingest(self, documents: DataFrame, enrichers: list = (), stream: str | None = None, number: int = 0) -> DataFrame:
        """Replace the documents' graphs, then run the enrichers in order; what changed.

        Batch ``number`` of ``stream`` counts once, however often it comes.
        """

        seen = self.state["batches"].get(stream, -1) if stream is not None else -1
        if stream is not None and number < seen:
            return self.spark.createDataFrame([], f"{QUADS_DDL}, op int")
        # rounds of this batch that an earlier run committed: its documents, then its enrichers
        done = self.state["rounds"].get(stream, 0) if stream is not None and number == seen else 0
        at = f"{self.path}/diff/{stream}/{number}" if stream is not None else scratch(self.spark, "diff")

        def kept(df: DataFrame, k: int) -> DataFrame:
            if k >= done:
                df.select(*QUAD, "op").write.mode("overwrite").parquet(f"{at}/{k}")
            return self.spark.read.parquet(f"{at}/{k}")

        whole = None
        for k, step in enumerate([None, *enrichers]):
            if k < done:
                own = kept(None, k)
            else:
                own = kept(document_diff(documents.select(*QUAD), self.quads()) if step is None else step(self.spark, self.quads(), whole), k)
                if stream is not None or not own.isEmpty():
                    self.commit(own, (stream, number, k + 1) if stream is not None else None)
            whole = own if whole is None else whole.unionByName(own)
            if k == 0 and own.isEmpty():
                break
        if stream is not None:
            for n in self.files.names(f"diff/{stream}"):
                if int(n) < number:
                    self.files.remove(f"diff/{stream}/{n}")
        return whole


class MemoryStore:
    """A quad table held in the executors' memory, written to a snapshot every so many commits.

    What was committed after the last snapshot is lost with the application, as with any
    store in memory; ``close`` writes a last one.
    """

    def __init__(self, spark: SparkSession, snapshot: str | None = None, every: int = 10):
        self.spark, self.every, self.commits = spark, every, 0
        self.disk = KnowledgeBase(spark, snapshot) if snapshot else None
        self.held = self._hold(self.disk.quads() if self.disk else spark.createDataFrame([], QUADS_DDL))

    def _hold(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        return df

    def quads(self) -> DataFrame:
        return self.held

    def commit(self, diff: DataFrame) -> None:
        old = self.held
        self.held = self._hold(apply_diff(old, diff))
        self.commits += 1
        if self.disk and self.commits % self.every == 0:
            self.close()
        old.unpersist()

    def close(self) -> None:
        """Write what differs from the last snapshot."""
        if not self.disk:
            return
        before, now = self.disk.quads(), self.held
        diff = now.join(before, list(QUAD), "left_anti").withColumn("op", F.lit(1)).unionByName(before.join(now, list(QUAD), "left_anti").withColumn("op", F.lit(-1)))
        self.disk.commit(diff)
        # what is held no longer depends on all commits before
        old, self.held = self.held, self._hold(self.disk.quads())
        old.unpersist()
