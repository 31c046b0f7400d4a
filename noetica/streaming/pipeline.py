"""The enrichment chain over arriving documents, in batch or from Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.time import DURATION_SQL
from ..model import QUAD
from ..operators.stays import LOOKUP, MIN_STAY, Cluster, SequentialClustering, _stay_rows
from .store import KnowledgeBase


class Enricher(Protocol):
    def __call__(self, spark: SparkSession, quads: DataFrame, diff: DataFrame) -> DataFrame:
        """Quads to add and to remove (``op``), given the whole base and what just changed."""


def run_stream(documents: DataFrame, base: KnowledgeBase, enrichers: list[Enricher], checkpoint: str, debounce: str = "10 seconds", once: bool = False, name: str = "documents"):
    """Start the chain on a stream of quads; each micro-batch merges what arrived meanwhile.

    The base knows the last batch of ``name`` that it holds, so a restart neither loses nor
    repeats one; a checkpoint goes with one base and one name.
    """

    def batch(df: DataFrame, number: int) -> None:
        base.ingest(df, enrichers, name, number)

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def debounced(events: DataFrame, keys: list[str], time: str = "ts", gap: str = "10 seconds", late: str = "1 minute", merge: list[Column] | None = None) -> DataFrame:
    """Bursts: rows of a key closer than a gap are one, given out when the gap has passed.

    ``merge`` are the aggregates that make one element of a burst's rows, such as the last
    operation on a quad; each must be named.
    """
    if events.isStreaming:
        events = events.withWatermark(time, late)
    out = events.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("last"), *(merge or []))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c not in (*keys, "w")])


def merged_diffs(diffs: DataFrame, source: str = "source", time: str = "ts", gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """One diff for each burst of a source's diffs: of a quad the last operation counts.

    ``diffs``: source, ts, s, p, o, g, op, seq.  A burst's quads come out as one element, as the
    array ``diff``.
    """
    quad = F.struct(*QUAD, "op", "seq")
    merged = debounced(diffs, [source], time, gap, late, [F.collect_list(quad).alias("quads")])
    # of equal quads in order of seq the last one stays
    ordered = F.array_sort("quads", lambda x, y: F.when(x["seq"] < y["seq"], -1).when(x["seq"] > y["seq"], 1).otherwise(0))
    same = lambda x, y: x["s"].eqNullSafe(y["s"]) & x["p"].eqNullSafe(y["p"]) & x["o"].eqNullSafe(y["o"]) & x["g"].eqNullSafe(y["g"])
    last = F.filter(ordered, lambda x, i: ~F.exists(F.slice(ordered, i + 2, F.size(ordered)), lambda y: same(x, y)))
    return merged.select(source, "start", "end", last.alias("diff"))


_STATE = "number int, clusters string"


def streaming_stays(locations: DataFrame, key: str = "user_id", lookup: float = LOOKUP, least: float = MIN_STAY, idle: str | None = "1 day") -> DataFrame:
    """Stays given out as soon as their clusters close; the open ones are kept as state.

    The clusters of a key without locations for ``idle`` (event time, by the watermark that
    ``locations`` must have on ``ts``) are given out too, and its state goes; without ``idle``
    they wait for the key's next location.
    """
    kind = locations.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, t_from timestamp, t_to timestamp, lon double, lat double, accuracy double, n_points int"
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, open_ = state.get if state.exists else (0, "[]")
        own = SequentialClustering(lookup, open_=[Cluster(**c) for c in json.loads(open_)], number=number)
        if state.hasTimedOut:
            closed = own.finish()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "id"])
            closed = []
            for r in rows.itertuples():
                closed += own.add(str(r.id), r.ts.timestamp(), r.lon, r.lat, r.acc)
            state.update((own.number, json.dumps([c.state() for c in own.open])))
            if wait is not None:
                last = max([int(c.last * 1000) for c in own.open], default=0)
                state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(_stay_rows(closed, least), columns=["t_from", "t_to", "lon", "lat", "accuracy", "n_points"])
        out.insert(0, key, k[0])
        yield out

    timeout = GroupStateTimeout.EventTimeTimeout if wait is not None else GroupStateTimeout.NoTimeout
    return locations.groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", timeout)


class Progress(StreamingQueryListener):
    """Rows, rate and time left of streams: ``status()`` gives one entry per query.

    ``totals`` are the rows to expect by query name, for the time left.
    """

    def __init__(self, totals: dict[str, int] | None = None):
        self.totals, self.seen = totals or {}, {}

    def onQueryStarted(self, event) -> None:
        self.seen[str(event.id)] = {"name": event.name, "status": "in progress", "rows": 0, "rate": 0.0, "start": event.timestamp, "end": None}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.seen.setdefault(str(p.id), {"name": p.name, "status": "in progress", "rows": 0, "rate": 0.0, "start": p.timestamp, "end": None})
        own |= {"rows": own["rows"] + p.numInputRows, "rate": p.processedRowsPerSecond, "end": p.timestamp}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.seen:
            self.seen[str(event.id)]["status"] = "error" if event.exception else "done"

    def status(self) -> list[dict]:
        out = []
        for own in self.seen.values():
            total = self.totals.get(own["name"])
            left = max(total - own["rows"], 0) if total is not None else None
            seconds = left / own["rate"] if left is not None and own["rate"] else (0.0 if left == 0 else None)
            out.append({**own, "progress": 100 * own["rows"] // total if total else None, "seconds_left": seconds})
        return out


def latest_tasks(tasks: DataFrame) -> DataFrame:
    """Of each service, account, source and name the last task: that of the largest id."""
    keys = ["service", "account", "source", "name"]
    rest = [c for c in tasks.columns if c not in keys]
    return tasks.groupBy(*keys).agg(F.max_by(F.struct(*rest), "id").alias("last")).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def register_functions(spark: SparkSession) -> None:
    """The engine's scalar functions for SQL text (in SPARQL they go by their IRIs)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION duration(a TIMESTAMP, b TIMESTAMP) RETURNS STRING RETURN {DURATION_SQL}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION duration_in_millis(a TIMESTAMP, b TIMESTAMP) RETURNS BIGINT RETURN unix_millis(b) - unix_millis(a)")


