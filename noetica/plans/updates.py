"""Routing of SPARQL updates: to graphs, to sources, and to the user's own graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..model import PERSONAL, QUAD, apply_diff, merge_results, negate

USER_GRAPH = f"<{PERSONAL}userGraph>"


def with_contexts(diff: DataFrame, quads: DataFrame) -> DataFrame:
    """Give quads without a graph their candidate graphs: for additions every graph that
    describes the subject, for removals every graph that holds the triple."""
    named, bare = diff.where("g is not null"), diff.where("g is null").drop("g")
    added = bare.where("op > 0").join(quads.select("s", "g").distinct(), "s", "left").withColumn("g", F.coalesce("g", F.lit(USER_GRAPH)))
    removed = bare.where("op < 0").join(quads.select("s", "p", "o", "g").distinct(), ["s", "p", "o"])
    return named.select(*QUAD, "op").unionByName(added.select(*QUAD, "op")).unionByName(removed.select(*QUAD, "op")).distinct()


def apply_update(quads: DataFrame, diff: DataFrame, sources: list[Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The base after an update, and the outcome per quad.

    The user's graph takes its quads at once.  All others go to the sources, each of which
    returns ``s, p, o, g, side, ok, error``; what no source did is put into the user's graph:
    an addition as it is, a removal as its negation.  Negations that an addition contradicts
    are taken out.
    """
    routed = saved(with_contexts(diff, quads), "routed")
    own, rest = routed.where(F.col("g") == USER_GRAPH), routed.where(F.col("g") != USER_GRAPH)
    contradicted = routed.where("op > 0").select("s", negate(F.col("p")).alias("p"), "o", F.lit(USER_GRAPH).alias("g"), F.lit(-1).alias("op"))
    asked = rest.select(*QUAD, F.when(F.col("op") > 0, "added").otherwise("removed").alias("side"))
    results = asked.select(*QUAD, "side", F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("string").alias("error")).limit(0)
    for source in sources:
        results = results.unionByName(source(asked).select(*QUAD, "side", "ok", "error"))
    merged = merge_results(results)
    outcome = asked.join(merged, [*QUAD, "side"], "left")
    outcome = saved(outcome.withColumn("ok", F.coalesce("ok", F.col("side") == "removed")).withColumn("errors", F.coalesce("errors", F.lit(""))), "outcome")
    # a contextless quad counts as done if some graph took it
    done = outcome.groupBy("s", "p", "o", "side").agg(F.bool_or("ok").alias("ok"))
    failed = done.where("not ok")
    kept = failed.select("s", F.when(F.col("side") == "added", F.col("p")).otherwise(negate(F.col("p"))).alias("p"), "o", F.lit(USER_GRAPH).alias("g"), F.lit(1).alias("op"))
    succeeded = outcome.where("ok").select(*QUAD, F.when(F.col("side") == "added", 1).otherwise(-1).alias("op"))
    whole = own.select(*QUAD, "op").unionByName(contradicted).unionByName(kept).unionByName(succeeded)
    return apply_diff(quads, whole), outcome
