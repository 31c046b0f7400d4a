"""Joins and aggregates of the enrichment steps, all DataFrame plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.geo import haversine
from ..functions.text import grams, tokens


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """Pairs with equal keys whose closed intervals ``[t_start, t_end]`` meet.

    Both sides are exploded over time buckets and joined on the bucket; a pair is kept in
    the first bucket they share, so none comes twice and no distinct is needed.  Columns of
    ``right`` other than the keys get the prefix ``r_``.
    """

    def cut(t: str) -> Column:
        return F.floor(F.unix_micros(F.col(t)) / (bucket_seconds * 1_000_000)).cast("long")

    def spread(df: DataFrame) -> DataFrame:
        return df.where("t_start <= t_end").withColumn("_b0", cut("t_start")).withColumn("_b", F.explode(F.sequence("_b0", cut("t_end"))))

    r = spread(right)
    r = r.select(*keys, "_b", *[F.col(c).alias(f"r_{c}") for c in r.columns if c not in (*keys, "_b")])
    met = spread(left).join(r, [*keys, "_b"])
    met = met.where((F.col("t_start") <= F.col("r_t_end")) & (F.col("r_t_start") <= F.col("t_end")) & (F.col("_b") == F.greatest("_b0", "r__b0")))
    return met.drop("_b", "_b0", "r__b0")


def stay_event_matches(events: DataFrame, stays: DataFrame, keys: list[str], ratio: float = 0.2, metres: float = 1000.0) -> DataFrame:
    """Events that a stay overlaps by more than ``ratio`` of the event, near enough if both
    have coordinates."""
    met = interval_join(events, stays, keys)
    us = F.unix_micros
    overlap = F.least(us("t_end"), us("r_t_end")) - F.greatest(us("t_start"), us("r_t_start"))
    share = F.try_divide(overlap.cast("double"), (us("t_end") - us("t_start")).cast("double"))
    distance = haversine(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))
    return met.withColumn("overlap", share).where(F.coalesce(F.col("overlap") > ratio, F.lit(False)) & F.coalesce(distance <= metres, F.lit(True)))


def near_pairs(points: DataFrame, metres: float, id_col: str = "id") -> DataFrame:
    """Pairs ``(a, b, distance)``, a < b, within a distance: grid cells and a residual.

    Cells are ``metres`` high; in longitude they widen with latitude, in whole bands, so the
    eight neighbours suffice away from the poles.  The date line is handled by wrapping.

    Of two neighbouring cells only the first sends its points to the other: a point goes to its
    own cell, the next one in its band, and three in the band above, not to nine.
    """
    height = metres / 111_000.0
    band = F.floor((F.col("lat") + 90) / height).cast("long")
    # as many columns in a band as its narrowest neighbour band allows
    edge = F.least(F.lit(89.0), F.abs((band.cast("double") + 0.5) * height - 90) + 1.5 * height)
    columns = F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / height)).cast("long")
    own = points.select(F.col(id_col).alias("id"), "lon", "lat", band.alias("band"), columns.alias("columns"))
    own = own.withColumn("_column", F.pmod(F.floor((F.col("lon") + 180) / 360 * F.col("columns")).cast("long"), F.col("columns")))

    def in_band(step: int) -> Column:
        b = F.col("band") + step
        far = F.least(F.lit(89.0), F.abs((b.cast("double") + 0.5) * height - 90) + 1.5 * height)
        return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(far)) / height)).cast("long")

    def neighbours(step: int) -> Column:
        n = in_band(step)
        at = F.floor((F.col("lon") + 180) / 360 * n).cast("long")
        around = F.array_distinct(F.array(*(F.pmod(at + d, n) for d in (-1, 0, 1))))
        if step == 0:  # with two columns, each is on both sides of the other
            around = F.when(n > 2, F.array(F.pmod(at, n), F.pmod(at + 1, n))).otherwise(around)
        return F.transform(around, lambda c: F.struct((F.col("band") + step).alias("band"), c.alias("column"), (F.lit(step == 0) & ((n <= 2) | (c == F.col("_column")))).alias("ordered")))

    cells = [neighbours(step) for step in (0, 1)]
    other = own.select(F.col("id").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.explode(F.concat(*cells)).alias("c")).select("b", "lon2", "lat2", F.col("c.band").alias("band"), F.col("c.column").alias("_column"), "c.ordered")
    met = own.select("id", "lon", "lat", "band", "_column").join(other, ["band", "_column"]).where("id < b or (not ordered and id <> b)")
    # the same to the last digit whichever point comes first
    met = met.withColumn("distance", haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))
    return met.where(F.col("distance") <= metres).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), "distance")


def blocking_pairs(queries: DataFrame, entries: DataFrame, percent: int = 70) -> DataFrame:
    """``(q, e, n_common)``: entries that share ``floor(percent/100 * n)`` of a query's n grams.

    Both sides have ``id`` (unique) and ``text``.  A pair needs at least one common gram.

    An entry that shares ``need`` of n grams misses n - need of them at most, so it has one of
    any n - need + 1: of each query only that many grams, those in the fewest entries, are
    looked up.  So a gram that nearly all entries have brings pairs together only where a query
    has no rarer ones.  The pairs that meet are then counted by all their grams.
    """
    q = queries.select(F.col("id").alias("q"), grams(F.col("text")).alias("q_grams")).withColumn("need", F.greatest(F.lit(1), F.floor(F.size("q_grams") * percent / 100)))
    e = entries.select(F.col("id").alias("e"), grams(F.col("text")).alias("e_grams"))
    found = e.select("e", F.explode("e_grams").alias("gram"))
    counts = found.groupBy("gram").agg(F.count("*").alias("n_entries"))
    asked = q.select("q", (F.size("q_grams") - F.col("need") + 1).alias("n_asked"), F.explode("q_grams").alias("gram")).join(counts, "gram", "left")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("n_entries").asc_nulls_first(), "gram"))
    rare = asked.withColumn("nth", nth).where("nth <= n_asked and n_entries is not null").select("q", "gram")
    met = rare.join(found, "gram").select("q", "e").distinct()
    counted = met.join(q, "q").join(e, "e").select("q", "e", F.size(F.array_intersect("q_grams", "e_grams")).cast("long").alias("n_common"), "need")
    return counted.where("n_common >= need").select("q", "e", "n_common")


def merge_ranked(first: pd.DataFrame, second: pd.DataFrame, distance: str = "distance", limit: float = 10_000.0) -> pd.DataFrame:
    """Merge of two ranked lists by distance (the first wins ties), cut at a distance."""
    a, b, i, j, out = first.to_dict("records"), second.to_dict("records"), 0, 0, []
    while i < len(a) or j < len(b):
        if j >= len(b) or (i < len(a) and a[i][distance] <= b[j][distance]):
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return pd.DataFrame([r for r in out if r[distance] <= limit], columns=first.columns)


def merge_ranked_lists(first: DataFrame, second: DataFrame, key: str, rank: str, distance: str = "distance", limit: float = 10_000.0) -> DataFrame:
    """``merge_ranked`` per key; ``rank`` is each list's own order and renumbered in the result.

    A merge takes a row as soon as its list's front has passed the rows before it, so rows
    stand in order of the largest distance so far in their list, the first list winning ties.
    """
    both = first.withColumn("_list", F.lit(1)).unionByName(second.withColumn("_list", F.lit(2)))
    front = F.max(distance).over(Window.partitionBy(key, "_list").orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = both.withColumn("_front", front).where(F.col(distance) <= limit)
    return kept.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy("_front", "_list", rank))).select(*first.columns)


def phrase_search(texts: DataFrame, entries: DataFrame, percent: int = 80, depth: int = 3, nested: bool = False) -> DataFrame:
    """``(id, index, count, entity)``: windows of ``count`` tokens of a text that match an entry.

    ``texts`` and ``entries`` have ``id`` and ``text``.  A window of tokens grows by one, up to
    ``depth``, while it matches any entry by shared n-grams.  Unless ``nested``, a match inside
    a longer window that matches the same entry is left out.  Each distinct phrase is sought once.
    """
    windows = texts.select("id", tokens(F.col("text")).alias("words")).select("id", "words", F.posexplode("words").alias("index", "phrase"))
    found = None
    for count in range(1, depth + 1):
        phrases = windows.select(F.col("phrase").alias("id"), F.col("phrase").alias("text")).distinct()
        hits = saved(blocking_pairs(phrases, entries, percent).select(F.col("q").alias("phrase"), F.col("e").alias("entity")), "phrases")
        own = windows.join(hits, "phrase").select("id", "index", F.lit(count).alias("count"), "entity")
        found = own if found is None else found.unionByName(own)
        grown = windows.join(hits.select("phrase").distinct(), "phrase", "left_semi").where(F.col("index") + count < F.size("words"))
        windows = grown.select("id", "words", "index", F.array_join(F.slice("words", F.col("index") + 1, count + 1), " ").alias("phrase"))
    if nested:
        return found
    shorter = [F.struct((F.col("index") + at).alias("index"), F.lit(n).alias("count")) for n in range(1, depth) for at in range(depth - n + 1)]
    inside = found.select("id", "entity", F.col("index").alias("from"), (F.col("index") + F.col("count")).alias("to"), "count", F.explode(F.array(*shorter)).alias("w"))
    inside = inside.where((F.col("w.count") < F.col("count")) & (F.col("w.index") + F.col("w.count") <= F.col("to"))).select("id", F.col("w.index").alias("index"), F.col("w.count").alias("count"), "entity")
    return found.join(inside, ["id", "index", "count", "entity"], "left_anti")


def trail_length(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Length of the polyline of each group: haversine over neighbouring points."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return points.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"), F.count("*").alias("n_points"))


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], value: str, keep_last: bool = False) -> DataFrame:
    """Of neighbours with equal values the later stays; the last row of a group of two or
    more goes unless ``keep_last``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    alone = F.count("*").over(Window.partitionBy(*keys)) == 1
    following = F.lead(value).over(w)
    keep = (following.isNotNull() & (following != F.col(value))) | alone
    if keep_last:
        keep = keep | following.isNull()
    return df.withColumn("_keep", keep).where("_keep").drop("_keep")


def cluster_stats(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Most likely centre of observations with accuracies: precision-weighted means, and the
    harmonic mean of the variances.  Four sums, so partial aggregation works."""
    w = F.col(weight) if weight else F.lit(1.0)
    precision = w / F.pow(F.greatest(F.col("acc"), F.lit(1e-9)), 2)
    sums = points.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(precision).alias("p"), F.sum(precision * F.col("lon")).alias("x"), F.sum(precision * F.col("lat")).alias("y"))
    return sums.select(*keys, (F.col("x") / F.col("p")).alias("lon"), (F.col("y") / F.col("p")).alias("lat"), F.sqrt(F.col("w") / F.col("p")).alias("accuracy"))


def window_counts(df: DataFrame, keys: list[str], time: str, seconds: int = 600) -> DataFrame:
    """How many windows hold how many distinct times, per group, from its first time on.

    Empty windows count as 0; a time on the very end of the last window is not counted.
    """
    origin = F.min(F.unix_micros(time)).over(Window.partitionBy(*keys))
    times = df.select(*keys, F.col(time)).distinct().withColumn("_t", F.unix_micros(time) - origin)
    step = seconds * 1_000_000
    last = times.groupBy(*keys).agg(F.max("_t").alias("_last"))
    windows = last.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_last") / step).cast("long"))).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_w"))
    held = times.withColumn("_w", F.floor(F.col("_t") / step).cast("long")).groupBy(*keys, "_w").agg(F.count("*").alias("_c"))
    return windows.join(held, [*keys, "_w"], "left").select(*keys, F.coalesce("_c", F.lit(0)).alias("n_in_window")).groupBy(*keys, "n_in_window").agg(F.count("*").alias("n_windows"))


def score_histogram(df: DataFrame, score: str, step: str = "0.05") -> DataFrame:
    """Counts of scores in buckets ``lo < x <= hi``; the first also holds what is lower."""
    bucket = F.greatest(F.lit(1), F.ceil(F.round(F.col(score).cast("decimal(20,10)") / F.lit(step).cast("decimal(3,2)"), 8))).cast("int")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def functionality(pairs: DataFrame, subject: str, value: str) -> DataFrame:
    """Subjects with values per pair, and values per pair."""
    d = pairs.select(subject, value).where(F.col(value).isNotNull()).distinct()
    n = F.greatest(F.count("*"), F.lit(1))
    return d.agg((F.count_distinct(subject) / n).alias("functionality"), (F.count_distinct(value) / n).alias("inverse_functionality"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str, now: Column, days: int = 365) -> DataFrame:
    """Requests without a cached answer younger than ``days``."""
    fresh = cache.where(F.col("modified_at") > now - F.expr(f"interval {days} days"))
    return requests.select(key).distinct().join(fresh, key, "left_anti")
