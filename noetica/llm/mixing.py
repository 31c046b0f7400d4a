"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate ``weight * total / mass``; each row's count is the
inverse of the Poisson distribution with that mean, at a uniform number that a hash of
seed and id gives.  Rows are exploded by their counts and shuffled over all
partitions by a hash of id and copy number.

Means above CHUNK are split into equal parts with a uniform number each (a sum of Poisson
counts is Poisson), so the cumulated probabilities stay short arrays at any rate.

Cases: mass counts characters of text (null: none), so a very long text weighs as much as
it has characters and is repeated like any other row.  A null source is a source of its
own.  Sources without mass, and those with weight zero, give no rows.  Equal ids of a
source get equal counts, as the number is a function of the id; so do rows without an id,
which share one number.  An empty table gives an empty result.  All columns stay, whatever
their names, as they are renamed while at work; only a column named like ``copy_col`` gives way
to the copy number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import places, written

#: Largest mean inverted at once.
CHUNK = 16.0
#: Terms of the cumulated distribution: beyond it lies less than 1e-20 at mean CHUNK.
TERMS = 80
#: Production weights: proportional to mass to this power, so small sources are raised.
ALPHA = 0.5
SEED = 42
#: Sources up to this number (under 1 kB each) are broadcast to the documents.
BROADCAST_SOURCES = 10_000


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, total: float | None) -> DataFrame:
    """One row per source: its mean rate, parts, and cumulated probabilities of a part."""
    mass = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("_mass"))
    if weights is None:
        weight = F.pow("_mass", F.lit(alpha))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    mass = mass.where("_mass > 0").withColumn("_weight", weight)
    weights_sum, all_mass = mass.agg(F.sum("_weight")).scalar(), mass.agg(F.sum("_mass")).scalar()
    rated = mass.withColumn("_rate", F.try_divide(F.col("_weight"), weights_sum) * (F.lit(float(total)) if total is not None else all_mass) / F.col("_mass"))
    rated = rated.where("_rate > 0").withColumn("_parts", F.ceil(F.col("_rate") / CHUNK).cast("int")).withColumn("_mean", F.col("_rate") / F.col("_parts"))
    logs = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(TERMS + 1)))
    terms = F.transform(F.sequence(F.lit(0), F.lit(TERMS)), lambda k: F.exp(k * F.ln("_mean") - F.col("_mean") - F.element_at(F.col("_logs"), k + 1)))
    rated = rated.withColumn("_logs", logs).withColumn("_terms", terms)
    cdf = F.transform("_terms", lambda _, k: F.aggregate(F.slice("_terms", F.lit(1), k + 1), F.lit(0.0), lambda a, x: a + x))
    return rated.select("_source", "_rate", "_parts", cdf.alias("_cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float | None = None, seed: int = SEED, copy_col: str | None = None) -> DataFrame:
    """Rows of ``docs`` repeated by their Poisson counts, in a global pseudo-random order.

    ``weights`` are target shares by source (sources not named get none); without them
    shares follow mass to the power ``alpha``.  ``total`` is the mass to aim at, that of
    the input by default.  ``copy_col`` names a column for the copy number, from 1.
    """
    rated = written(rates(docs, weights, alpha, total), "rates")
    if rated.count() <= BROADCAST_SOURCES:
        rated = F.broadcast(rated)  # else a hot source is left to adaptive skew handling
    own = docs.drop(copy_col) if copy_col else docs
    at = {name: f"c{i}" for i, name in enumerate(own.columns)}
    rows = places(own).withColumn("id", F.col(at["doc_id"]).cast("string"))
    joined = rows.join(rated, rows[at["source"]].eqNullSafe(rated["_source"]))
    counts = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")),
        F.lit(0),
        lambda a, p: a + F.size(F.filter("_cdf", lambda c: c < _part_uniform(seed, p))),
    )
    copies = joined.withColumn("n", counts).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    # the text's hash spreads rows that share an id or have none
    keyed = copies.withColumn("key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "id", F.col("copy").cast("string"), F.xxhash64(at["text"]).cast("string"))))
    kept = [F.col(place).alias(name) for name, place in at.items()] + ([F.col("copy").cast("long").alias(copy_col)] if copy_col else [])
    spread = keyed.select(*at.values(), "copy", "key").repartition("key").sortWithinPartitions("key")
    return spread.select(*kept)


def _part_uniform(seed: int, part: Column) -> Column:
    return _uniform(F.lit(str(seed)), F.coalesce(F.col("id"), F.lit("")), part.cast("string"))


_MEANS = f"""
with mass as (select source, sum(coalesce(length(text), 0))::double m from documents group by source),
weighted as (select source, m, pow(m, {ALPHA}) w from mass where m > 0),
rated as (select source, w / (select sum(w) from weighted) * (select sum(m) from weighted) / m r from weighted),
split as (select source, ceil(r / {CHUNK})::int parts, r / ceil(r / {CHUNK})::int mean from rated),
terms as (select source, parts, k, exp(-mean + k * ln(mean) - coalesce((select sum(ln(i::double)) from range(1, k + 1) t(i)), 0)) p from split, range(0, {TERMS + 1}) s(k)),
cumulated as (select source, parts, k, sum(p) over (partition by source order by k) c from terms),
cdfs as (select source, any_value(parts) parts, list(c order by k) cdf from cumulated group by source),
counted as (
  select d.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda c: c <
    (('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(d.doc_id::varchar, ''), j::varchar)), 1, 13))::bigint::double + 0.5) / {1 << 52}))))::int n
  from documents d join cdfs on d.source is not distinct from cdfs.source)
"""

ORACLE_SQL = _MEANS + "select doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::bigint copy_no from counted where n > 0"
