"""Probabilities: distances of normals, log-domain sums, weighted draws, soft TF-IDF."""

from __future__ import annotations



import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hellinger(distance: Column, v1: Column, v2: Column) -> Column:
    """Hellinger distance of two isotropic normals in the plane with variances v1, v2."""
    z = F.lit(2.0) * F.sqrt(v1 * v2) / (v1 + v2) * F.exp(-F.pow(distance, 2) / (F.lit(4.0) * (v1 + v2)))
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - z)))


def hellinger_of(distance, v1, v2):
    z = 2 * np.sqrt(v1 * v2) / (v1 + v2) * np.exp(-np.square(distance) / (4 * (v1 + v2)))
    return np.sqrt(np.clip(1 - z, 0, 1))


def log_sum_exp(x: Column, over=None) -> Column:
    """Logarithm of a sum of exponentials: an aggregate, or over a window."""
    if over is None:
        return F.log(F.sum(F.exp(x - F.lit(0.0))))
    top = F.max(x).over(over)
    return top + F.log(F.sum(F.exp(x - top)).over(over))


def log_weight(x: Column) -> Column:
    """Logarithm of a weight; that of zero is minus infinity, not null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def normalised(df: DataFrame, keys: list[str], log_weight: str, out: str) -> DataFrame:
    """``out``: shares of exp(log_weight) within groups, safe for very small weights."""
    return df.withColumn(out, F.exp(F.col(log_weight) - log_sum_exp(F.col(log_weight), Window.partitionBy(*keys))))


def soft_tf_idf(pairs: Column) -> Column:
    """Of an array of ``(t1, t2, sim)`` (tf-idf of both terms): weighted mean similarity, at most 1."""
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["t1"] + p["t2"])
    good = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["t1"] + p["t2"]) * p["sim"])
    return F.least(F.coalesce(F.try_divide(good, total), F.lit(0.0)), F.lit(1.0))


def weighted_draws(elements: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``draw, element``: ``n`` draws with the chances that ``elements(element, weight)`` give.

    Draw ``i`` takes a number below the sum of weights from 52 bits of an MD5 of seed and ``i``;
    the element whose range of cumulated weights (in order of two digits of its MD5, then of
    itself) holds it is drawn.
    Whole weights; ranges meet draws by blocks of the sum, so no side is held by one task.
    """
    spark = elements.sparkSession
    # cumulated within parts of the elements, then over those: the last window has few rows
    parts = elements.where("weight > 0").withColumn("_part", F.substring(F.md5(F.col("element").cast("string")), 1, 2))
    sums = parts.groupBy("_part").agg(F.sum("weight").alias("_all"))
    sums = sums.withColumn("_before", F.sum("_all").over(Window.orderBy("_part")) - F.col("_all"))
    ranges = parts.join(sums, "_part").withColumn("_to", F.col("_before") + F.sum("weight").over(Window.partitionBy("_part").orderBy("element")))
    ranges = ranges.select("element", (F.col("_to") - F.col("weight")).alias("_from"), "_to")
    total = F.lit(elements.where("weight > 0").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 13)
    at = F.floor(F.conv(digits, 16, 10).cast("double") / float(1 << 52) * total).cast("long")
    block = F.greatest(F.lit(1), F.ceil(total / BLOCKS)).cast("long")
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("_at", at).withColumn("_block", F.floor(F.col("_at") / block))
    spread = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    return draws.join(spread, "_block").where("_from <= _at and _at < _to").select("draw", "element")


#: Blocks of the sum of weights in which draws meet elements.
BLOCKS = 4096


class Draws:
    """Seeded draws: bounded longs, weighted elements, uniform and weighted ordered pairs."""

    def __init__(self, seed: int = 42):
        self.rng = np.random.default_rng(seed)

    def below(self, bound: int, n: int) -> np.ndarray:
        return self.rng.integers(0, bound, n)

    def weighted(self, weights: np.ndarray, n: int) -> np.ndarray:
        ends = np.cumsum(weights)
        return np.searchsorted(ends, self.rng.integers(0, int(ends[-1]), n), "right")

    def ordered_pairs(self, size: int, n: int) -> np.ndarray:
        """Pairs i < j, all alike."""
        k = self.rng.integers(0, size * (size - 1) // 2, n)
        j = np.floor((1 + np.sqrt(1 + 8 * k)) / 2).astype(np.int64)
        j -= j * (j - 1) // 2 > k
        j += (j + 1) * j // 2 <= k
        return np.stack([k - j * (j - 1) // 2, j], axis=1)

    def weighted_ordered_pairs(self, weights: np.ndarray, n: int) -> np.ndarray:
        """Pairs i < j with weight w_i * w_j."""
        before = np.concatenate(([0], np.cumsum(weights)[:-1]))
        ends = np.cumsum(weights * before)
        j = np.searchsorted(ends, self.rng.integers(0, int(ends[-1]), n), "right")
        i = np.searchsorted(np.cumsum(weights), (self.rng.random(n) * before[j]).astype(np.int64), "right")
        return np.stack([i, j], axis=1)


