"""Exact top-k search by term-at-a-time accumulation.

Components are quantised to floor(256 x).  Queries and candidates are dealt into blocks
of bounded size by a hash of their ids; every query block meets every candidate block
once.  A candidate block is held as postings: per term (component index) the rows where
it is not zero, with their weights.  For each query, each of its non-zero terms scatters
``weight * posting weight`` into a dense array of scores, one entry per candidate of the
block.  The best k of the block are selected by partitioning the scores, and the blocks'
selections are merged by rank.

Cases: vectors that are null, or hold null or non-finite components, take no part, nor
do rows without an id.  An empty vector takes part with score 0; shorter vectors count as
zero in the terms they lack.  Ties go to the smaller id.  A row is never a candidate of a
query with its own id; rows that repeat an id are one vector, the least of them in array
order.  Scores are 64-bit integers (sums beyond that wrap around).  An empty table gives
an empty result.  Only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256.0
#: Vectors of a candidate block, and of a query block.
BLOCK, QUERIES = 4096, 8192


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of components, quantised; missing terms of shorter rows are zero."""
    column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    flat = np.clip(flat, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k candidates of a block for each query: (query ids, ids, scores)."""
    terms = min(queries.shape[1], rows.shape[1])
    bound = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * max(terms, 1)
    kind = np.int32 if bound < 2**31 else np.int64
    queries = queries.astype(kind)
    postings = []
    for t in range(terms):
        at = np.flatnonzero(rows[:, t])
        postings.append((slice(None) if len(at) == len(rows) else at, rows[at, t].astype(kind)))
    scores, product = np.empty(len(rows), kind), np.empty(len(rows), kind)
    out_q, out_c, out_s = [], [], []
    for q in range(len(queries)):
        scores[:] = 0
        own = queries[q]
        for t in np.flatnonzero(own[:terms]):
            at, weights = postings[t]
            if isinstance(at, slice):
                np.multiply(weights, own[t], out=product)
                scores += product
            else:
                scores[at] += weights * own[t]
        among = np.flatnonzero(ids != query_ids[q])
        if len(among) > k:
            have = scores[among]
            among = among[have >= np.partition(have, len(have) - k)[len(have) - k]]
        order = np.lexsort((ids[among], -scores[among].astype(np.int64)))[:k]
        best = among[order]
        out_q.append(np.full(len(best), query_ids[q]))
        out_c.append(ids[best])
        out_s.append(scores[best].astype(np.int64))
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(out_q), join(out_c), join(out_s)


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for the rows with ``is_query``."""
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(True)))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable)
    own = own.groupBy("id").agg(F.min("v").alias("v"))
    asked = own.where(is_query(F.col("id")))
    counts = own.agg(F.count("*"), F.count(F.when(is_query(F.col("id")), 1))).first()
    n_blocks, n_asks = max(1, -(-counts[0] // BLOCK)), max(1, -(-counts[1] // QUERIES))
    block, ask = F.pmod(F.xxhash64("id"), F.lit(n_blocks)), F.pmod(F.xxhash64("id"), F.lit(n_asks))
    left = asked.select(ask.alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "id", "v")
    right = own.select(block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asks - 1).cast("long"))).alias("ask"), "id", "v")

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        found = (none, none, none)
        if queries.num_rows and candidates.num_rows:
            found = search_block(queries["id"].to_numpy(), _matrix(queries["v"]), candidates["id"].to_numpy(), _matrix(candidates["v"]), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    best = left.groupBy("ask", "block").cogroup(right.groupBy("ask", "block")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
with v as (
  select vec_id, list_transform(min(embedding), lambda x: floor(256 * x::double)::bigint) q
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
scored as (
  select a.vec_id query_id, b.vec_id, coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0)::bigint score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= {K}
"""
