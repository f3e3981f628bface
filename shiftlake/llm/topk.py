"""Operator 10: exact top-k search by inner product, by histogram selection.

Components become floor(256 * x). Each block of queries is scored against
all rows in every round. A round counts scores into a global histogram per
query, finds the bucket that holds the k-th best score and refines it, until
a bucket is one score wide; then rows at or above that score are kept and
ties go to the smaller vec_id. A task counts only scores that can still be
among the k best (its own k-th best is a bound from below), and hands on at
most k tied rows a query, so hot vectors never multiply.

Queries are taken in blocks of about ``query_bytes``, and of BLOCK_QUERIES;
only such a block and its thresholds are ever on the driver or broadcast. A
task scores SCORED_AT_ONCE of them against BLOCK_ROWS rows at a time, so its
memory is the block's histogram and one such square of scores.

Edge cases: vectors that are null or hold a null or non-finite component,
and rows without a vec_id, take no part. Only vectors of one length meet.
Every row is a candidate of every query but itself, so a repeated row, or
another row with the query's vec_id, is a result like any other, and a
repeated query returns its results once for each of its rows. Ties go to the
smaller vec_id. With fewer than k others all are returned. Empty tables give an empty result. Scores that may pass 2^61 raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import map_arrow, stored

SCALE = 256
QUERY_BYTES = 8 << 20
BLOCK_QUERIES = 1 << 14
SCORED_AT_ONCE = 1 << 11
BUCKETS = 256
BLOCK_ROWS = 1024
SCHEMA = "query_id long, rank int, vec_id long, score long"


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and q (array of whole numbers as double) of the rows that take part."""
    return (df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                      F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
            .where("vec_id is not null and size(v) > 0 "
                   "and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
            .select("vec_id", F.expr(f"transform(v, x -> double(floor(x * {SCALE})))").alias("q")))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int):
    """(ids, row numbers, matrix) of the rows with ``dim`` components, BLOCK_ROWS at a time."""
    for b in batches:
        vecs = b.column(1)
        fits = np.flatnonzero(vecs.value_lengths().to_numpy(zero_copy_only=False) == dim)
        for at in range(0, len(fits), BLOCK_ROWS):
            own = pa.array(fits[at:at + BLOCK_ROWS])
            ids = b.column(0).take(own).to_numpy()
            yield ids, b.column(2).take(own).to_numpy(), vecs.take(own).flatten().to_numpy().reshape(len(ids), dim)


def _scores(queries: np.ndarray, block: np.ndarray, whole: bool) -> np.ndarray:
    """Exact inner products: by doubles where every sum stays below 2^53, else by 64-bit integers."""
    return (queries @ block.T).astype(np.int64) if whole else queries.astype(np.int64) @ block.T.astype(np.int64)


def _chunks(n: int) -> Iterator[slice]:
    """The places of n queries, SCORED_AT_ONCE at a time."""
    return (slice(at, at + SCORED_AT_ONCE) for at in range(0, n, SCORED_AT_ONCE))


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          query_bytes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row that ``is_query`` (a condition on vec_id) names.

    Greater ``query_bytes`` (default QUERY_BYTES) mean fewer passes over the rows and more memory in each task.
    """
    rows = stored(quantised(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    spark = rows.sparkSession
    out = None
    facts = (rows.groupBy(F.size("q").alias("dim"))
             .agg(F.max(F.array_max(F.transform("q", F.abs))).alias("largest"),
                  F.sum(F.when(is_query, 1).otherwise(0)).alias("queries")).collect())  # a row per vector length
    for dim, largest, n in [tuple(x) for x in facts]:
        bound = int(largest) ** 2 * dim
        if bound >= 1 << 61:
            raise ValueError("scores may pass 2^61")
        at_once = max(1, min((query_bytes or QUERY_BYTES) // (dim * 8), BLOCK_QUERIES))
        n_blocks = max(1, math.ceil(n / at_once))
        queries = rows.where(is_query & (F.size("q") == dim))
        for b in range(n_blocks if n else 0):
            part = queries.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).orderBy("vec_id", "row").toArrow()
            if part.num_rows:
                ids = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                matrix = part.column("q").combine_chunks().flatten().to_numpy().reshape(-1, dim)
                found = _block(rows, ids, matrix, k, bound)
                out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _block(rows: DataFrame, ids: tuple[np.ndarray, np.ndarray], queries: np.ndarray, k: int, bound: int) -> DataFrame:
    """``ids``: vec_id and row number of the queries."""
    spark, dim, whole = rows.sparkSession, queries.shape[1], bound < 1 << 53
    shared = spark.sparkContext.broadcast((ids, queries))
    n = len(queries)
    low = np.full(n, -bound, dtype=np.int64)  # the k-th best score lies in [low, low + width)
    width = BUCKETS  # a power of BUCKETS that spans all scores, so every round divides evenly
    while width < 2 * bound + 1:
        width *= BUCKETS
    above = np.zeros(n, dtype=np.int64)  # scores at or beyond low + width
    while width > 1:
        step = width // BUCKETS
        counted = map_arrow(rows, _counter(shared, low, step, width, above, k, dim, whole), "query int, bucket int, n long")
        table = counted.groupBy("query", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a few buckets a query
        hist = np.zeros((n, BUCKETS + 1), dtype=np.int64)
        hist[table.column("query").to_numpy(), table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        ranked = np.cumsum(hist[:, BUCKETS - 1::-1], axis=1) + above[:, None]  # best bucket first
        reached = ranked >= k
        at = np.where(reached.any(axis=1), reached.argmax(axis=1), BUCKETS - 1)
        line = np.arange(n)
        above = np.where(at > 0, ranked[line, np.maximum(at - 1, 0)], above)
        low = low + (BUCKETS - 1 - at) * step
        width = step
    return _final(rows, shared, low, k, dim, whole)


def _counter(shared, low, step, width, above, k, dim, whole):
    def run(batches):
        (_, numbers), queries = shared.value
        hist = np.zeros((len(queries), BUCKETS), dtype=np.int64)
        for _, own, block in _blocks(batches, dim):
            for part in _chunks(len(queries)):
                s = _scores(queries[part], block, whole) - low[part, None]
                inside = (s >= 0) & (s <= min(width - 1, (1 << 63) - 1)) & (own[None, :] != numbers[part, None])
                flat = (np.arange(len(s))[:, None] * BUCKETS + s // step)[inside]
                hist[part] += np.bincount(flat, minlength=len(s) * BUCKETS).reshape(-1, BUCKETS)
        # buckets below the one with this task's own k-th best cannot hold the global one
        for part in _chunks(len(queries)):
            own = hist[part]
            ranked = np.cumsum(own[:, ::-1], axis=1)[:, ::-1]
            q, b = ((own > 0) & (ranked - own < k - above[part, None])).nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(q + part.start, pa.int32()), pa.array(b, pa.int32()),
                                              pa.array(own[q, b], pa.int64())], names=["query", "bucket", "n"])

    return run


def _final(rows, shared, low, k, dim, whole) -> DataFrame:
    def run(batches):
        (ids, numbers), queries = shared.value
        best = [[] for _ in ids]
        for vec, own, block in _blocks(batches, dim):
            for part in _chunks(len(queries)):
                s = _scores(queries[part], block, whole)
                fits = (s >= low[part, None]) & (own[None, :] != numbers[part, None])
                for i in fits.any(axis=1).nonzero()[0]:
                    at, q = fits[i].nonzero()[0], part.start + i
                    if len(at) > k:
                        at = at[np.lexsort((own[at], vec[at], -s[i, at]))[:k]]
                    best[q] = sorted([*best[q], *zip((-s[i, at]).tolist(), vec[at].tolist(), own[at].tolist())])[:k]
        out = [(int(numbers[q]), int(ids[q]), v, -s, r) for q, found in enumerate(best) for s, v, r in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)],
                                             names=["query", "query_id", "vec_id", "score", "row"])

    found = map_arrow(rows, run, "query long, query_id long, vec_id long, score long, row long")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query order by score desc, vec_id, row)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
