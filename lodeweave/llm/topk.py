"""Exact top-k inner-product search by columnar branch-and-bound (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Dimensions that are accumulated before candidates are bounded again.
DIMENSIONS = 16
#: Queries that one cell of the grid holds, and candidates at least and at most.
QUERY_BLOCK, LEAST_BLOCK, MOST_BLOCK = 2048, 1024, 32768

_SHAPE = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component as ``v``; vectors that are null, empty or hold a null or non-finite component, or whose vec_id is null, take no part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, step: int = DIMENSIONS) -> tuple[list, list, list]:
    """The k best candidates of each query, ties to the smaller id: exact integer scores.

    ``vectors`` lies dimension by dimension, those of greatest mass first. After each block of dimensions a candidate's score is at
    most what has been accumulated plus the product of both remaining norms; it is dropped once that is below the k-th best of
    some exactly known scores, and the survivors' columns are compacted.
    """
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    kind = np.float64 if reach < 2**52 else np.int64  # both add exactly
    by_mass = np.argsort(-np.square(vectors.astype(np.float64)).sum(axis=0), kind="stable")
    columns, rows = np.ascontiguousarray(vectors[:, by_mass].T.astype(kind)), queries[:, by_mass].astype(kind)
    cuts = list(range(0, len(columns), step))

    def rest(x: np.ndarray) -> np.ndarray:  # norms of what is left after each block
        mass = np.square(x.astype(np.float64)).reshape(len(x), -1)
        tail = np.cumsum(mass[::-1], axis=0)[::-1]
        return np.sqrt(np.stack([tail[c + step] if c + step < len(tail) else np.zeros(mass.shape[1]) for c in cuts]))

    left, own_left = rest(columns), rest(rows.T)
    out: tuple[list, list, list] = ([], [], [])
    few = max(1, min(len(rows), (1 << 21) // max(1, len(ids))))
    for a in range(0, len(rows), few):
        first = rows[a : a + few, :step] @ columns[:step]
        for i, partial in enumerate(first, a):
            own = ids == query_ids[i]
            best = partial.astype(np.float64) + own_left[0, i] * left[0]
            best[own] = -np.inf
            n = len(ids) - int(own.sum())
            if not n:
                continue
            floor = -np.inf
            if n > k:
                seeds = np.argpartition(-best, k - 1)[:k]
                floor = float((rows[i] @ columns[:, seeds]).min())
            alive = np.flatnonzero((best >= floor - 1e-6 * abs(floor) - 1) & ~own)
            score = partial[alive]
            for b, c in enumerate(cuts[1:], 1):
                score = score + rows[i, c : c + step] @ columns[c : c + step, alive]
                keep = score + own_left[b, i] * left[b, alive] >= floor - 1e-6 * abs(floor) - 1
                alive, score = alive[keep], score[keep]
            order = np.lexsort((ids[alive], -score))[:k]
            out[0].extend([int(query_ids[i])] * len(order))
            out[1].extend(ids[alive[order]].tolist())
            out[2].extend(score[order].astype(np.int64).tolist())
    return out


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """For each row of ``queries`` (vec_id, v) its k best rows of ``vectors`` (vec_id, v) by integer inner product: query_id, rank (from 1), vec_id, score.

    Rows are dealt by hash into blocks of candidates and blocks of queries; each cell of that grid is searched in a task of bounded
    size and gives k rows a query, and the best k of those are merged. Only vectors of the query's width are its candidates.
    A row never is its own candidate, nor is another with its vec_id; a repeated query counts once, a repeated candidate as often as it is there.
    """
    n, m = vectors.count(), queries.count()
    size = max(LEAST_BLOCK, min(MOST_BLOCK, n // 32))
    blocks, sets = max(1, -(-n // size)), max(1, -(-m // QUERY_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    deal = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int")
    candidates = vectors.select("vec_id", "v", F.size("v").alias("width"), deal(blocks, 1).alias("block"), every(sets).alias("set"))
    asked = queries.dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("width"), deal(sets, 2).alias("set"), every(blocks).alias("block"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            matrix = lambda t, name: t.column(name).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            found = search_block(left.column("query_id").to_numpy(), matrix(left, "q"), right.column("vec_id").to_numpy(), matrix(right, "v"), k)
        return pa.table([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    key = ["width", "block", "set"]
    found = asked.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(cell, _SHAPE)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
