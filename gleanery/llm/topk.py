"""Exact top-k search by inner product, score at a time over an impact-ordered index.

Vectors become integers, floor(scale * x). The index is cut into shards of a bounded number of vectors, the queries into
blocks; each shard meets each block of the stated query set once. In a shard every component is a posting (vector,
dimension) whose impact is its absolute value, and postings are held in segments of descending impact. A block takes one
segment after the other and adds its scores. What the later segments can still add to a pair is bounded twice: by the
norms of what is left (Cauchy-Schwarz), and by the largest impact left times the query's absolute sum. A query stops
when these bounds prove that few vectors can be members of its top k, or when no segment is left; the possible members,
ties included, are then scored exactly. Only k rows of each pair of query and shard leave the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, tidy_group

SHARD = 8192
BLOCK = 4096
#: Queries that are scored together within a task.
AT_ONCE = 256
#: Shares of the postings, by descending impact, at which segments end.
SEGMENTS = (0.3, 0.6)
#: Products of two vectors whose components are all below this, after scaling, are exact in 64-bit floating point.
WIDE = float(1 << 20)
#: Scores end here; those beyond count as the nearest of these.
FURTHEST = (1 << 63) - 1


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id and v, the integer components; vectors that are null, or hold null or non-finite components, are left out."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # noqa: E731  (larger ones have no fraction)
    fine = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(col(vector).isNotNull() & col(key).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(col(key).cast("long").alias("vec_id"), F.transform(col(vector), lambda x: whole(scaled(x))).alias("v"))


def _matrix(table: pa.Table) -> np.ndarray:
    """Rows of a list column as one matrix, short rows padded with zeros."""
    column = table.column("v").combine_chunks()
    at, flat = np.asarray(column.offsets), np.asarray(column.values, np.float64)
    size = np.diff(at)
    out = np.zeros((len(column), int(size.max(initial=0))))
    rows = np.repeat(np.arange(len(column)), size)
    out[rows, np.arange(len(flat[at[0] : at[-1]])) - np.repeat(at[:-1] - at[0], size)] = flat[at[0] : at[-1]]
    return out


class Shard:
    """Some vectors, their postings in segments of descending impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        impact = np.abs(self.x)
        self.kind = np.float32 if impact.max(initial=0) * most * max(1, x.shape[1]) < 1 << 24 else np.float64
        cuts = [float(c) for c in np.quantile(impact, [1 - s for s in SEGMENTS], method="lower")] if impact.size else []
        self.segments = []
        above = np.inf
        for cut in [*dict.fromkeys(cuts), -1]:
            now, rest = (impact > cut) & (impact <= above), np.where(impact <= cut, self.x, 0)
            self.segments.append((np.where(now, self.x, 0).astype(self.kind).T, np.sqrt((rest.astype(float) ** 2).sum(1)), max(cut, 0)))
            above = cut

    def best(self, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For queries q: (query index, shard row, exact score) of the k best each, ties to the smaller id."""
        out = []
        for lo in range(0, len(q), AT_ONCE):
            part, own = q[lo : lo + AT_ONCE], ids[lo : lo + AT_ONCE, None] == self.ids[None, :]
            norm, total = np.sqrt((part.astype(float) ** 2).sum(1)), np.abs(part).sum(1).astype(float)
            left = np.arange(len(part))
            score = np.zeros(own.shape, self.kind)
            for n, (segment, rest, most) in enumerate(self.segments, 1):
                score[left] += part[left].astype(self.kind) @ segment
                if n == len(self.segments):
                    slack = np.zeros((len(left), 1))
                else:
                    slack = np.minimum(norm[left, None] * rest[None, :], total[left, None] * most) * (1 + 1e-6) + 1e-3
                now = np.where(own[left], -np.inf, score[left].astype(float))
                floor = now - slack
                kth = np.partition(floor, -k, axis=1)[:, -k] if floor.shape[1] > k else np.full(len(left), -np.inf)
                possible = (now + slack >= kth[:, None]) & ~own[left]
                done = possible.sum(1) <= max(4 * k, own.shape[1] // 32) if n < len(self.segments) else np.ones(len(left), bool)
                for i in np.flatnonzero(done):
                    rows = np.flatnonzero(possible[i])
                    exact = (self.x[rows] @ part[left[i]]).astype(np.int64)
                    take = np.lexsort((rows, -exact))[:k]
                    out.append((np.full(len(take), lo + left[i]), rows[take], exact[take]))
                left = left[~done]
                if not len(left):
                    break
        return out


def _wide_best(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query index, vec_id, score) of the k best rows for each query, in whole numbers of any size."""
    numbers = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    rows, asks, out = numbers(x), numbers(q), []
    for i, ask in enumerate(asks):
        other = np.flatnonzero(ids != own[i])
        score = [max(-FURTHEST, min(FURTHEST, int(s))) for s in rows[other] @ ask] if x.shape[1] else [0] * len(other)
        best = sorted(range(len(other)), key=lambda j: (-score[j], ids[other[j]]))[:k]
        out.append((np.full(len(best), i), ids[other[best]].astype(np.int64), np.array([score[j] for j in best], np.int64)))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``vectors`` for each row of ``queries``, itself excluded.

    Both tables have the columns ``key`` and ``vector``. Ties go to the smaller vec_id; with fewer than k others, all
    are returned. Rows that share a query's id are not its candidates; of queries with one id the smallest vector
    counts. Repeated candidates are returned as often as they occur. Vectors of unlike length are compared as if padded
    with zeros. Components of any finite size take part: vectors with one of 2**20 or more after scaling are scored in
    whole numbers beside the index. Scores beyond 64 bits count as the nearest 64-bit one. Empty tables give no rows.
    """
    x, q = quantised(vectors, key, vector, scale), quantised(queries, key, vector, scale)
    q = q.groupBy("vec_id").agg(F.min("v").alias("v"))
    shards, blocks = max(1, math.ceil(vectors.count() / SHARD)), max(1, math.ceil(queries.count() / BLOCK))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), many(blocks).alias("block"), F.lit(False).alias("asks"))
    q = q.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), many(shards).alias("shard"))

    def search(table: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        asks = np.asarray(table.column("asks"))
        ids, rows = np.asarray(table.column("vec_id")), _matrix(table)
        if not asks.any() or asks.all():
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        of, own, queries, held, vectors_ = np.arange(asks.sum()), ids[asks], rows[asks], ids[~asks], rows[~asks]
        far, wide = (np.abs(m).max(axis=1, initial=0) >= WIDE for m in (queries, vectors_))
        shard = Shard(held[~wide], vectors_[~wide], float(np.abs(queries[~far]).max(initial=0)))
        found = [(of[~far][i], shard.ids[row], score) for i, row, score in shard.best(own[~far], queries[~far], k)] if len(shard.ids) else []
        for asking, rows_ in ((~far, wide), (far, np.ones(len(held), bool))):
            if asking.any() and rows_.any():
                found += [(of[asking][i], vec, score) for i, vec, score in _wide_best(held[rows_], vectors_[rows_], own[asking], queries[asking], k)]
        if not found:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        at, vec, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pa.table({"query_id": own[at], "vec_id": vec, "score": score})

    got = x.unionByName(q).groupBy("shard", "block").applyInArrow(tidy_group(search), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
