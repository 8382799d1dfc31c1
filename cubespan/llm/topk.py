"""Exact top-k inner products by an impact-ordered index, a score at a time (operator 8).

The index holds blocks of vectors. In a block every dimension's components are quantised to impact levels of a
set width, and the vectors of one level form a posting segment. A query visits segments by descending impact,
that is by the size of its own component times the segment's level, and adds the quantised score to its
accumulators. What segments not visited yet can still add is bounded by the largest impact left in each
dimension, and what quantisation hides by half a level a dimension; these bounds prove which vectors can be
among the k best. A query stops only when few enough are left by that proof, or all segments are done;
those are scored exactly from the integer components.

Queries meet every block of the index; a block's k best and then the k best of all blocks are kept, ties to
the smaller id. Rows with a null id and vectors that are null or hold null or non-finite components take no part, and neither do
vectors of another length than a query's, for that query. Rows with equal ids are rows of their own; such a query asks
once, with the smallest of its vectors, and every row with its id counts as its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "query_id long, vec_id long, score long"


class Index:
    """Posting segments of one block. vectors: integers, one row a vector."""

    def __init__(self, vectors: np.ndarray, levels: int = 16) -> None:
        self.vectors = vectors
        n, dims = vectors.shape
        top = np.abs(vectors).max(axis=0) if n else np.zeros(dims, np.int64)
        self.width = np.maximum(1, -(-(top + 1) // levels))
        level = np.abs(vectors) // self.width
        sign = np.where(vectors < 0, -1, 1)
        self.segments: list[tuple[int, int, int, np.ndarray]] = []
        self.level_of = [np.unique(level[:, d])[::-1] for d in range(dims)]
        for d in range(dims):
            key = sign[:, d] * (level[:, d] + 1)
            order = np.argsort(key, kind="stable")
            values, first = np.unique(key[order], return_index=True)
            for v, ids in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                self.segments.append((d, abs(v) - 1, 1 if v > 0 else -1, ids))
        self.dim = np.array([s[0] for s in self.segments], np.int64)
        self.level = np.array([s[1] for s in self.segments], np.int64)
        self.sign = np.array([s[2] for s in self.segments], np.int64)
        #: The middle of a segment's components, and the farthest that one of them lies from it, in halves.
        self.middle2 = self.sign * (2 * self.level * self.width[self.dim] + self.width[self.dim] - 1) if self.segments else np.zeros(0, np.int64)

    def candidates(self, query: np.ndarray, k: int, few: int, step: int = 64) -> np.ndarray:
        """Rows that can be among the k best: all that can, and few at most unless more can't be told apart."""
        n = len(self.vectors)
        if n <= few or not self.segments:
            return np.arange(n)
        size = np.abs(query).astype(np.int64)
        high = (self.level + 1) * self.width[self.dim] - 1
        order = np.argsort(-(size[self.dim] * high), kind="stable")
        hidden = int((size * (self.width - 1)).sum())
        twice = np.zeros(n, np.int64)
        q2 = query.astype(np.int64)[self.dim] * self.middle2
        for at in range(0, len(order), step):
            for s in order[at : at + step].tolist():
                twice[self.segments[s][3]] += q2[s]
            left = order[at + step :]
            rest = np.zeros(len(size), np.int64)
            np.maximum.at(rest, self.dim[left], size[self.dim[left]] * high[left])
            slack = hidden + 2 * int(rest.sum())
            best = np.partition(twice, n - k)[n - k]
            if 2 * slack > int(twice.max()) - int(twice.min()):
                continue
            alive = np.flatnonzero(twice + slack >= best - slack)
            if len(alive) <= few:
                return alive
        return np.flatnonzero(twice + hidden >= best - hidden)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(block: Index, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, few: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores): the k best of a block. One row more than k is sought, as the query's own may be among them."""
    own = np.bincount(np.searchsorted(u := np.unique(ids), ids))
    repeats = dict(zip(u.tolist(), own.tolist(), strict=True))
    for q, v in zip(query_ids.tolist(), queries, strict=True):
        want = min(len(ids), k + repeats.get(q, 0))
        if not want:
            continue
        at = block.candidates(v, want, max(few, want))
        at = at[ids[at] != q]
        scores = block.vectors[at].astype(np.int64) @ v.astype(np.int64)
        top = best_of(scores, ids[at], k)
        yield q, ids[at][top], scores[top]


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v): integers floor(scale * x), of the vectors that take part."""
    e = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = 16384, query_rows: int = 2048, few: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries: rows whose id is divisible by every."""
    rows = quantised(vectors, vec_id, embedding, scale)
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks, parts = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asked / query_rows))
    spread = F.xxhash64("vec_id")
    stored = rows.withColumn("blk", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = asking.withColumn("part", F.pmod(spread, F.lit(parts)).cast("int")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(pa.array([], pa.int64()),) * 3]
        if left.num_rows and right.num_rows:
            sides = []
            for side in (left, right):
                lists = side["v"].combine_chunks()
                lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
                sides.append((side["vec_id"].to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()))
            (ids, dims, flat, off), (q_ids, q_dims, q_flat, q_off) = sides
            for d in np.intersect1d(dims, q_dims).tolist():
                at, q_at = np.flatnonzero(dims == d), np.flatnonzero(q_dims == d)
                block = Index(flat[off[at][:, None] + np.arange(d)])
                asked_for = q_flat[q_off[q_at][:, None] + np.arange(d)]
                for q, got, scores in search(block, ids[at], asked_for, q_ids[q_at], k, few):
                    found.append((pa.array(np.full(len(got), q)), pa.array(got), pa.array(scores)))
        return pa.table([pa.chunked_array(c) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    met = stored.groupBy("part", "blk").cogroup(queries.groupBy("part", "blk")).applyInArrow(run, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
