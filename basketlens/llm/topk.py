"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are cut into shards. In a shard, each dimension's values are quantised
to levels and its postings kept in segments of equal level. A query turns a
segment into an impact: the least that its vectors gain in that dimension over
the dimension's worst value. Segments of all dimensions are processed by
descending impact, each adding its impact to the accumulators of its vectors.
After each step of the schedule two bounds hold for every vector: what it has,
and what it could still have if each of its dimensions not yet seen gave the
largest impact left. When a vector's upper bound falls below the k-th best lower
bound it can be no member; processing stops when those proven out leave few
enough, or all segments are done, and every possible member is scored exactly.

Queries are taken in blocks, and a block meets every shard: one task holds one
shard and one block, never more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.session import materialize

#: Vectors of a shard and queries of a block (about).
SHARD_VECTORS, BLOCK_QUERIES = 16384, 512
#: Levels that a dimension's values are quantised to.
LEVELS = 128
#: The bounds are looked at after each such share of the postings.
CHECKS = (0.7, 0.8, 0.9, 0.95)
#: Processing may stop when at most this share of the shard is still possible.
FEW = 0.04


class Index:
    """The impact-ordered index of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x  # rows by ascending id
        n, dims = x.shape
        low = x.min(axis=0)
        width = np.maximum(x.max(axis=0) - low + 1, 1)
        level = ((x - low) * LEVELS // width).T
        self.order = np.argsort(level, axis=1, kind="stable").astype(np.int32)  # a dimension's postings, by level
        self.level = np.take_along_axis(level, self.order, axis=1).astype(np.int32)
        values = np.take_along_axis(x.T, self.order, axis=1)
        self.ends = np.stack([np.searchsorted(row, np.arange(LEVELS + 1)) for row in self.level])  # segment g: ends[g] to ends[g + 1]
        self.filled = self.ends[:, 1:] > self.ends[:, :-1]
        self.least = np.where(self.filled, _reduce(values, self.ends, np.minimum), 0)
        self.most = np.where(self.filled, _reduce(values, self.ends, np.maximum), 0)

    def search(self, q: np.ndarray, k: int, skip: int | None) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, id)``; ``skip`` is an id that takes no part. Ties go to smaller ids."""
        n, dims = self.x.shape
        up = q >= 0
        low = np.where(up[:, None], self.least, self.most) * q[:, None]  # what a segment's vectors get at least
        high = np.where(up[:, None], self.most, self.least) * q[:, None]
        worst = np.where(self.filled, low, np.iinfo(np.int64).max).min(axis=1)
        impact = low - worst[:, None]
        slack = np.where(self.filled, high - low, 0).max(axis=1).sum()  # most that quantising can hide of a vector
        weight = impact.astype(np.float64)
        sizes = np.diff(self.ends, axis=1)
        by_impact = np.argsort(-impact[self.filled], kind="stable")
        share = np.cumsum(sizes[self.filled][by_impact]) / (n * dims)
        falling = impact[self.filled][by_impact]
        # thresholds of the schedule: all segments of at least this impact are then processed
        marks = sorted({int(falling[min(np.searchsorted(share, c), len(falling) - 1)]) for c in CHECKS} | {0}, reverse=True)
        have, seen = np.zeros(n), np.zeros(n, np.int64)
        member = self.ids != skip if skip is not None else np.ones(n, bool)
        done = np.where(up, n, 0)  # impacts fall from the top level if q >= 0, else from the lowest
        for mark in marks:
            # impact falls along a dimension's levels, so what a mark adds is one slice of its postings
            reached = np.where(self.filled, impact >= mark, False)
            rows, gains = [], []
            for j in range(dims):
                g = np.flatnonzero(reached[j])
                if not len(g):
                    continue
                a, b = (int(self.ends[j, g[0]]), int(done[j])) if up[j] else (int(done[j]), int(self.ends[j, g[-1] + 1]))
                if b > a:
                    rows.append(self.order[j, a:b])
                    gains.append(weight[j].take(self.level[j, a:b]))
                    done[j] = a if up[j] else b
            if rows:
                rows = np.concatenate(rows)
                have += np.bincount(rows, np.concatenate(gains), n)  # integers below 2 ** 53: exact
                seen += np.bincount(rows, minlength=n)
            left = self.filled & ~reached
            largest = int((high - worst[:, None])[left].max()) if left.any() else 0  # that a posting can still give
            lower = have[member]
            kth = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else 0
            possible = np.flatnonzero(member & (have + slack + (dims - seen) * largest >= kth))
            if len(possible) <= max(4 * k, FEW * n):
                break
        scores = self.x[possible] @ q
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return [(int(scores[b]), int(self.ids[possible[b]])) for b in best]


def _reduce(values: np.ndarray, ends: np.ndarray, best: np.ufunc) -> np.ndarray:
    """``best`` over each segment of each row (of an empty segment: any value)."""
    return np.stack([best.reduceat(np.append(row, row[-1]), e[:-1]) for row, e in zip(values, ends)])


def top_k(vectors: DataFrame, queries: F.Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` largest integer inner products of each query with every other vector.

    ``queries``: a condition on ``id_col`` that picks the queries. A component x
    counts as floor(scale * x), x as double. ``query_id, rank, vec_id, score``;
    ties go to the smaller id; fewer than ``k`` candidates: all. A row whose
    vector or id is null, or holds a null or non-finite component, takes no
    part; vectors of different lengths are not comparable and meet only their
    own length. Repeated ids are candidates each; a query's own id is none.
    """
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * float(scale)).cast("long"))
    good = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(
        F.col(vector_col).cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = materialize(vectors.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.size(vector_col).alias("dims"), queries.alias("is_query")), "vectors")
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).withColumns({
        "shards": F.ceil(F.col("n") / SHARD_VECTORS), "blocks": F.ceil(F.col("q") / BLOCK_QUERIES)})
    dealt = rows.join(F.broadcast(counts.filter("q > 0")), "dims")  # a row per vector length
    index = dealt.select("dims", F.expr("pmod(xxhash64(vec_id, 7), shards)").alias("shard"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "vec_id", "x")
    asked = dealt.filter("is_query").select(F.col("dims").alias("q_dims"), F.explode(F.expr("sequence(0L, shards - 1)")).alias("q_shard"), F.expr("pmod(xxhash64(vec_id, 8), blocks)").alias("q_block"), F.col("vec_id").alias("query_id"), F.col("x").alias("q"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("vec_id")
            index = Index(left["vec_id"].to_numpy(np.int64), np.stack(left["x"].to_numpy()).astype(np.int64))
            for query, q in zip(right["query_id"], right["q"]):
                out += [(query, v, s) for s, v in index.search(np.asarray(q, np.int64), k, int(query))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = index.groupBy("dims", "shard", "block").cogroup(asked.groupBy("q_dims", "q_shard", "q_block")).applyInPandas(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
