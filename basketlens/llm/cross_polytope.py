"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by pseudo-rotations (three rounds of random signs and
a Hadamard transform, n log n) and assigns each to the nearest signed axis. One
rotation tells 2 * dims buckets apart; where there are more vectors than those
can hold, further rotations, the last one cut to fewer axes, are joined to the
bucket until it holds about ``BUCKET`` vectors.

A query probes, in each table, the buckets whose axes lie next to its own turned
vector: combinations by the least sum of squared gaps to the nearest axis. All
vectors of the probed buckets are candidates and ranked by their exact cosine.

Vectors and probes of a bucket meet in one unit of work; a bucket with more than
a unit's share of either is split into blocks, each pair of blocks a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.blocks import CELLS, ints, matrix, numbered, runs, units
from basketlens.session import materialize

#: Hash tables, buckets probed in each, and vectors of a bucket (about). Recall at 5: see README.
TABLES, PROBES, BUCKET = 10, 18, 96
#: Hot buckets are joined map-side up to so many.
BROADCAST_ROWS = 100_000


def axes(n: int, dims: int, bucket: int) -> list[int]:
    """How many axes each rotation of a table keeps for ``n`` vectors."""
    full = 1 << max(0, dims - 1).bit_length()
    out, left = [full], n / bucket / (2 * full)
    while left >= 2:
        out.append(min(full, round(left / 2)))
        left /= 2 * out[-1]
    return out


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and Hadamard transform on rows (a power of two long)."""
    size = x.shape[1]
    for s in signs:
        x, half = x * s, 1
        while half < size:
            x = x.reshape(len(x), -1, 2, half)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), size)
            half *= 2
    return x / size ** 1.5


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a power of two is taken out first, so that squares neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosine of each row with ``q``: sums run along a row, so equal rows get equal values."""
    x, q = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1]) for v in (np.ascontiguousarray(x), q))
    return (x * q).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((q * q).sum(axis=-1)))


class Tables:
    """The hash tables for vectors of one length."""

    def __init__(self, n: int, dims: int, tables: int, bucket: int, seed: int):
        self.axes = axes(n, dims, bucket)
        self.full = self.axes[0]
        rng = np.random.default_rng([seed, dims])
        self.signs = rng.choice([-1.0, 1.0], (tables, len(self.axes), 3, self.full))

    def gaps(self, x: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Per table and rotation: distance in height of each signed axis to the nearest one."""
        x = np.pad(x, ((0, 0), (0, self.full - x.shape[1])))
        for table in self.signs:
            out = []
            for kept, signs in zip(self.axes, table):
                r = rotate(x, signs)[:, :kept]
                v = np.concatenate([r, -r], axis=1)
                out.append(v.max(axis=1, keepdims=True) - v)
            yield out

    def buckets(self, x: np.ndarray, probes: int) -> np.ndarray:
        """``(row, table, probe)``: the ``probes`` nearest buckets, nearest first (fewer, if a table has fewer)."""
        size = int(np.prod([2 * a for a in self.axes]))
        found = []
        for t, parts in enumerate(self.gaps(x)):
            cost, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for gap in parts:
                cost = (cost[:, :, None] + gap[:, None, :] ** 2).reshape(len(x), -1)
                code = (code[:, :, None] * gap.shape[1] + np.arange(gap.shape[1])).reshape(len(x), -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
            found.append(code + t * size)
        return np.stack(found, axis=1)


def hashed(rows: DataFrame, tables: int, probes: int, bucket: int, seed: int) -> DataFrame:
    """``rows`` (``row, vec_id, x, dims, n, is_query``) with ``buckets`` and, of queries, ``probes``."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], Tables] = {}
        for (dims, n, asks), batch in runs(batches, ("dims", "n", "asks")):
            if (n, dims) not in known:
                known[n, dims] = Tables(n, dims, tables, bucket, seed)
            found = known[n, dims].buckets(unit(matrix(batch)), probes if asks else 1)
            own = pa.array(list(found[:, :, 0]), longs)
            probed = pa.array(list(found.reshape(len(found), -1)) if asks else [None] * len(found), longs)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "vec_id", "x", "dims")], own, probed], ["row", "vec_id", "x", "dims", "buckets", "probes"])

    return (rows.select("row", "vec_id", "x", "dims", "n", F.col("is_query").cast("int").alias("asks")).sortWithinPartitions("dims", "asks")
            .mapInArrow(run, "row long, vec_id long, x array<double>, dims int, buckets array<long>, probes array<long>"))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET, seed: int = 42,
            id_col: str = "vec_id", vector_col: str = "embedding", unit_cells: int = CELLS) -> DataFrame:
    """The ``k`` nearest of each query among the candidates found: ``query_id, rank, vec_id, score``.

    ``queries``: a condition on ``vectors`` that picks the query rows; candidates
    are all rows but the query's own. ``score``: the cosine in double precision;
    ties go to the smaller id. A query that finds fewer than ``k`` candidates
    meets all rows instead; it returns all, if there are no more than ``k``.

    A row whose id or vector is null or empty, or whose vector is zero or holds a
    null or non-finite component, takes no part; vectors of different lengths do
    not meet. Rows that repeat an id are rows of their own, as queries too. An
    empty table gives no rows. Other columns are ignored.
    """
    nonzero = F.exists(F.col(vector_col).cast("array<double>"), lambda v: v != 0)
    rows = numbered(vectors.filter(nonzero), id_col, vector_col, is_query=F.coalesce(queries, F.lit(False)))
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = F.broadcast(rows.groupBy("dims").agg(F.count("*").alias("n")))  # a row per vector length
    index = materialize(hashed(rows.join(counts, "dims"), tables, probes, bucket, seed), "hashed")
    share = F.greatest(F.lit(1), F.floor(F.lit(unit_cells) / F.col("dims")))
    split = {}
    for side, column in (("subs", "buckets"), ("blocks", "probes")):
        sizes = index.select("dims", F.explode(column).alias("bucket")).groupBy("dims", "bucket").agg(F.count("*").alias("size"))
        split[side] = sizes.withColumn(side, F.ceil(F.col("size") / share)).filter(F.col(side) > 1).drop("size")
    hot = materialize(split["subs"].join(split["blocks"], ["dims", "bucket"], "full").fillna(1, ["subs", "blocks"]), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.join(hot, ["dims", "bucket"], "left").fillna(1, ["subs", "blocks"])

    left = dealt(index.select("row", "vec_id", "x", "dims", F.explode("buckets").alias("bucket"))).withColumns({
        "kind": F.lit(0), "sub": F.pmod(F.xxhash64("row", F.lit(7)), "subs"), "block": F.explode(F.expr("sequence(0L, blocks - 1)"))})
    right = dealt(index.filter("probes IS NOT NULL").select("row", "vec_id", "x", "dims", F.explode("probes").alias("bucket"))).withColumns({
        "kind": F.lit(1), "sub": F.explode(F.expr("sequence(0L, subs - 1)")), "block": F.pmod(F.xxhash64("row", F.lit(8)), "blocks")})
    met = left.unionByName(right).drop("subs", "blocks").repartition(2 * parts, "dims", "bucket", "sub", "block").sortWithinPartitions(
        "dims", "bucket", "sub", "block", "kind", "row")
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("candidate", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, slices, shard, out = None, [], None, []
        for (*now, kind), batch in runs(batches, ("dims", "bucket", "sub", "block", "kind")):
            if now != key:
                key, slices, shard = now, [], None
            if kind == 0:
                slices.append(batch)
                continue
            if shard is None:
                if not slices:
                    continue
                x = np.concatenate([matrix(b) for b in slices])
                shard, slices = (x, unit(x), *(np.concatenate([ints(b, c) for b in slices]) for c in ("row", "vec_id"))), []
            out.append(_best(shard, matrix(batch), ints(batch, "row"), ints(batch, "vec_id"), k))
            if sum(len(o[0]) for o in out) > 20_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    found = met.mapInArrow(run, "row long, query_id long, candidate long, vec_id long, score double")
    # a candidate met in several tables has the same score in each
    once = found.groupBy("row", "query_id", "candidate", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    best = materialize(once.withColumn("rank", rank).filter(F.col("rank") <= k), "nearest")
    done = best.filter(F.col("rank") == k).select("row")
    short = materialize(index.filter("probes IS NOT NULL").select("row", "vec_id", "x", "dims").join(done, "row", "left_anti"), "short")
    if not short.isEmpty():
        plain = index.select("row", "vec_id", "x", "dims")
        whole = units(plain, short).withColumnRenamed("shard", "sub").withColumn("bucket", F.lit(-1).cast("long"))
        again = whole.select(*met.columns).mapInArrow(run, found.schema).withColumn("rank", rank).filter(F.col("rank") <= k)
        best = best.join(short, "row", "left_anti").unionByName(again.select(*best.columns))
    return best.select("query_id", "rank", "vec_id", "score")


def _batch(out: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _best(shard: tuple, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of one bucket for each query: products choose some more than ``k``, their cosines decide."""
    x, turned, own, own_ids = shard
    step, some = max(1, 2_000_000 // len(x)), min(len(x), k + 4)
    out = []
    for a in range(0, len(q), step):
        part = q[a:a + step]
        near = unit(part) @ turned.T
        near[rows[a:a + step, None] == own] = -9
        at = np.argpartition(-near, some - 1, axis=1)[:, :some]
        score = np.where(np.take_along_axis(near, at, 1) < -2, -9, cosines(x[at], part[:, None, :]))
        order = np.lexsort((own_ids[at], -score), axis=1)[:, :k]
        at, score = np.take_along_axis(at, order, 1), np.take_along_axis(score, order, 1)
        keep = score > -2
        if len(x) > some:  # more than some may be as near as the last: all of those decide
            edge = np.partition(near, len(x) - k, axis=1)[:, len(x) - k]
            for i in np.flatnonzero((near >= edge[:, None] - 1e-9).sum(axis=1) > some):
                tied = np.flatnonzero(near[i] >= max(edge[i] - 1e-9, -2))
                exact = cosines(x[tied], part[i])
                top = np.lexsort((own_ids[tied], -exact))[:k]
                at[i, :len(top)], score[i, :len(top)], keep[i] = tied[top], exact[top], np.arange(at.shape[1]) < len(top)
        many = keep.sum(axis=1)
        at = at[keep]
        out.append((np.repeat(rows[a:a + step], many), np.repeat(ids[a:a + step], many), own[at], own_ids[at], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))
