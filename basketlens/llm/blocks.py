"""Vectors met by queries in blocks: the frames and streams that the vector searches share.

All vectors are cut into shards and all queries into blocks; a unit is one shard
and one block. A unit's rows lie together in one partition, vectors first, so a
task builds its shard's index once and streams the block's queries through it.
Shards and blocks are of equal size, which keeps the copies that are shuffled
(each vector once a block, each query once a shard) fewest for a given work of
a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.session import materialize

#: Components of a shard and of a block (as doubles: 64 MB each).
CELLS = 1 << 23
#: A shard has at least about so many vectors, even where there are more cores than shards.
LEAST_VECTORS = 4096


def finite(vector_col: str) -> F.Column:
    """True for a vector that is not null, not empty and holds finite components only."""
    x = F.col(vector_col).cast("array<double>")
    return F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def numbered(vectors: DataFrame, id_col: str, vector_col: str, **columns: F.Column) -> DataFrame:
    """``row, vec_id, x, dims`` and ``columns`` of the rows with an id and a finite vector, written once: a row's number stays."""
    rows = vectors.filter(finite(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.size(vector_col).alias("dims"),
        *[c.alias(name) for name, c in columns.items()])
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def units(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Every vector of ``rows`` with every query of ``asked`` of its length, laid out in units.

    Both hold ``row, dims, x`` and may hold other columns (null on the other side).
    Adds ``shard, block, kind`` (0: vector, 1: query); sorted by dims, shard, block, kind, row.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.groupBy("dims").agg(F.count("*").alias("n"))
    q = asked.groupBy("dims").agg(F.count("*").alias("q"))
    sizes = n.join(q, "dims").select(
        "dims",
        F.greatest(F.ceil(F.col("n") * F.col("dims") / CELLS), F.least(F.lit(4 * parts), F.ceil(F.col("n") / LEAST_VECTORS))).alias("shards"),
        F.ceil(F.col("q") * F.col("dims") / CELLS).alias("blocks"))
    sizes = F.broadcast(materialize(sizes, "sizes"))  # a row per vector length
    left = rows.join(sizes, "dims").withColumns({
        "kind": F.lit(0), "shard": F.pmod(F.xxhash64("row", F.lit(7)), "shards"), "block": F.explode(F.expr("sequence(0L, blocks - 1)"))})
    right = asked.join(sizes, "dims").withColumns({
        "kind": F.lit(1), "shard": F.explode(F.expr("sequence(0L, shards - 1)")), "block": F.pmod(F.xxhash64("row", F.lit(8)), "blocks")})
    both = left.drop("shards", "blocks").unionByName(right.drop("shards", "blocks"), allowMissingColumns=True)
    return both.repartition(2 * parts, "dims", "shard", "block").sortWithinPartitions("dims", "shard", "block", "kind", "row")


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of equal ``keys`` (integer columns without nulls) of each batch; a stretch may go on in the next batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """The vectors of a batch (all of one length) as rows of a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def ints(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
