"""Exact best partners by inner product of factors, without scoring all pairs.

``best_partners`` gives each left row its ``k`` right rows of largest inner
product. Right rows are cut into blocks by falling length of their vectors. No
vector of a block can give left row u more than ``|u| * longest of the block``
(Cauchy-Schwarz), so a left row is done at the first block whose bound is below
its k-th best score so far: all later blocks are shorter still.

Left rows are dealt over units of bounded size, as few as keep all cores at work:
one shuffle brings a unit its rows and every block, sorted by falling length, so
what is shuffled is the right rows times the units. A task holds its unit's rows,
their lists and one block at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# the functions below run in tasks: executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Right rows of a block, left rows of a unit at most, and at least (where there are more cores than units).
BLOCK, UNIT, LEAST_UNIT = 512, 262_144, 64
#: Scores are rounded to floats: a bound must be below by more than that.
SLACK = 1 + 1e-6
_FOUND = pa.schema([("left", pa.int32()), ("right", pa.int32()), ("score", pa.float32()), ("scored", pa.int64())])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by falling length -> one row per ``BLOCK`` of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield pa.RecordBatch.from_arrays([
                pa.array([part.column("length")[0].as_py()], pa.float64()),
                pa.array([part.column("id").to_numpy()], pa.list_(pa.int32())),
                pa.array([part.column("features").flatten().to_numpy()], pa.list_(pa.float32()))], ["length", "ids", "features"])


class Lists:
    """The running ``k`` best of a unit's left rows, best first, ties by smaller id."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, k: int):
        self.ids, self.u, self.k = ids, u.astype(np.float64), k
        self.length = np.sqrt((self.u ** 2).sum(axis=1)) * SLACK
        self.score = np.full((len(u), k), -np.inf, np.float32)
        self.right = np.full((len(u), k), np.iinfo(np.int32).max, np.int32)
        self.open = np.arange(len(u))  # rows that a shorter vector may still serve
        self.scored = np.zeros(len(u), np.int64)

    def meet(self, longest: float, ids: np.ndarray, v: np.ndarray) -> None:
        self.open = self.open[self.length[self.open] * longest >= self.score[self.open, -1]]
        step = max(1, 4_000_000 // len(ids))
        for a in range(0, len(self.open), step):
            rows = self.open[a:a + step]
            self.scored[rows] += len(ids)
            scores = (self.u[rows] @ v.T).astype(np.float32)
            hit = (scores >= self.score[rows, -1:]).any(axis=1)
            rows = rows[hit]
            if len(rows):
                self._merge(rows, scores[hit], ids)

    def _merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.score[rows], scores], axis=1)
        right = np.concatenate([self.right[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        some = min(scores.shape[1], 2 * self.k)
        at = np.argpartition(-scores, some - 1, axis=1)[:, :some]
        edge = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
        tied = np.flatnonzero((scores >= edge[:, None]).sum(axis=1) > some)  # more than those chosen may be as good as the last
        near, who = np.take_along_axis(scores, at, 1), np.take_along_axis(right, at, 1)
        order = np.lexsort((who, -near), axis=1)[:, :self.k]
        self.score[rows], self.right[rows] = np.take_along_axis(near, order, 1), np.take_along_axis(who, order, 1)
        for i in tied:
            order = np.lexsort((right[i], -scores[i]))[:self.k]
            self.score[rows[i]], self.right[rows[i]] = scores[i, order], right[i, order]

    def found(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), 20_000):
            score, right, ids, scored = (x[a:a + 20_000] for x in (self.score, self.right, self.ids, self.scored))
            some = np.isfinite(score)
            first = np.zeros(score.shape, np.int64)
            first[:, 0] = scored  # a row's pairs, told once
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                (np.repeat(ids, some.sum(axis=1)), right[some], score[some], first[some]), _FOUND)], schema=_FOUND)


def unit_count(left: DataFrame, cores: int) -> DataFrame:
    """One row ``n``: units of ``left``; more than ``cores`` only where units would be too large."""
    n = F.count("*")
    return left.agg(F.greatest(F.lit(1), F.ceil(n / UNIT), F.least(F.lit(cores), F.ceil(n / LEAST_UNIT))).cast("long").alias("n"))


def best_partners(left: DataFrame, right: DataFrame, k: int, scored: Observation | None = None) -> DataFrame:
    """``(left, right, score)``: the ``k`` right ids of largest inner product of every left id.

    Both frames hold ``id`` (int, distinct) and ``features`` (array of floats, one
    length, finite), as ALS factors do. Scores are floats; ties go to the smaller
    id; fewer than ``k`` right rows: all. ``scored`` observes ``pairs``, the number
    of pairs that had to be scored.
    """
    spark = left.sparkSession
    cores = spark.sparkContext.defaultParallelism
    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    blocks = (right.select("id", "features", length.alias("length")).orderBy(F.col("length").desc(), "id")
              .mapInArrow(_block_rows, "length double, ids array<int>, features array<float>"))
    units = unit_count(left, cores).scalar()
    rows = left.select(F.pmod(F.xxhash64("id"), units).alias("unit"), F.lit(0).alias("kind"), F.lit(0.0).alias("length"), F.array("id").alias("ids"), "features")
    copies = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), units - 1)).alias("unit"), F.lit(1).alias("kind"), "length", "ids", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, vectors, lists = None, [], [], None
        for batch in batches:
            for u, kind, longest, i, v in zip(batch.column("unit").to_pylist(), batch.column("kind").to_pylist(), batch.column("length").to_pylist(),
                                              batch.column("ids"), batch.column("features")):
                if u != unit:
                    if lists is not None:
                        yield from lists.found()
                    unit, ids, vectors, lists = u, [], [], None
                v = v.values.to_numpy()
                if kind == 0:
                    ids.append(i.values[0].as_py())
                    vectors.append(v)
                elif ids:
                    if lists is None:
                        lists = Lists(np.array(ids, np.int32), np.stack(vectors), k)
                    if len(lists.open):
                        i = i.values.to_numpy()
                        lists.meet(longest, i, v.reshape(len(i), -1).astype(np.float64))
        if lists is not None:
            yield from lists.found()

    found = (rows.unionByName(copies).repartitionById(16 * cores, F.col("unit").cast("int")).sortWithinPartitions("unit", "kind", F.col("length").desc())
             .mapInArrow(run, "left int, right int, score float, scored long"))
    if scored is not None:
        found = found.observe(scored, F.sum("scored").alias("pairs"))
    return found.drop("scored")
