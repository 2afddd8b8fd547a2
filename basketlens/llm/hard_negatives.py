"""Hard-negative mining by a vertical scan (branch and bound on decomposed data).

A shard of vectors is kept column by column, with the least and the largest
value of each dimension. An anchor reads the columns in descending order of its
own magnitudes, some at a time. What a candidate has so far, plus the least and
the most that the columns not yet read can give, bounds its score; candidates
whose bounds rule them out leave the bitmap, and only those left are read on.
When all columns are read, the scores of the candidates left are exact.

Two scans: the first finds each anchor's positives, the best rows of its label.
They open windows of scores, and the second scan finds the best rows of other
labels in each window; a candidate stays while it may yet lie in a window and
rank among the first there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.blocks import ints, matrix, numbered, runs, units
from basketlens.session import materialize

#: Bounds are looked at so many times in a scan.
CHECKS = 8
LONG = np.iinfo(np.int64)

Narrow = Callable[[np.ndarray, np.ndarray], "np.ndarray | None"]


class Columns:
    """A shard by columns. Integers: as doubles where every sum is exact, else as Python integers."""

    def __init__(self, x: np.ndarray, scale: int):
        self.scale = scale
        self.columns = np.ascontiguousarray(_floor(x, scale).T)
        self.most = float(np.abs(self.columns).max(initial=1.0))
        self._big: np.ndarray | None = None

    def scan(self, q: np.ndarray, bitmap: np.ndarray, narrow: Narrow) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions that ``narrow`` leaves of ``bitmap``, their exact scores, and the number of values read.

        ``narrow(least, most)`` gets bounds of the scores of what is left and
        tells what stays (None: all).
        """
        q = _floor(q, self.scale)
        columns = self.columns
        if len(q) * self.most * float(np.abs(q).max(initial=1.0)) >= 2 ** 51:
            if self._big is None:
                self._big = _integers(self.columns)
            columns, q = self._big, _integers(q)
        order = np.argsort(-np.abs(q), kind="stable")
        a, b = q * columns.min(axis=1), q * columns.max(axis=1)
        least, most = (np.append(np.cumsum(side[order][::-1])[::-1], 0) for side in (np.minimum(a, b), np.maximum(a, b)))
        at = np.flatnonzero(bitmap)
        part, read, step = np.zeros(len(at), dtype=q.dtype), 0, -(-len(q) // CHECKS)
        for start in range(0, len(q), step):
            dims = order[start:start + step]
            part = part + q[dims] @ columns[dims].take(at, axis=1)
            read += len(dims) * len(at)
            stays = narrow(part + least[start + len(dims)], part + most[start + len(dims)])
            if stays is not None:
                at, part = at[stays], part[stays]
        return at, part, read


def _floor(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); beyond a double the largest double."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(x * scale, -np.finfo(np.float64).max, np.finfo(np.float64).max))


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def _kth(scores: np.ndarray, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k]


def among_best(k: int) -> Narrow:
    """Stays: what may be among the ``k`` largest."""
    return lambda least, most: most >= _kth(least, k) if len(least) > k else None


def in_windows(windows: list[tuple[int, int]], k: int) -> Narrow:
    """Stays: what may be among the ``k`` largest inside one of the windows (ends included)."""
    def narrow(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        near = np.flatnonzero((most >= min(w[0] for w in windows)) & (least <= max(w[1] for w in windows)))
        low, high, stays = least[near], most[near], np.zeros(len(near), bool)
        for a, b in windows:
            sure = low[(low >= a) & (high <= b)]
            edge = max(a, _kth(sure, k)) if len(sure) > k else a
            stays |= (high >= edge) & (low <= b)
        out = np.zeros(len(least), bool)
        out[near[stays]] = True
        return out
    return narrow


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` largest ``(score, id)``, ties by smaller id; a score beyond a long is the nearest long."""
    if len(scores) > k:
        sure = scores >= _kth(scores, k)
        scores, ids = scores[sure], ids[sure]
    if scores.dtype == object:
        scores = np.array([min(max(s, int(LONG.min)), int(LONG.max)) for s in scores], dtype=np.int64)
    order = np.lexsort((ids, -scores.astype(np.float64)) if scores.dtype != np.int64 else (ids, np.invert(scores)))[:k]
    return [(int(scores[i]), int(ids[i])) for i in order]


class _Shard:
    def __init__(self, slices: list[pa.RecordBatch], scale: int):
        self.columns = Columns(np.concatenate([matrix(b) for b in slices]), scale)
        self.rows, self.ids, self.labels = (np.concatenate([ints(b, c) for b in slices]) for c in ("row", "vec_id", "label"))


def _scanned(scale: int, answer: Callable, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream units: ``answer(shard, row, label, q, windows)`` gives the rows of one query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, slices, shard = None, [], None
        for (*key, kind), batch in runs(batches, ("dims", "shard", "block", "kind")):
            if key != unit:
                unit, slices, shard = key, [], None
            if kind == 0:
                slices.append(batch)
            elif slices or shard:
                if shard is None:
                    shard, slices = _Shard(slices, scale), []
                out = []
                for row, vec_id, label, q, wanted in zip(ints(batch, "row").tolist(), ints(batch, "vec_id").tolist(), ints(batch, "label").tolist(),
                                                         matrix(batch), batch.column("positives").to_pylist()):
                    out += [(row, vec_id, *found) for found in answer(shard, row, label, q, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(schema), schema)], schema=schema)
    return run


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors``: a condition on ``vectors`` that picks the anchor rows; ``label``
    an integer column. A component x counts as floor(scale * x), x as double; a
    score is an integer inner product. Positives: the first ``positives`` other
    rows of the anchor's label by score, ties by smaller id. Negatives of a
    positive: the first ``negatives`` rows of other labels whose score lies from
    ``low`` to ``high`` percent of the positive's (none, if that is below zero).

    A row whose id, label or vector is null or empty, or whose vector holds a null
    or non-finite component, takes no part; vectors of different lengths do not
    meet. Rows that repeat an id are rows of their own, as anchors too, and only
    a row itself is not among its others. An anchor without positives or without
    negatives gives no row, and neither does an empty table. A score beyond a long
    is the nearest long. Other columns are ignored.
    """
    rows = numbered(vectors.filter(label.isNotNull()), id_col, vector_col, label=label.cast("long"), is_anchor=F.coalesce(anchors, F.lit(False)))
    plain = rows.drop("is_anchor")
    asked = rows.filter("is_anchor").drop("is_anchor")
    pair = [("row", pa.int64()), ("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]

    def best_of_label(shard: _Shard, row: int, own: int, q: np.ndarray, wanted) -> list[tuple]:
        at, scores, _ = shard.columns.scan(q, (shard.labels == own) & (shard.rows != row), among_best(positives))
        return [(i, s) for s, i in _first(scores, shard.ids[at], positives)]

    found = units(plain, asked.withColumn("positives", F.lit(None).cast("array<long>"))).mapInArrow(
        _scanned(scale, best_of_label, pa.schema(pair)), "row long, anchor_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    best = materialize(found.withColumn("place", place).filter(F.col("place") <= positives), "positives")
    # at most ``positives`` scores an anchor
    windows = best.groupBy("row").agg(F.sort_array(F.collect_set("score")).alias("positives"))

    def of_windows(shard: _Shard, row: int, own: int, q: np.ndarray, wanted: list[int]) -> list[tuple]:
        edges = [(-(-low * s // 100), high * s // 100) for s in wanted]
        edges = {s: e for s, e in zip(wanted, edges) if e[0] <= e[1]}
        if not edges:
            return []
        at, scores, _ = shard.columns.scan(q, shard.labels != own, in_windows(list(edges.values()), negatives))
        out = []
        for s, (a, b) in edges.items():
            inside = (scores >= a) & (scores <= b)
            out += [(s, i, n) for n, i in _first(scores[inside], shard.ids[at[inside]], negatives)]
        return out

    hit = [("row", pa.int64()), ("anchor_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())]
    near = units(plain, asked.join(windows, "row")).mapInArrow(
        _scanned(scale, of_windows, pa.schema(hit)), "row long, anchor_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id"))
    ranked = near.drop("anchor_id").withColumn("rank", rank).filter(F.col("rank") <= negatives)
    pairs = best.select("row", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(ranked, ["row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
