"""Quality classification by co-training two views of a document.

The text view sees what is written: hashed trigrams of character classes, and
how words repeat. The metadata view sees what is known about the page without
reading it: source, language, length and layout. Starting from the labelled
rows, each view's classifier labels the unlabelled rows that it is surest of
for the other view, round after round. Both are then calibrated on labelled
rows kept apart, combined, and every document of the corpus is scored.

The labelled rows of the fit are a bounded sample (``FIT_ROWS``, the smallest by
a hash of the id). The pool is every unlabelled row of the corpus: the features
of both views are written once, each round scores all of them, and the
rows that a view is surest of, of all unlabelled rows, pass to the other view, a
share ``PASSED`` of the labelled rows in number. Rows of equal features count once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import give_back
from basketlens.session import materialize, scratch_scope

#: Labelled rows that the fit takes at most.
FIT_ROWS = 6000
#: Rounds of co-training; rows that a view labels for the other in a round, as a share of the labelled rows
#: (so that pseudo-labels stay fewer than labels), both labels by their share.
ROUNDS, PASSED = 5, 0.05
#: A pseudo-label needs this calibrated certainty.
SURE = 0.95
LEAST_ODDS = math.log(SURE / (1 - SURE))
#: One labelled row in so many is kept apart for calibration.
APART = 4
#: Documents with a lower score are rejected.
THRESHOLD = 0.5
TEXT_DIM, NAME_DIM = 768, 32
RIDGE = 1.0
CHUNK = 1 << 20
#: Rows of a fit that are held as doubles at a time.
WIDENED = 1024

#: Classes of bytes: lower-case and non-ASCII letters, capitals, digits, and each other character for itself.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def text_features(text: bytes) -> np.ndarray:
    """Content of a text: trigrams of character classes (root counts, unit length), and word repetition."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    counts = np.zeros(TEXT_DIM, np.int64)
    for at in range(0, len(raw) - 2, CHUNK):
        c = _CLASS[raw[at:at + CHUNK + 2]]
        code = ((c[:-2] << 16) | (c[1:-1] << 8) | c[2:]) * np.uint32(2654435761)
        counts += np.bincount((code >> np.uint32(12)) % TEXT_DIM, minlength=TEXT_DIM)
    grams = np.sqrt(counts)
    grams /= np.linalg.norm(grams) or 1.0
    words = text.split()
    n = max(1, len(words))
    return np.concatenate([grams * 4, [sum(map(eq, words, words[1:])) / n, len(set(words)) / n, np.log1p(n) / 5]]).astype(np.float32)


def _bucket(name: str | None) -> int:
    import zlib
    return 0 if name is None else 1 + zlib.crc32(name.encode()) % (NAME_DIM - 1)


def meta_features(source: str | None, lang: str | None, text: bytes) -> np.ndarray:
    """Metadata of a document: source, language, size, and the layout of the page."""
    out = np.zeros(2 * NAME_DIM + 9, np.float32)
    out[_bucket(source)] = out[NAME_DIM + _bucket(lang)] = 1
    n = len(text)
    if n:
        kinds = np.zeros(256, np.int64)
        for at in range(0, n, CHUNK):
            kinds += np.bincount(np.frombuffer(text, np.uint8, min(CHUNK, n - at), at), minlength=256)
        lines = kinds[10] + 1
        capitals, digits, blanks = kinds[65:91].sum(), kinds[48:58].sum(), kinds[32] + kinds[9:14].sum()
        letters = kinds[97:123].sum() + kinds[128:].sum() + capitals
        marks = n - letters - digits - blanks
        out[2 * NAME_DIM:] = [np.log(n) / 5, np.log(lines) / 3, np.log(n / lines) / 5, 5 * capitals / n, 10 * digits / n, 4 * blanks / n, 10 * marks / n,
                              5 * (kinds[kinds > 0] / n * -np.log(kinds[kinds > 0] / n)).sum() / 5, 1.0]
    return out


# ---------------------------------------------------------------- classifiers

def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by Newton's method.

    Rows are widened to doubles some at a time: what it holds beside them is small.
    """
    dim = x.shape[1] + 1
    w, penalty = np.zeros(dim), np.full(dim, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        hessian, slope = np.diag(penalty), penalty * w
        for at in range(0, len(x), WIDENED):
            part = np.ones((len(x[at:at + WIDENED]), dim))
            part[:, :-1] = x[at:at + WIDENED]
            p = sigmoid(part @ w)
            slope = slope + part.T @ (p - y[at:at + WIDENED])
            hessian = hessian + (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
        step = np.linalg.solve(hessian, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    combine: np.ndarray  # calibrated odds of both views -> odds
    text_scale: np.ndarray  # calibration of each view: slope, intercept
    meta_scale: np.ndarray
    pseudo: tuple[int, int]  # labels that the text view and the metadata view received

    def views(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated odds of both views."""
        return (_odds(x, self.text) * self.text_scale[0] + self.text_scale[1], _odds(m, self.meta) * self.meta_scale[0] + self.meta_scale[1])

    def score(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        a, b = self.views(x, m)
        return sigmoid(np.stack([a, b], axis=1) @ self.combine[:-1] + self.combine[-1])


#: Weights and calibration (slope, intercept) of a view.
View = tuple[np.ndarray, np.ndarray]
#: A pool of unlabelled rows: for the two views, the pseudo-labels that each has received (by row) and the most rows
#: of each label, the rows that each view passes on: ``(row, label, features in the other view)``.
Pool = Callable[[list[View], list[dict], dict[int, int]], list[list[tuple]]]


def _calibrated(features: np.ndarray, view: View) -> np.ndarray:
    return _odds(features, view[0]) * view[1][0] + view[1][1]


def array_pool(pool_x: np.ndarray, pool_m: np.ndarray) -> Pool:
    """A pool of rows held as arrays."""
    def surest(views: list[View], given: list[dict], most: dict[int, int]) -> list[list[tuple]]:
        passed: list[list[tuple]] = [[], []]
        for view, (own, other) in enumerate(((pool_x, pool_m), (pool_m, pool_x))):
            odds = _calibrated(own, views[view])
            fresh = np.array([r not in given[1 - view] for r in range(len(odds))], bool)
            for label, sure in ((1, odds), (0, -odds)):
                ready = np.flatnonzero(fresh & (sure >= LEAST_ODDS))
                passed[view] += [(r, label, other[r]) for r in ready[np.argsort(-sure[ready], kind="stable")][:most[label]].tolist()]
        return passed
    return surest


def table_pool(features: DataFrame, labelled: DataFrame) -> Pool:
    """The rows of a written table ``key, x, m`` whose key is not in ``labelled`` (``key``, each once).

    A round scores every row; rows of one key are one row. What reaches the
    driver is what is passed on: a share ``PASSED`` of the fit's labelled rows.
    """
    spark = features.sparkSession

    def surest(views: list[View], given: list[dict], most: dict[int, int]) -> list[list[tuple]]:
        known = [set(given[1]), set(given[0])]  # what a view need not pass on

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for view, (column, kind) in enumerate(((1, np.float16), (2, np.float32))):
                    if keys:
                        odds = _calibrated(_matrix(batch.column(column).to_pylist(), kind), views[view])
                        rows = [r for r in np.flatnonzero(np.abs(odds) >= LEAST_ODDS).tolist() if keys[r] not in known[view]]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([keys[r] for r in rows], pa.binary()), pa.array([view] * len(rows), pa.int32()), pa.array(odds[rows].astype(np.float64))], ["key", "view", "odds"])

        found = features.select("key", "x", "m").mapInArrow(run, "key binary, view int, odds double").groupBy("key", "view").agg(F.max("odds").alias("odds"))
        found = materialize(found.join(labelled, "key", "left_anti"), "surest")
        sides = [found.filter(f"view = {view} and {sign} * odds > 0").orderBy(F.col("odds") * -sign, "key").limit(most[label])
                 .select("key", "view", F.lit(label).alias("label")) for view in (0, 1) for label, sign in ((1, 1), (0, -1))]
        picked = reduce(DataFrame.union, sides).collect()
        keys = spark.createDataFrame([(k,) for k in {bytes(r["key"]) for r in picked}], "key binary")  # at most 2 * PASSED * FIT_ROWS
        rows = {bytes(r["key"]): r for r in features.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("x").alias("x"), F.first("m").alias("m")).collect()}
        passed: list[list[tuple]] = [[], []]
        for r in picked:
            of = rows[bytes(r["key"])]
            other = np.frombuffer(of["m"], np.float32) if r["view"] == 0 else np.frombuffer(of["x"], np.float16).astype(np.float32)
            passed[r["view"]].append((bytes(r["key"]), r["label"], other))
        return passed
    return surest


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, pool_x: np.ndarray | None = None, pool_m: np.ndarray | None = None, rounds: int = ROUNDS,
             pool: Pool | None = None, passed: float = PASSED) -> Model:
    """Co-train on labelled views ``x``, ``m`` with labels ``y`` (0/1, both present) and unlabelled rows: two arrays, or any ``pool``."""
    if pool is None:
        pool = array_pool(pool_x, pool_m)
    apart = np.arange(len(y)) % APART == 0
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)  # too few rows to keep any apart: calibrate on the training rows
        check = ~apart
    else:
        check = apart
    train = ~apart
    given: list[dict] = [{}, {}]  # row -> pseudo-label and features, for the text view and for the metadata view
    share = y[train].mean()
    most = {1: max(1, int(passed * train.sum() * share)), 0: max(1, int(passed * train.sum() * (1 - share)))}

    def fit(view: int) -> View:
        own = (x, m)[view]
        rows = [given[view][r] for r in sorted(given[view])]
        w = logistic(np.concatenate([own[train], *[f[None] for _, f in rows]]), np.concatenate([y[train], [label for label, _ in rows]]))
        scale = logistic(_odds(own[check], w)[:, None], y[check], ridge=1e-2)
        return w, scale

    views = [fit(0), fit(1)]
    for _ in range(rounds):
        fresh = pool(views, given, most)
        for view in (0, 1):
            given[1 - view].update({row: (label, features) for row, label, features in fresh[view]})
        if not any(fresh):
            break
        views = [fit(0), fit(1)]
    (wt, st), (wm, sm) = views
    model = Model(wt, wm, np.zeros(3), st, sm, (len(given[0]), len(given[1])))
    model.combine = logistic(np.stack(model.views(x[check], m[check]), axis=1), y[check], ridge=1e-1)
    return model


def _matrix(rows: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float32)


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> list[F.Column]:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang")]


def view_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``doc_id, key, x, m`` of every row: the features of both views as bytes, and a hash of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b
        for batch in batches:
            x, m = [], []
            for text, source, lang in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                raw = (text or "").encode()
                x.append(text_features(raw).astype(np.float16).tobytes())
                m.append(meta_features(source, lang, raw).tobytes())
            keys = [blake2b(a + b, digest_size=16).digest() for a, b in zip(x, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.binary()) for v in (keys, x, m))], ["doc_id", "key", "x", "m"])
        give_back()
    return docs.select(*_columns(docs, id_col, text_col, source_col, lang_col)).mapInArrow(run, "doc_id long, key binary, x binary, m binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality",
        fit_rows: int = FIT_ROWS, passed: float = PASSED, rounds: int = ROUNDS) -> Model | None:
    """Learn from ``docs`` that have a label (0/1; of several the larger part, a tie is none); None without rows of both labels.

    Rows with a null id have no label and are part of the pool. A row that comes
    more than once counts once. An empty table has no rows of both labels.
    """
    with scratch_scope(docs.sparkSession):
        model = _fit(view_features(docs, id_col, text_col, source_col, lang_col), labels, id_col, label_col, fit_rows, passed, rounds)
    give_back()  # the driver goes on with little
    return model


def _fit(features: DataFrame, labels: DataFrame, id_col: str, label_col: str, fit_rows: int, passed: float, rounds: int) -> Model | None:
    import zlib
    features = materialize(features, "features")
    labelled = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
                .agg(F.avg(F.col(label_col).cast("double")).alias("share")).filter("share <> 0.5").select("doc_id", F.expr("if(share > 0.5, 1, 0)").alias("y")))
    own = materialize(features.select("doc_id", "key").filter("doc_id is not null").distinct().join(labelled, "doc_id"), "labelled")
    chosen = own.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "key").limit(fit_rows).collect()
    rows = sorted((zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["key"]), r["y"]) for r in chosen)
    y = np.array([r[3] for r in rows], np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    keys = features.sparkSession.createDataFrame([(k,) for k in {r[2] for r in rows}], "key binary")  # at most fit_rows
    got = {bytes(r["key"]): (r["x"], r["m"]) for r in features.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("x").alias("x"), F.first("m").alias("m")).collect()}
    x, m = _matrix([bytes(got[r[2]][0]) for r in rows], np.float16), _matrix([bytes(got[r[2]][1]) for r in rows], np.float32)
    del got, chosen
    return co_train(x, m, y, rounds=rounds, pool=table_pool(features, own.select("key").distinct()), passed=passed)


def _scores(model: Model | None, rows: list[tuple], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both views' scores, the score and the decision for ``(text, source, lang)`` rows."""
    texts = [(t or "").encode() for t, _, _ in rows]
    some = np.array([bool(t.strip()) for t in texts], bool)
    a = b = s = np.ones(len(rows))
    if model is not None and len(rows):
        x, m = np.stack([text_features(t) for t in texts]), np.stack([meta_features(r[1], r[2], t) for r, t in zip(rows, texts)])
        a, b = map(sigmoid, model.views(x, m))
        s = model.score(x, m)
    a, b, s = (np.where(some, v, 0.0) for v in (a, b, s))
    return a, b, s, (s >= threshold) & some


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, kept)`` for every row.

    A text that is null or has no word has score 0 and is rejected. Without a
    model (no labels of both kinds) every other row has score 1 and is kept.
    Null ids, sources and languages are values like others; repeated rows come
    back as often as they come in; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s, kept = _scores(model, list(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(s), pa.array(kept)], ["doc_id", "text_score", "meta_score", "score", "kept"])
    return docs.select(*_columns(docs, id_col, text_col, source_col, lang_col)).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in (text_col, source_col, lang_col))))
            yield batch.filter(pa.array(_scores(model, rows, threshold)[3]))
        give_back()
    return docs.mapInArrow(run, docs.schema)
