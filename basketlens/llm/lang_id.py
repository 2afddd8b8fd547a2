"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text becomes the counts of its byte trigrams (lower-cased letters, everything
else a blank), hashed to ``DIM`` numbers, square-rooted, weighted by inverse
document frequency and scaled to length one. Each language has several
centroids, found by spherical k-means over its training texts; a text gets the
language of the centroid with the largest cosine. A text farther from its
centroid than nearly all training texts of it is flagged as rejected.

The model is fitted on a bounded sample of labelled rows (``PER_LANGUAGE`` of
each language, by hash of the id); every row is then classified whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 4096
#: Labelled rows of each language that the fit takes (expected number; a row is in or out by its id's hash).
PER_LANGUAGE = 1000
CENTROIDS = 4
KMEANS_ROUNDS = 12
#: Share of a centroid's training texts that lie beyond its rejection distance.
BEYOND = 0.002
#: Bytes counted at a time (bounds memory for very long texts).
CHUNK = 1 << 20

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text) if not any("a" <= c <= "z" or "A" <= c <= "Z" for c in text[:64]) else True


def trigram_counts(text: str, dim: int = DIM) -> np.ndarray:
    """Hashed counts of the byte trigrams of a text (a blank on both sides)."""
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    counts = np.zeros(dim, np.int64)
    for at in range(0, len(raw) - 2, CHUNK):
        b = _LETTERS[raw[at:at + CHUNK + 2]].astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[(b[:-2] != 32) | (b[1:-1] != 32)]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - (dim - 1).bit_length()), minlength=dim)
    return counts


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # centroid x DIM, unit length
    farthest: np.ndarray  # least cosine that is not rejected, per centroid
    idf: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts) * self.idf
        n = np.sqrt((v * v).sum(axis=-1, keepdims=True))
        return (v / np.where(n > 0, n, 1)).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = KMEANS_ROUNDS) -> np.ndarray:
    """Centroids (unit length) of unit vectors; starts far apart, beginning at the mean's nearest row."""
    mean = x.mean(axis=0)
    picks = [int((x @ mean).argmax())]
    near = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model | None:
    """Learn from ``rows`` with a language and a text that has a letter; None if there are none."""
    labelled = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    if not sizes:
        return None
    draw = F.conv(F.substring(F.sha2(F.coalesce(F.col("id"), F.lit(0)).cast("string"), 256), 1, 8), 16, 10).cast("double") / 2 ** 32
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["n"]))).otherwise(rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yes = [has_letter(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([np.minimum(trigram_counts(t), 65535).astype(np.uint16).tobytes() for t, y in zip(texts, yes) if y], pa.binary()), batch.column(1).filter(pa.array(yes))], ["counts", "lang"])

    got = labelled.filter(draw < rate).select("text", "lang", "id").mapInArrow(run, "counts binary, lang string").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["counts"])))  # the order of arrival is not fixed
    counts = np.stack([np.frombuffer(r["counts"], np.uint16) for r in got]).astype(np.float32)
    langs = np.array([r["lang"] for r in got])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1
    model = Model([], np.empty((0, DIM), np.float32), np.empty(0), idf.astype(np.float32))
    for lang in sorted(set(langs)):
        x = model.vector(counts[langs == lang])
        c = spherical_kmeans(x, centroids)
        best = (x @ c.T).max(axis=1)
        model.languages += [lang] * len(c)
        model.centroids = np.concatenate([model.centroids, c])
        model.farthest = np.concatenate([model.farthest, np.full(len(c), np.quantile(best, BEYOND))])
    return model


def predict(rows: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row, from its text alone.

    ``score`` is the cosine to the nearest centroid (0 to 1). ``lang_pred`` is
    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. ``rejected`` marks texts too far from the centroid to trust, ``und``
    included. Null ids and repeated rows come back as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            known = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
            for at in range(0, len(known), 64):
                part = known[at:at + 64]
                cos = np.clip(model.vector(np.stack([trigram_counts(texts[k]) for k in part])) @ model.centroids.T, 0, 1)
                best = cos.argmax(axis=1)
                for k, j, c in zip(part, best.tolist(), cos[np.arange(len(part)), best].tolist()):
                    lang[k], score[k], far[k] = model.languages[j], c, c < model.farthest[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the quarter of ids (by crc32 of the id as text) that the fit must not see; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
