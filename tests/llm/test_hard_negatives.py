"""Hard negatives against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest

import pyspark.sql.functions as F

from basketlens.llm import blocks, hard_negatives


def brute(rows, is_anchor, positives=5, negatives=10, scale=256):
    """``rows``: (id, label, vector as read)."""
    top = 2 ** 63 - 1
    good = [(i, lab, [math.floor(scale * float(c)) for c in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, lab, x) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = sorted((-max(-top - 1, min(top, sum(p * q for p, q in zip(x, y)))), j, m == lab) for b, (j, m, y) in enumerate(good) if b != a and len(y) == len(x))
        for s, j, _ in [r for r in scored if r[2]][:positives]:
            hits = [(n, -t) for t, n, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, k + 1, n, -s, t) for k, (n, t) in enumerate(hits)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_embeddings(spark, sf_small):
    from basketlens.llm.queries import ORACLES, op11_hard_negatives
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    found = got(op11_hard_negatives(spark, sf_small))
    assert found == brute(rows, lambda i: i % 100 == 0) and found
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_small}/embeddings.parquet')")
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert sorted(con.execute(f"SELECT {columns} FROM ({ORACLES['op11_hard_negatives']})").fetchall()) == found


@pytest.mark.parametrize("cells,least", [(1 << 23, 4096), (40, 7)])
def test_odd_vectors(spark, monkeypatch, cells, least):
    """Nulls, infinities, copies, ties, repeated ids, other lengths, huge components, one label on most rows; small and large shards and blocks."""
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "LEAST_VECTORS", least)
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), [rng.choice([-1.0, 0.0, 0.25, 1.0, 3.75]) for _ in range(5)]) for i in range(90)]
    rows += [(90 + i, rows[3][1], rows[3][2]) for i in range(15)] + rows[8:12] + [
        (110, 1, None), (120, 1, [1.0, None, 0.0, 0.0, 0.0]), (130, 2, [float("nan")] * 5), (140, 2, [float("inf")] * 5), (150, None, [1.0] * 5),
        (None, 1, [1.0] * 5), (160, 1, []), (170, 1, [1.0, 2.0]), (171, 2, [0.5, 1.0]), (180, 1, [2.0, 1.0]), (190, 2, [1e300] * 3), (200, 2, [1e299] * 3),
        (191, 1, [1e12, 1.0, 0.5]), (210, 1, [1e12, 2.0, -7.25]), (220, 2, [5e11, 3.0, 1.0])]
    frame = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows], "vec_id long, label int, embedding array<double>, score string")
    anchors = F.col("vec_id") % 10 == 0
    assert got(hard_negatives.mine(frame, anchors, F.col("label"))) == brute(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(frame.limit(0), anchors, F.col("label")).count() == 0


def test_bitmap_shrinks_and_scores_stay_exact():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 32)) / 6
    x[:, :4] *= 8  # some dimensions decide
    columns, whole = hard_negatives.Columns(x, 256), np.floor(256 * x)
    read = 0
    for i in range(0, 4000, 250):
        scores = whole @ whole[i]
        at, exact, n = columns.scan(x[i], np.arange(4000) != i, hard_negatives.among_best(5))
        assert (exact == scores[at]).all() and set(np.argsort(-np.where(np.arange(4000) == i, -np.inf, scores))[:5]) <= set(at)
        a, b = int(0.5 * scores[i]), int(0.6 * scores[i])
        inside, kept, m = columns.scan(x[i], np.ones(4000, bool), hard_negatives.in_windows([(a, b)], 10))
        want = np.sort(scores[(scores >= a) & (scores <= b)])[::-1][:10]
        assert (np.sort(kept[(kept >= a) & (kept <= b)])[::-1][:10] == want).all()
        read += n + m
    assert read < 0.8 * 16 * 2 * 4000 * 32
