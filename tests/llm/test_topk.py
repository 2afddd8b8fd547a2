"""Exact top-k search against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest

from basketlens.llm import topk


def brute(vectors, is_query, k, scale=1024):
    good = {}
    rows = []
    for i, v in vectors:
        if i is None or v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v):
            continue
        rows.append((i, [math.floor(scale * float(np.float32(c))) for c in v]))
    out = set()
    for q, x in rows:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(y) == len(x))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def got(frame):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect()}


def test_embeddings(spark, sf_small):
    from basketlens.llm.queries import ORACLES, op8_exact_top_k
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    found = got(op8_exact_top_k(spark, sf_small))
    assert found == brute(rows, lambda i: i % 100 == 0, 10)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_small}/embeddings.parquet')")
    want = con.execute(ORACLES["op8_exact_top_k"]).fetchdf()
    assert {tuple(map(int, r)) for r in want[["query_id", "rank", "vec_id", "score"]].itertuples(index=False)} == found


@pytest.mark.parametrize("shard,block", [(16384, 512), (7, 2)])
def test_odd_vectors(spark, monkeypatch, shard, block):
    """Nulls, infinities, copies, ties, zero vectors, few candidates, other lengths."""
    monkeypatch.setattr(topk, "SHARD_VECTORS", shard)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 1.0, 3.7]) for _ in range(5)]) for i in range(60)]
    rows += [(60 + i, rows[3][1]) for i in range(15)] + [(100, [0.0] * 5), (101, None), (102, [1.0, None, 0.0, 0.0, 0.0]), (110, [float("nan")] * 5), (120, [float("inf")] * 5), (None, [1.0] * 5), (130, []), (140, [1.0, 2.0]), (141, [2.0, 1.0]), (150, [1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    import pyspark.sql.functions as F
    assert got(topk.top_k(frame, F.col("vec_id") % 10 == 0, k=4)) == brute(rows, lambda i: i % 10 == 0, 4)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_stops_early_and_stays_exact():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(3000, 32)) / 6 * 1024).astype(np.int64)
    index = topk.Index(np.arange(3000), x)
    for i in range(0, 3000, 97):
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(3000), -s)) if j != i][:10]
        assert index.search(x[i], 10, i) == [(int(s[j]), int(j)) for j in order]
