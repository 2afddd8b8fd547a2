"""Suffix-array dedup against brute force, and its merge against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from basketlens.llm import suffix_dedup as sd


def brute(texts, length):
    count = Counter(t[s:s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if count[t[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def edited(rng, text, edits):
    out = bytearray(text)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.randrange(97, 123)
    return bytes(out)


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(spark, seed):
    """Copies, edited copies, shared passages of just about the length, short periods, inner repeats."""
    rng = random.Random(seed)
    rand = lambda n, letters=b"abcdefgh": bytes(rng.choice(letters) for _ in range(n))
    length, texts = 24, [b"", b"a" * 23, b"a" * 24, b"a" * 60, b"ab" * 40]
    passages = [rand(n) for n in (23, 24, 25, 30, 40)]
    for _ in range(25):
        base = rand(rng.randrange(5, 150))
        texts.append(base)
        texts += [edited(rng, base, rng.randrange(0, 6)) for _ in range(rng.randrange(0, 4))] if base else []
        texts.append(rand(rng.randrange(0, 40)) + rng.choice(passages) + rand(rng.randrange(0, 40)))
        texts.append(rand(10) + rng.choice(passages) + rand(5) + rng.choice(passages))
    texts += [rand(100, b"ab") for _ in range(3)]
    frame = spark.createDataFrame([(k, t.decode(), k % 3) for k, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    frame = frame.withColumnRenamed("n_bytes", "sha")  # a clashing name
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup_texts(frame, length=length, gram=8).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, length)


def test_small_ranges(spark, monkeypatch):
    """Many ranges: neighbours across range ends count."""
    monkeypatch.setattr(sd, "RANGE_STRINGS", 7)
    monkeypatch.setattr(sd, "SAMPLES_PER_RANGE", 100)
    monkeypatch.setattr(sd, "RUN_BYTES", 3000)
    rng = random.Random(5)
    base = [bytes(rng.choice(b"abcd") for _ in range(120)) for _ in range(6)]
    texts = [edited(rng, b, k % 4) for b in base for k in range(5)]
    frame = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup_texts(frame, length=20, gram=8).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 20)


def test_documents(spark, sf_small):
    from basketlens.llm.queries import op3_suffix_array_dedup
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], brute([(d.text or "").encode() for d in docs], 400)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_array_dedup(spark, sf_small).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None), (None, "é" * 300), (None, "é" * 300), (2, "x" * 500), (2, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed) for r in sd.dedup_texts(frame).collect()))
    assert got == [(0, 600, 600), (0, 600, 600), (1, 0, 0), (2, 5, 0), (2, 500, 500)]
    assert sd.dedup_texts(frame.limit(0)).count() == 0
    kept = sorted(r.text or "" for r in sd.remove_repeats(frame).collect())
    assert kept == ["", "", "", "", "short"]


def test_merge_is_a_sort():
    rng = random.Random(3)
    for k in range(1, 12):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 20))}) for _ in range(k)]
        blocks = []
        for r, run in enumerate(runs):
            entries = [(s, sd.common_prefix(run[i - 1], s, 0) if i else 0, [r], [i]) for i, s in enumerate(run)]
            blocks.append([sd.encode(entries[at:at + 4]) for at in range(0, len(entries), 4)])
        out = list(sd.merge([sd.Run(list(b)) for b in blocks]))
        assert [o[0] for o in out] == sorted(s for run in runs for s in run)
        for a, b in zip(out, out[1:]):
            assert b[1] == sd.common_prefix(a[0], b[0], 0)
        assert sorted((int(o[2][0]), int(o[3][0])) for o in out) == [(r, i) for r, run in enumerate(runs) for i in range(len(run))]
