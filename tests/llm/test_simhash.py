"""SimHash near-duplicates and connected components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from basketlens.llm import simhash
from basketlens.llm.components import components


def brute_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [" ".join(words[k:k + shingle]) for k in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, max_bits=3):
    """Smallest id reachable; ``fps`` is (id, fingerprint) pairs."""
    values = sorted({f for _, f in fps})
    label = {f: f for f in values}

    def find(f):
        while label[f] != f:
            f = label[f]
        return f
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                label[find(a)] = find(b)
    least = {}
    for i, f in fps:
        least[find(f)] = min(i, least.get(find(f), i))
    return {(i, f"{f:016x}", least[find(f)]) for i, f in fps}


def rows(frame):
    return {(r.doc_id, r.fingerprint, r.component_id) for r in frame.collect()}


def test_documents(spark, sf_small):
    from basketlens.llm.queries import op10_simhash_near_dedup
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert rows(op10_simhash_near_dedup(spark, sf_small)) == classes([(d.doc_id, brute_fingerprint(d.text)) for d in docs])


def near_families(rng, n):
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            f = base
            for _ in range(rng.randrange(0, 5)):
                f ^= 1 << rng.randrange(64)
            out.append(f)
    return out[:n]


@pytest.mark.parametrize("scheme", [[(list(range(64)), 3)], None, [(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(21)), 1), (list(range(21, 42)), 0), (list(range(42, 64)), 0)]])
def test_links_by_any_scheme(spark, scheme, monkeypatch):
    """Families of near fingerprints, with blocks so small that values are split."""
    rng = random.Random(7)
    monkeypatch.setattr(simhash, "SMALL", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    fps = sorted(set(near_families(rng, 60 if scheme and scheme[0][1] == 3 else 600)))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    chosen = scheme or simhash.plan(*simhash.bit_counts(frame), 3)
    assert sum(t + 1 for _, t in chosen) == 4
    label = {r.vertex: r.root for r in components(simhash.links(simhash.signatures(frame, chosen), 3)).collect()}
    want = classes(list(enumerate(fps)))
    by_root = {}
    for i, s in enumerate(signed):
        by_root.setdefault(label.get(s, s), []).append(i)
    assert {(i, min(m)) for m in by_root.values() for i in m} == {(i, c) for i, _, c in want}


def test_nulls_case_repeats_and_empty_table(spark):
    texts = [(1, None, 5), (2, " \n", 6), (None, "a b c d", 7), (3, "A b\tC  d", 8), (3, "A b\tC  d", 8), (4, "É x", 9), (5, "é x", 9), (6, "w " * 200_000, 9)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, fp int")
    got = simhash.near_duplicate_classes(frame)
    assert got.count() == len(texts)
    by = {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()}
    assert (1, "0" * 16, 1) in by and (2, "0" * 16, 1) in by
    assert (None, f"{brute_fingerprint('a b c d'):016x}", 3) in by and (3, f"{brute_fingerprint('a b c d'):016x}", 3) in by
    assert {f for i, f, _ in by if i in (4, 5)} == {f"{brute_fingerprint('É x'):016x}", f"{brute_fingerprint('é x'):016x}"}
    assert simhash.near_duplicate_classes(frame.limit(0)).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2002, 2002), (2001, 2000)]
    label = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    sets = {}
    for v, r in label.items():
        sets.setdefault(r, set()).add(v)
    assert sorted(map(sorted, sets.values())) == [list(range(301)), list(range(1000, 1200)), [2000, 2001, 2002]]
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0
