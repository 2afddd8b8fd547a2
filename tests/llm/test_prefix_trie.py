"""Prefix trie against brute force over all prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from basketlens.llm import prefix_trie


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    whole = {c: convs.get(c - int(math.fmod(c, 100)), [])[:zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6:] for c, v in convs.items()}
    members, children = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(conversations):
    return sorted((tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.positions(conversations))).collect()), key=str)


def test_conversations(spark, sf_small):
    from basketlens.llm.queries import ORACLES, op13_prefix_trie
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = sorted((tuple(r) for r in op13_prefix_trie(spark, sf_small).collect()), key=str)
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_small}/conversations.parquet')")
    columns = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert sorted(con.execute(f"SELECT {columns} FROM ({ORACLES['op13_prefix_trie']})").fetchall(), key=str) == found


@pytest.mark.parametrize("segment,stretch", [(64, 200_000), (2, 25)])
def test_odd_conversations(spark, monkeypatch, segment, stretch):
    """Nulls in every column, equal and missing turns, copies, a conversation of 300 turns twice, negative and huge ids, one on a third of the rows."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ü\n", "long " * 50])) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "user", f"t{t % 7}") for c in (100, 207, 300) for t in range(300)]
    rows += [(c, t, "user", "same") for c in range(400, 480) for t in range(3)]
    rows += [(c, t, "x", "y") for c in (-7, -100, -107, 2 ** 62) for t in range(4)]
    rows += [(500, None, None, None), (500, None, "user", None), (501, None, None, ""), (502, 1, None, "q"), (502, 1, "", "q"), (503, 1, "", "\0"), (None, 1, "user", "lost")]
    rows += [(c, 0, "user", "short") for c in range(600, 640)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn int, role string, text string, depth int, path string")
    assert got(frame) == brute(rows)
    assert got(frame.limit(0)) == []


def test_double_array():
    rng = random.Random(6)
    sequences = sorted({tuple(rng.randrange(40) for _ in range(rng.randrange(6))) for _ in range(800)})
    trie = prefix_trie.DoubleArray(sequences)
    prefixes = {s[:d] for s in sequences for d in range(len(s) + 1)}
    at = {}
    for s in sequences:
        node = 0
        for d, code in enumerate(s):
            node = trie.child(node, code)
            assert node > 0 and at.setdefault(s[:d + 1], node) == node
    assert len(set(at.values())) == len(at) == len(prefixes) - 1 == len(trie.order) - 1
    assert len(trie.check) < 3 * len(prefixes)
    assert all(trie.child(node, code) == -1 for p, node in list(at.items())[:200] for code in range(40) if (*p, code) not in prefixes)


def test_arrays_stay_small_where_many_nodes_have_many_children():
    sequences = sorted((a, 1000 * a + b, c) for a in range(300) for b in range(12) for c in range(2))
    trie = prefix_trie.DoubleArray(sequences)
    assert len(trie.order) == 1 + 300 + 300 * 12 + 300 * 24 and len(trie.check) < 1.5 * len(trie.order)
