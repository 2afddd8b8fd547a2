"""Mixing: apportionment against listing every quotient, and the mix against its contract."""

import re
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basketlens.llm import mixing


def highest_quotients(votes, seats):
    q = sorted(((-v / (2 * k + 1), key) for key, v in votes.items() if v > 0 for k in range(seats)))
    out = dict.fromkeys(votes, 0)
    for _, key in q[:seats]:
        out[key] += 1
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.integers(0, 1000), min_size=1, max_size=12), st.integers(0, 300)), min_size=1, max_size=4))
def test_apportion_is_highest_quotients(spark, groups):
    rows = [(g, k, float(v), seats) for g, (votes, seats) in enumerate(groups) for k, v in enumerate(votes) if sum(votes)]
    if not rows:
        return
    frame = spark.createDataFrame(rows, "g int, k int, v double, seats long")
    got = {(r.g, r.k): r.given for r in mixing.apportion(frame, ["g"], ["k"], "v", "seats").collect()}
    for g, (votes, seats) in enumerate(groups):
        if sum(votes):
            want = highest_quotients(dict(enumerate(map(float, votes))), seats)
            assert {k: got[g, k] for k in want} == want


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, total = set(names), share * sum(sizes.values())
    out = {}
    while left:
        rest = total - sum(out.values())
        over = {s for s in left if rest * w[s] / sum(w[t] for t in left) > most * sizes[s]}
        if not over:
            return out | {s: rest * w[s] / sum(w[t] for t in left) for s in left}
        out |= {s: most * sizes[s] for s in over}
        left -= over
    return out


def check(frame, docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    per = defaultdict(int)
    for i, _, s in docs:
        per[s] += size[i]
    want = brute_targets(per)
    source = {i: s for i, _, s in docs}
    taken = defaultdict(int)
    for r in frame.itertuples():
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == per[s]
        assert r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 70 + 0.002 * t, (s, taken[s], t)


def test_mix_of_documents(spark, sf_small):
    from basketlens.llm.queries import ORACLES, op2_mix_sources
    docs = pd.read_parquet(f"{sf_small}/documents.parquet")
    got = op2_mix_sources(spark, sf_small).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    check(got, list(zip(docs.doc_id, docs.text, docs.source)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    want = con.execute(ORACLES["op2_mix_sources"]).fetchdf()
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, want[columns].values.tolist())) == sorted(map(tuple, got[columns].values.tolist()))
    again = op2_mix_sources(spark, sf_small).toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()


def test_nulls_ties_and_empty(spark):
    rows = [(1, "a b c " * 300, "s", 1), (2, None, "s", 2), (3, "", None, 3), (4, "x y " * 500, None, 4), (5, "é ü w " * 400, "ß", 5), (6, "x y " * 500, None, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    documents, _ = mixing.mix(frame)
    check(documents.toPandas().assign(source=None), [(i, t, s) for i, t, s, _ in rows])
    repeated, _ = mixing.mix(frame.union(frame))
    assert repeated.count() == 12
    none, cut = mixing.mix(frame.limit(0))
    assert none.count() == 0 and cut.count() == 0


def test_mixed_texts_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(50 + 37 * i)), f"s{i % 3}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, _ = mixing.mix(frame)
    taken = {r.doc_id: r.taken for r in documents.collect()}
    words = defaultdict(list)
    for r in mixing.mixed_texts(frame).collect():
        words[r.doc_id] += r.text.split()
    text = {i: t.split() for i, t, _ in rows}
    assert {i: len(words[i]) for i in taken} == taken
    assert all(set(words[i]) <= set(text[i]) for i in words)
    assert all(words[i].count(w) <= 2 for i in words for w in set(words[i]))


def test_repeated_ids_are_documents_of_their_own(spark):
    """Rows that share an id, or have none: each gives at most twice its own words, and what it gives is its own."""
    rows = [(None if i % 5 == 4 else i % 3, " ".join(f"w{i}_{k}" for k in range(50 + 37 * i)), f"s{i % 2}", i) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    words = defaultdict(list)
    for r in mixing.mixed_texts(frame).collect():
        words[r.size] += r.text.split()
    text = {i: t.split() for _, t, _, i in rows}
    assert all(set(words[i]) <= set(text[i]) for i in words)
    assert all(words[i].count(w) <= 2 for i in words for w in set(words[i]))
    total = sum(map(len, text.values()))
    assert abs(sum(map(len, words.values())) - 1.5 * total) <= 140 + 0.004 * total


def test_no_id_fills_a_shard(spark):
    """A third of all rows without an id and a third with one id: their words are spread over the shards like the others'."""
    rows = [((None, 7, i)[i % 3], "a b c d e f g h " * (20 + i % 5), "s") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    laid = mixing.placed(frame).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(laid) > 10 and laid.max() < 2 * laid.median()
    documents, _ = mixing.mix(frame)
    total = documents.agg({"taken": "sum", "size": "sum"}).first()
    assert documents.count() == 3000 and abs(total["sum(taken)"] - 1.5 * total["sum(size)"]) <= 70 + 0.002 * total["sum(size)"]


def test_blocks_do_not_pass_through_the_driver(spark, monkeypatch):
    """However few Spark takes the blocks to be: no side of their join is broadcast, and they are made by as many tasks as shuffle."""
    plans, write = {}, mixing.materialize

    def seen(frame, name="state"):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return write(frame, name)

    monkeypatch.setattr(mixing, "materialize", seen)
    rows = [(i, "a b c d e f g h " * (20 + i % 5), f"s{i % 3}") for i in range(300)]
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": str(1 << 60)}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        documents, _ = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        sums = documents.agg({"taken": "sum", "size": "sum"}).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    join, = [line for line in plans["cut"].splitlines() if "Join" in line and "block#" in line]
    assert "SortMergeJoin" in join
    assert "REPARTITION_BY_NUM" in plans["cut"]
    assert abs(sums["sum(taken)"] - 1.5 * sums["sum(size)"]) <= 70 + 0.002 * sums["sum(size)"]
