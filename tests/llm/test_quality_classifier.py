"""Co-training: held-out accuracy, the use of unlabelled rows, and odd rows."""

import numpy as np

from basketlens.llm import quality_classifier as qc


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, held against the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = qc.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    rows = [r for r in qc.score(docs, model).collect() if r.doc_id in held]
    assert len(rows) > 100
    good, bad = [r for r in rows if held[r.doc_id] == 1], [r for r in rows if held[r.doc_id] == 0]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.1
    assert all(0 <= v <= 1 for r in rows for v in (r.text_score, r.meta_score, r.score))
    assert model.pseudo[0] > 0 and model.pseudo[1] > 0  # both views taught the other


def test_unlabelled_rows_help():
    """Two views that agree given the class, few labels: co-training beats the labels alone."""
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.5).astype(int)
    view = lambda: (rng.normal(size=(4000, 30)) + np.outer(2 * y - 1, np.r_[np.full(8, 0.75), np.zeros(22)])).astype(np.float32)
    x, m = view(), view()
    some, pool, rest = slice(0, 24), slice(24, 2000), slice(2000, 4000)
    def accuracy(rounds):
        model = qc.co_train(x[some], m[some], y[some], x[pool], m[pool], rounds)
        return ((model.score(x[rest], m[rest]) > 0.5) == y[rest]).mean()
    assert accuracy(8) >= accuracy(0)


def test_pool_of_a_table_is_that_of_arrays(spark):
    """Every unlabelled row takes part: the surest of a table, copies once, are those of the distinct rows as arrays."""
    rng = np.random.default_rng(1)
    x, m = rng.normal(size=(600, 5)).astype(np.float16), rng.normal(size=(600, 4)).astype(np.float32)
    keys = [f"{i:05d}".encode() for i in range(600)]
    rows = [(keys[i], x[i].tobytes(), m[i].tobytes()) for i in range(600)]
    features = spark.createDataFrame(rows + rows[:1] * 300 + [(b"known", x[0].tobytes(), m[0].tobytes())], "key binary, x binary, m binary")
    views = [(np.array([2.0, -1, 1, 0, 1, 0.1]), np.array([2.0, 0.3])), (np.array([1.0, 2, -2, 1, 0.0]), np.array([1.5, -0.2]))]
    given = [{keys[i]: 1 for i in range(0, 600, 3)}, {keys[i]: 0 for i in range(0, 600, 4)}]
    got = qc.table_pool(features, spark.createDataFrame([(b"known",)], "key binary"))(views, given, {1: 40, 0: 25})
    want = qc.array_pool(x.astype(np.float32), m)(views, [{int(k): v for k, v in g.items()} for g in given], {1: 40, 0: 25})
    for a, b in zip(got, want):
        assert len(b) == 65 and {(int(k), label) for k, label, _ in a} == {(r, label) for r, label, _ in b}
        of = {r: f for r, _, f in b}
        assert all(np.allclose(f, of[int(k)]) for k, _, f in a)


def test_odd_rows(spark):
    good, bad = "A calm line of words that reads well enough. ", "BUY!!! $$$ NOW!!! "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 7), f"s{i % 3}", "en") for i in range(120)]
    odd = [(None, good * 9, None, None), (500, None, "s", "en"), (501, " \n", None, "en"), (502, good * 5, "new", None), (502, good * 5, "new", None), (503, bad * 20_000, None, None)]
    frame = spark.createDataFrame([(*r, True) for r in rows + odd], "doc_id long, text string, source string, lang string, kept boolean")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 100)] + [(7, 0), (7, 1), (8, None), (None, 1), (900, 1)], "doc_id long, quality int")
    model = qc.fit(frame, labels)
    out = [r for r in qc.score(frame, model).collect() if r.doc_id is None or r.doc_id >= 500]
    kept = {r.doc_id: r.kept for r in out}
    assert len(out) == 6 and kept == {None: True, 500: False, 501: False, 502: True, 503: False}
    assert qc.keep_good(frame, model).columns == frame.columns
    assert qc.keep_good(frame, model).count() == 60 + 3
    for nothing in (labels.limit(0), labels.filter("quality = 1")):
        assert qc.fit(frame, nothing) is None
    assert {r.kept for r in qc.score(frame, None).collect() if r.doc_id is not None and r.doc_id < 120} == {True}
    assert qc.score(frame.limit(0), model).count() == 0 and qc.fit(frame.limit(0), labels) is None
