"""The pipeline: every stage against what its operator says about its own input."""

import re

import corpus_pipeline as cp
from basketlens.llm import quality_classifier
from test_packing import check
from test_simhash import brute_fingerprint, classes
from test_suffix_dedup import brute


def test_stages(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, kept = docs.columns, []
    frame = docs
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, frame, sf_small).write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(frame.collect())
        assert k == len(cp.STAGES) - 1 or frame.columns == columns
    good, single, cut, mixed, packed = kept

    source = {r.doc_id: r for r in docs.collect()}
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    assert {r.doc_id for r in good} == {r.doc_id for r in quality_classifier.score(docs, model).collect() if r.kept}
    assert all(source[r.doc_id] == r for r in good)

    want = {c for _, _, c in classes([(r.doc_id, brute_fingerprint(r.text)) for r in good])}
    assert sorted(r.doc_id for r in single) == sorted(want) and all(source[r.doc_id] == r for r in single)

    sizes = dict(zip([r.doc_id for r in single], brute([r.text.encode() for r in single], cp.REPEAT_BYTES)))
    assert {r.doc_id for r in cut} == set(sizes)
    for r in cut:
        n, gone, _, _ = sizes[r.doc_id]
        assert n - gone - 6 * (gone > 0) <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)

    text = {r.doc_id: r.text for r in cut}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert all(set(words(r.text)) <= set(words(text[r.doc_id])) for r in mixed)
    total, taken = sum(len(words(t)) for t in text.values()), sum(len(words(r.text)) for r in mixed)
    assert abs(taken - 1.5 * total) < 0.01 * total

    check([_as_document(r) for r in packed], _numbered(packed, mixed))


def _as_document(r):
    from pyspark.sql import Row
    return Row(**(r.asDict() | {"doc_id": r.document}))


def _numbered(packed, mixed):
    """document number -> text: copies of a document are told apart by their token counts and ids."""
    import zlib
    from collections import defaultdict

    import numpy as np
    from test_packing import reference_ids
    first = defaultdict(list)
    for r in packed:
        first[r.document].append((r.start, r.length, r.ids_crc32, r.doc_id))
    ids = reference_ids([r.text for r in mixed])
    by = defaultdict(list)
    for r, i in zip(mixed, ids):
        by[r.doc_id].append((r.text, i + [1]))
    out = {}
    for number, parts in first.items():
        parts.sort()
        for at, (t, i) in enumerate(by[parts[0][3]]):
            if sum(p[1] for p in parts) == len(i) and all(zlib.crc32(np.array(i[s:s + n], "<u4").tobytes()) == c for s, n, c, _ in parts):
                out[number] = t
                by[parts[0][3]].pop(at)
                break
    assert len(out) == len(first) and not any(by.values())
    return out


def test_run_is_all_stages(spark, sf_small):
    out = cp.run(spark, sf_small)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 0


def test_repeated_passages_go_and_clean_texts_stay(spark, sf_small):
    """A passage of 51 words in two texts leaves both, whatever surrounds it; texts without one stay as they are."""
    import random
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(n))
    schema = spark.read.parquet(f"{sf_small}/documents.parquet").schema
    passages = [words(51) for _ in range(20)]
    texts = [f"{words(40)} {passages[i % 20]} {words(60)}" for i in range(40)] + [words(120) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in cp.suffix_dedup_texts(spark, spark.createDataFrame(rows, schema), sf_small).collect()}
    assert all(passages[i % 20] not in got[i] and len(got[i]) <= len(texts[i]) - len(passages[i % 20]) for i in range(40) if len(passages[i % 20]) >= cp.REPEAT_BYTES)
    assert sum(len(p) >= cp.REPEAT_BYTES for p in passages) >= 18
    assert all(got[i] == texts[i] for i in range(40, 80))


def test_stages_release_the_tables_of_the_stages_before(spark, sf_small, tmp_path):
    import os
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert len(cp._tables) == 1 and not any(os.path.exists(p.removeprefix("file:")) for p in seen)
        seen += next(iter(cp._tables.values()))
        assert docs.count() > 0


def test_odd_rows(spark, sf_small):
    schema = spark.read.parquet(f"{sf_small}/documents.parquet").schema
    frame = spark.read.parquet(f"{sf_small}/documents.parquet").limit(20)
    frame = frame.union(frame).union(spark.createDataFrame([(None, None, None, None, None), (None, "no id " * 60, None, None, None), (10 ** 6, "", "en", "s", 0)], schema))
    for _, stage in cp.STAGES:
        assert stage(spark, frame.limit(0), sf_small).count() == 0
        assert stage(spark, frame, sf_small).count() > 0


def test_one_row_of_each_class_where_ids_repeat(spark, sf_small):
    """Id 5 on a text of class 3 and on one of its own: both classes keep one document, however the rows are dealt."""
    schema = spark.read.parquet(f"{sf_small}/documents.parquet").schema
    a, b, c = (" ".join(f"{x}{k * k}" for k in range(200)) for x in "abc")
    rows = [(3, a, "en", "s", len(a)), (5, a, "en", "s", len(a)), (5, b, "en", "s", len(b)), (5, c, "en", "s", len(c)), (7, b, "en", "s", len(b))]
    for k in range(len(rows)):
        got = cp.near_dedup(spark, spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(1 + k), sf_small).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted([(3, a), (5, b), (5, c)])
