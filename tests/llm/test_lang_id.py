"""Language identification: held-out accuracy, what the model may see, and odd rows."""

import zlib

from basketlens.llm import lang_id


def test_held_out_accuracy(spark, sf_small):
    from basketlens.llm.queries import op6_language_id
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = op6_language_id(spark, sf_small).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang and len(docs[r.doc_id].text) > 20]
    assert len(held) > 30 and sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_fit_is_the_same_again_and_blind_to_order(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    a, b = lang_id.fit(docs), lang_id.fit(docs.repartition(7))
    assert a.languages == b.languages and (a.centroids == b.centroids).all()


def test_odd_rows(spark):
    known = [(k, t, l) for k, (t, l) in enumerate([("the cat sat on the mat", "en"), ("der Hund lief in den Wald", "de")] * 20)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !!", "en"), (103, "the cat", None), (103, "the cat", None), (None, "der Wald", None), (104, "ÉÉ", None), (105, "the mat " * 300_000, None), (106, "中文", None)]
    frame = spark.createDataFrame([(*r, 0.5) for r in known + odd], "doc_id long, text string, lang string, score double")
    model = lang_id.fit(frame)
    got = [(r.doc_id, r.lang_pred, r.score) for r in lang_id.predict(frame, model).collect() if r.doc_id is None or r.doc_id >= 100]
    pred = {i: p for i, p, _ in got}
    assert len(got) == len(odd)
    assert [pred[i] for i in (100, 101, 102)] == ["und"] * 3 and pred[103] == pred[105] == "en" and pred[None] == "de"
    assert pred[106] in ("en", "de") and pred[104] in ("en", "de")
    assert lang_id.fit(frame.limit(0)) is None
    assert {r.lang_pred for r in lang_id.predict(frame, None).collect()} == {"und"}
    assert lang_id.predict(frame.limit(0), model).count() == 0
