"""Quality rules: statistics against brute force, and the robust estimate's verdicts."""

import random
import re

import numpy as np
import pytest

from basketlens.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_statistics():
    rng = random.Random(0)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", "c\t", "\n", "é", "# ", "<|", " ", "\x0b", "\x1c", "\x85", " ", "ab \n"]) for _ in range(rng.randrange(0, 60)))
        assert qr.statistics(text)[:5] == brute(text), text


def test_documents(spark, sf_small):
    from basketlens.llm.queries import op4_quality_rules
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    rows = op4_quality_rules(spark, sf_small).collect()
    assert len(rows) == len(docs)
    kept = {0: [], 1: []}
    for r in rows:
        n_words, chars, symbols, dup, repeat = brute(docs[r.doc_id]) if len(docs[r.doc_id] or "") < 8000 else qr.statistics(docs[r.doc_id])[:5]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, dup, repeat)
        assert r.base_failed == (n_words < 50 or 100 * repeat > 50 * n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id in label and not r.base_failed:
            kept[label[r.doc_id]].append(r.kept)
    assert np.mean(kept[1]) > 0.95 and np.mean(kept[0] or [0]) < 0.35


def test_chi_square():
    assert qr.chi_square(2 * np.log(2), 2) == pytest.approx(0.5)
    assert qr.CUTOFF == pytest.approx(38.26, abs=0.05)
    rng = np.random.default_rng(0)
    d = (rng.normal(size=(400_000, qr.P)) ** 2).sum(axis=1)
    inner = rng.normal(size=(400_000, qr.P))
    inner = inner[(inner ** 2).sum(axis=1) <= qr.chi_square_quantile(qr.SUBSET, qr.P)]
    assert np.mean(d <= qr.chi_square_quantile(0.75, qr.P)) == pytest.approx(0.75, abs=0.005)
    assert qr.CONSISTENCY * inner.var() == pytest.approx(1, abs=0.01)


def test_outliers_do_not_shift_the_estimate(spark):
    """A fifth of the rows far off: all of them found, none of the others."""
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        n = int(rng.lognormvariate(6, 0.5)) + 50
        bad = i % 5 == 0
        rows.append((i, "en", None if i % 2 else "s", n, int(n * rng.gauss(5, 0.2)), int(n * 2.5) if bad else rng.randrange(3), 0, 0, n // 12, n // 15, bad))
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, bad boolean")
    got = qr.robust_distances(frame, ["lang", "source"]).collect()
    assert len(got) == 1500
    assert all((r.distance > qr.CUTOFF) == r.bad for r in got)


@pytest.mark.parametrize("bad_of_30", [10, 12])
def test_a_third_or_more_of_a_group_is_junk(spark, bad_of_30):
    """A third and 40% of each group far off, in one direction or as near copies: all of them found, none of the others."""
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        bad, source = i % 30 < bad_of_30, "st"[i // 30 % 2]
        n = 400 if bad and source == "t" else int(rng.lognormvariate(6, 0.5)) + 50
        symbols = n * 2 if bad else rng.randrange(3)
        rows.append((i, "en", source, n, int(n * rng.gauss(5, 0.2)), symbols, 0, 0, n // 12, n // 15, bad))
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, bad boolean")
    got = qr.robust_distances(frame, ["lang", "source"]).collect()
    assert len(got) == 3000
    assert all((r.distance > qr.CUTOFF) == r.bad for r in got)


def test_small_groups_beside_large_ones(spark):
    """Groups too small for an estimate are judged by their language's, one of a rare language by the whole table's."""
    rng = random.Random(3)
    groups = [("en", "s", 600), ("en", "t", 40), ("en", None, 5), ("xx", "s", 30), (None, "s", 3)]
    rows = []
    for lang, source, size in groups:
        for i in range(size):
            n, bad = int(rng.lognormvariate(6, 0.5)) + 50, i % 5 == 0
            rows.append((lang, source, n, int(n * rng.gauss(5, 0.2)), n * 2 if bad else rng.randrange(3), 0, 0, n // 12, n // 15, bad))
    frame = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, bad boolean")
    got = qr.robust_distances(frame, ["lang", "source"]).collect()
    assert len(got) == len(rows)
    assert all(r.distance is not None and (r.distance > qr.CUTOFF) == r.bad for r in got)
    few = qr.robust_distances(frame.filter("source = 't'"), ["lang", "source"]).collect()
    assert len(few) == 40 and all(r.distance is None for r in few)


def test_nulls_small_groups_and_empty_table(spark):
    text = "many words of one kind and another kind here " * 8
    rows = [(1, None, None, None), (None, "x " * 60, None, "s"), (2, " ".join(f"w{k}" for k in range(80)), "xx", None), (2, " ".join(f"w{k}" for k in range(80)), "xx", None), (3, text, "en", "s")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, distance int")
    got = [(r.doc_id, r.base_failed, r.kept, r.distance) for r in qr.assess(frame).collect()]
    assert sorted(got, key=str) == sorted([(1, True, False, None), (None, True, False, None), (2, False, True, None), (2, False, True, None), (3, True, False, None)], key=str)
    assert qr.assess(frame.limit(0)).count() == 0


def test_a_group_knows_its_parts_without_a_join(spark):
    """What is known of a group reaches its parts by its own column: the driver plans no join for it."""
    known = spark.createDataFrame([("a", 3, 1.5), ("b", 1, 2.5)], "grp string, parts long, edge double")
    dealt = qr._to_parts(known)
    assert sorted((r.grp, r.part, r.edge) for r in dealt.collect()) == [("a", 0, 1.5), ("a", 1, 1.5), ("a", 2, 1.5), ("b", 0, 2.5)]
    assert "Join" not in dealt._jdf.queryExecution().toString()
