import math

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from basketlens import session
from basketlens.operators import als as A
from basketlens.operators import factor_topk
from basketlens.operators import indexing as I
from basketlens.sources.star import baskets_from_star


def test_als_recommendations_and_rmse(spark, sf_small):
    lines = baskets_from_star(spark, sf_small, with_mall=False)
    clients, products = I.frequency_index(lines, "client"), I.frequency_index(lines, "prodName")
    triples = I.index_baskets(A.ratings(lines, "prodName", "client", "prodUds"), clients, products)
    parts = A.split_ratings(triples, "clientIndex", "prodNameIndex", seed=7)
    again = A.split_ratings(triples.repartition(3), "clientIndex", "prodNameIndex", seed=7)
    assert parts.exceptAll(again).count() == 0 and 0.75 < parts.where("part = 'train'").count() / parts.count() < 0.85
    for key, other in (("prodName", "client"), ("client", "prodName")):
        fit = A.fit_als(parts, f"{key}Index", f"{other}Index", "prodUds", seed=7)
        err = A.rmse(fit).first()
        factors = [{r["id"]: np.array(r["features"]) for r in f.collect()} for f in (fit.model.userFactors, fit.model.itemFactors)]
        errors = [(factors[0][r[f"{key}Index"]] @ factors[1][r[f"{other}Index"]] - r["prodUds"]) ** 2 for r in fit.rows("test").collect()
                  if r[f"{key}Index"] in factors[0] and r[f"{other}Index"] in factors[1]]
        assert err["scored_rows"] == len(errors) and math.isclose(err["rmse"], np.mean(errors) ** 0.5, rel_tol=1e-4)
        assert err["train_rows"] + err["test_rows"] == triples.count()
        solved = A.normal_equations(fit).collect()
        counts = {r[0]: r[1] for r in fit.rows("train").groupBy(f"{key}Index").count().collect()}
        assert {r[0]: r["train_rows"] for r in solved} == counts and all(r["residual"] < 1e-6 for r in solved)
        raw = {r[0]: [(i, s) for i, s in r[1]] for r in fit.model.recommendForAllUsers(10).collect()}
        for u, got in list(raw.items())[:40]:
            best = sorted((float(factors[0][u] @ v) for v in factors[1].values()), reverse=True)[:10]
            assert np.allclose([s for _, s in got], best, rtol=1e-4, atol=1e-5)
        key_lab, other_lab = (products, clients) if key == "prodName" else (clients, products)
        recs = A.recommendations(fit, 10, key_lab, key, other_lab, other)
        assert recs.columns == [key, "recommendations"]
        rows = recs.collect()
        assert len(rows) == len(raw)
        assert rows and len({r[key] for r in rows}) == len(rows)
        for r in rows:
            scores = [e["prodUds"] for e in r["recommendations"]]
            assert 0 < len(scores) <= 10 and scores == sorted(scores, reverse=True)
            assert len({e[other] for e in r["recommendations"]}) == len(scores)


def test_normal_equations_tell_factors_that_do_not_solve_them(spark, sf_small):
    """The other side was solved one half-step earlier, and shifted ratings are another system."""
    lines = baskets_from_star(spark, sf_small, with_mall=False)
    triples = I.index_baskets(A.ratings(lines, "prodName", "client", "prodUds"), I.frequency_index(lines, "client"), I.frequency_index(lines, "prodName"))
    parts = A.split_ratings(triples, "clientIndex", "prodNameIndex", seed=7)
    fit = A.fit_als(parts, "prodNameIndex", "clientIndex", "prodUds", seed=7)
    shifted = A.AlsFit(fit.model, fit.parts.withColumn("prodUds", F.col("prodUds") + F.lit(1.0).cast("float")), "prodNameIndex", "clientIndex", "prodUds", fit.reg_param)
    assert min(r["residual"] for r in A.normal_equations(shifted).collect()) > 1e-4
    # by hand, for one key
    x, v = ({r["id"]: np.array(r["features"], float) for r in f.collect()} for f in (fit.model.userFactors, fit.model.itemFactors))
    rows = [r for r in fit.rows("train").collect() if r["prodNameIndex"] == 3]
    gram = sum(np.outer(v[r["clientIndex"]], v[r["clientIndex"]]) for r in rows) + fit.reg_param * len(rows) * np.eye(10)
    assert np.allclose(gram @ x[3], sum(r["prodUds"] * v[r["clientIndex"]] for r in rows), rtol=1e-4)


def _brute(left, right, k):
    out = {}
    for i, u in left:
        scores = sorted((-np.float32(np.dot(np.float64(np.float32(u)), np.float64(np.float32(v)))), j) for j, v in right)
        out[i] = [(j, float(-s)) for s, j in scores[:k]]
    return out


@pytest.mark.parametrize("block,unit", [(512, 65536), (7, 10)])
def test_best_partners_equal_brute_force(spark, monkeypatch, block, unit):
    """Lengths over several magnitudes, copies, zero vectors, opposite signs, fewer partners than asked for."""
    monkeypatch.setattr(factor_topk, "BLOCK", block)
    monkeypatch.setattr(factor_topk, "UNIT", unit)
    rng = np.random.default_rng(1)
    vectors = lambda n: (np.round(rng.normal(size=(n, 4)) * 4) / 4 * rng.choice([0.25, 1, 8], (n, 1))).tolist()
    left, right = list(enumerate(vectors(150))), [(5 * i, v) for i, v in enumerate(vectors(400))]
    right += [(3000 + i, right[7][1]) for i in range(40)] + [(4000, [0.0] * 4), (4001, [-50.0] * 4)]
    left += [(900, [0.0] * 4), (901, [-1.0] * 4)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, features array<float>")
    for some in (right, right[:3], []):
        got = {}
        for r in factor_topk.best_partners(frame(left), frame(some), 10).collect():
            got.setdefault(r["left"], []).append((r["right"], r["score"]))
        want = _brute(left, some, 10) if some else {}
        assert {i: sorted(v, key=lambda x: (-x[1], x[0])) for i, v in got.items()} == want
    assert factor_topk.best_partners(frame([]), frame(right), 10).count() == 0


def test_blocks_are_skipped_on_proof(spark):
    rng = np.random.default_rng(2)
    right = [(i, (rng.normal(size=8) * 50 / (1 + i)).tolist()) for i in range(20_000)]
    left = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, features array<float>")
    seen = Observation()
    rows = factor_topk.best_partners(frame(left), frame(right), 10, scored=seen).collect()
    assert len(rows) == 3000 and seen.get["pairs"] < 0.1 * 300 * 20_000


def test_right_rows_are_copied_once_a_core(spark):
    """Units, so copies of the right rows, follow cores and left rows, not the number of shuffle partitions."""
    given = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    frame = lambda n, m=1: spark.range(n).selectExpr("cast(id as int) id", f"array(cast(id % 7 as float), cast({m} as float)) features")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        assert [factor_topk.unit_count(frame(n), cores).first()["n"] for n in (0, 10, 20_000)] == [1, 1, cores]
        assert factor_topk.best_partners(frame(20_000), frame(30), 3).count() == 60_000
        sizes = factor_topk.best_partners(frame(20_000), frame(30), 3).groupBy(F.spark_partition_id()).count().count()
        assert sizes == cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)


def test_blocks_do_not_grow_with_the_shuffles(spark, monkeypatch):
    """The solver's blocks stay as given while shuffles are sized to the lines; more only for more ratings."""
    parts = spark.range(100)
    given = session.given_partitions(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        monkeypatch.setattr(session, "ROWS_PER_TASK", 1)
        session.size_shuffles(spark, 64)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
        assert A.fit_blocks(parts) == given
        monkeypatch.setattr(A, "RATINGS_PER_BLOCK", 9)
        assert A.fit_blocks(parts) == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
