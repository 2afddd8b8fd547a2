"""Properties from the definitions, on sf0.001 and small graphs."""

import pytest
from pyspark.sql import functions as F

from basketlens.operators import explore as X
from basketlens.operators import graph as G
from basketlens.operators import indexing as I
from basketlens.operators import rank as RK
from basketlens.sources.star import baskets_from_star
from basketlens.sources.tickets import flatten_baskets


@pytest.fixture(scope="module")
def lines(spark, sf_small):
    return baskets_from_star(spark, sf_small, with_mall=False).cache()


def test_edges_symmetric_and_bounded(lines):
    e = {(r.orig, r.dest): r.linkWeight for r in G.cooccurrence_edges(lines, "prodName", "transac").collect()}
    assert all(u != v for u, v in e)
    assert all(e[(v, u)] == w for (u, v), w in e.items())
    links = {r.prodName: r.n for r in lines.groupBy("prodName").agg(F.countDistinct("transac").alias("n")).collect()}
    assert all(w <= min(links[u], links[v]) for (u, v), w in e.items())
    out = G.vertex_out_links(lines, "prodName", "transac").agg(F.sum("linksOfVertex")).first()[0]
    half = G.strongest_links(lines, "prodName", "transac").agg(F.sum("linkWeight")).first()[0]
    assert out == 2 * half == sum(e.values())


def test_shares_sum_to_100(lines):
    for report, col in ((X.prods_most_earns, "percentEarning"), (X.prods_most_sold, "percentUdsSold")):
        total = report(lines).agg(F.sum(col)).first()[0]
        assert total == pytest.approx(100, abs=0.01 * lines.count())
    labels = I.frequency_index(lines, "client")
    spent = X.clients_spent_more(lines, labels).agg(F.sum("percentSpent")).first()[0]
    assert spent == pytest.approx(100, abs=1)


def test_index_dense_and_round_trip(lines):
    for col in ("client", "prodName"):
        labels = I.frequency_index(lines, col)
        idx = sorted(r[0] for r in labels.select(f"{col}Index").collect())
        assert idx == list(range(len(idx)))
        freq = [r.frequency for r in labels.orderBy(f"{col}Index").collect()]
        assert freq == sorted(freq, reverse=True)
        back = I.restore_labels(I.index_labels(lines, labels, col).drop(col), labels, col)
        assert back.groupBy(col).count().exceptAll(lines.groupBy(col).count()).count() == 0


def test_empty_input(spark):
    empty = flatten_baskets(spark.createDataFrame([], "_id long, client long, date date, "
                                                      "items array<struct<desc:string,n_unit:double,net_am:double>>, mall int"))
    t = X.totals(empty).first()
    assert t.total_clients == 0 and t.total_products_sold is None
    assert X.prods_most_earns(empty).count() == 0
    assert G.cooccurrence_edges(empty, "prodName", "transac").count() == 0
    assert G.graph_summary(empty, "prodName", "transac").first().num_edges == 0
    ms = G.with_link_sizes(G.memberships(empty, "prodName", "transac"))
    assert RK.lazy_walk_rank(ms).ranks.count() == 0
    assert RK.pagerank(ms, empty.select(F.col("prodName").alias("v"))).ranks.count() == 0


def test_lazy_walk_tends_to_weighted_degree_share(spark):
    # star: centre 0 shares one link with each of 1, 2, 3 -> W = 3, 1, 1, 1
    mem = [(0, 10), (1, 10), (0, 11), (2, 11), (0, 12), (3, 12)]
    ms = G.with_link_sizes(G.memberships(spark.createDataFrame(mem, "v int, link int"), "v", "link"))
    run = RK.lazy_walk_rank(ms, tolerance=1e-7, max_iter=60)
    ranks = {r.v: r.rank for r in run.ranks.collect()}
    assert sum(ranks.values()) == pytest.approx(4.0)
    assert ranks[0] == pytest.approx(4 * 3 / 6, abs=1e-5)
    for leaf in (1, 2, 3):
        assert ranks[leaf] == pytest.approx(4 * 1 / 6, abs=1e-5)


def test_one_pass_indexes_equal_single_ones(lines):
    both = I.frequency_indexes(lines, ["client", "prodName"])
    for col in ("client", "prodName"):
        single = I.frequency_index(lines, col)
        assert sorted(tuple(r) for r in both[col].collect()) == sorted(tuple(r) for r in single.collect())
