"""Known figures of a shell export with 24 tickets, where TICKET_SAMPLE names the file."""

import os

import pytest

from basketlens.operators import explore as X
from basketlens.operators import graph as G
from basketlens.operators import indexing as I
from basketlens.operators import rank as RK
from basketlens.sources import tickets as T

SAMPLE = os.environ.get("TICKET_SAMPLE", "")
pytestmark = pytest.mark.skipif(not os.path.exists(SAMPLE), reason="TICKET_SAMPLE names no file")


@pytest.fixture(scope="module")
def lines(spark):
    return T.flatten_baskets(T.read_shell_export(spark, SAMPLE)).cache()


def test_scan_and_totals(spark, lines):
    tickets = T.read_shell_export(spark, SAMPLE)
    assert tickets.count() == 24 and tickets.selectExpr("sum(size(items))").first()[0] == 220
    assert lines.count() == 214
    assert tuple(X.totals(lines).first()) == (2, 200, 304.0, 773.19, 24)
    assert sorted(tuple(r)[1:] for r in X.totals_by_client(lines).collect()) == [(2.7, 108.0, 59, 233.85, 11), (3.09, 196.0, 147, 539.34, 13)]
    assert [r.earnings for r in X.prods_most_earns(lines).take(4)] == [59.25, 22.95, 19.5, 17.98]
    assert [r.frequency for r in I.frequency_index(lines, "client").orderBy("clientIndex").collect()] == sorted(
        (r["count"] for r in lines.groupBy("client").count().collect()), reverse=True)


def test_graph_and_ranks(lines):
    edges = G.cooccurrence_edges(lines, "prodName", "transac")
    assert tuple(edges.selectExpr("count(*)", "sum(linkWeight)", "count(distinct orig)").first()) == (4754, 4758, 195)
    assert [r.linkWeight for r in G.strongest_links(lines, "prodName", "transac").take(3)] == [2, 2, 1]
    assert [r.linksOfVertex for r in G.vertex_out_links(lines, "prodName", "transac").take(3)] == [104, 84, 49]
    ms = G.with_link_sizes(G.memberships(lines, "prodName", "transac"))
    walk = RK.lazy_walk_rank(ms)
    ranks = sorted((r["rank"] for r in walk.ranks.collect()), reverse=True)
    assert [round(r, 6) for r in ranks[:3]] == [3.225294, 2.373926, 1.721956] and round(sum(ranks), 6) == 195.0
    assert [round(walk.trace[k], 6) for k in (0, 1, 9)] == [1.663681, 0.548526, 0.035307]
    page = RK.pagerank(ms, lines.selectExpr("prodName AS v"))
    top = sorted((r["rank"] for r in page.ranks.collect()), reverse=True)
    assert len(top) == 200 and [round(r, 6) for r in top[:3]] == [2.857155, 2.085326, 1.664129]
    assert page.trace[-1] > 0  # no step without a receiver
