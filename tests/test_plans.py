"""Plan shape of every registered query: no cartesian products or nested-loop
joins, and fact-table scans read only the columns they need."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from basketlens.plans.registry import QUERIES


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, sf_small, name):
    plan = _plan(E.queries()[name](spark, sf_small))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        if "l_orderkey" in schema:
            assert len(schema.split(",")) <= 4, schema


def _plans_run(spark, build):
    """The physical plans of every job that ``build`` runs while it makes its frame."""
    seen = []
    kind = type(spark.range(0).write)
    writes = {name: getattr(kind, name) for name in ("parquet", "saveAsTable")}

    def seeing(write):
        def run(self, *a, **k):
            seen.append(_plan(self._df))
            return write(self, *a, **k)
        return run

    for name, write in writes.items():
        setattr(kind, name, seeing(write))
    try:
        build()
    finally:
        for name, write in writes.items():
            setattr(kind, name, write)
    return seen


@pytest.mark.parametrize("name", ["frequency_index_product", "indexed_baskets", "lazy_walk_rank", "pagerank", "als_split", "totals_by_client"])
def test_plans_of_the_steps_before(spark, sf_small, name):
    """Index fit, rank steps, rating split: no product, no nested loop, no window over all rows in one task."""
    plans = _plans_run(spark, lambda: QUERIES[name](spark, sf_small))
    assert plans
    for plan in plans:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
            if "l_orderkey" in schema:
                assert len(schema.split(",")) <= 4, schema
    if name in ("lazy_walk_rank", "pagerank"):
        assert any("bucketed" in p.lower() or "Bucketed: true" in p for p in plans)
    reads = {"indexed_baskets": 1, "totals_by_client": 1, "als_split": 2}  # of the lines: labels; report; labels and ratings
    if name in reads:
        assert sum("l_orderkey" in p for p in plans) == reads[name]


@pytest.mark.parametrize("name", ["lazy_walk_rank", "pagerank"])
def test_rank_steps_shuffle_partial_sums_only(spark, sf_small, name):
    """A step reads state and memberships from bucketed tables; its exchanges are those of the two aggregations."""
    steps = [p for p in _plans_run(spark, lambda: QUERIES[name](spark, sf_small)) if "rank_state" in p and "Join" in p]
    assert steps
    for plan in steps:
        tree = plan.split("\n\n\n")[0]
        assert tree.count("Exchange") == 2 and tree.count("SortMergeJoin") + tree.count("ShuffledHashJoin") == 3, tree
        keys = sorted(re.findall(r"hashpartitioning\((\w+)#", plan))
        assert keys == ["link", "v"], keys


@pytest.mark.parametrize("name", ["lazy_walk_rank", "pagerank"])
def test_rank_steps_sort_nothing(spark, sf_small, name):
    """State and sums are hashed, memberships stream past them: no step sorts its memberships."""
    steps = [p for p in _plans_run(spark, lambda: QUERIES[name](spark, sf_small)) if "rank_state" in p and "Join" in p]
    assert steps
    for plan in steps:
        tree = plan.split("\n\n\n")[0]
        assert tree.count("ShuffledHashJoin") == 3 and not re.search(r"[ -] Sort \(", tree), tree


@pytest.mark.parametrize("name", ["prods_most_sold", "prods_most_popular", "clients_spent_more", "clients_buy_more", "clients_buy_more_reference",
                                  "clients_most_transactions", "clients_variety"])
def test_share_reports_read_the_lines_once(spark, sf_small, name):
    """Value and total come from one scan of the fact table."""
    last = []
    plans = _plans_run(spark, lambda: last.append(QUERIES[name](spark, sf_small)))
    assert sum(len(re.findall(r"ReadSchema: struct<[^>]*l_orderkey", p)) for p in [*plans, _plan(last[0])]) == 1


def test_top_n_is_bounded_and_filters_below_the_fact_join(spark, sf_small):
    """Heaps instead of a sort of all labels; semi-joins on orders and part before lineitem is joined."""
    last = []
    plans = _plans_run(spark, lambda: last.append(QUERIES["configured_ratings_wide"](spark, sf_small)))
    assert sum("TakeOrderedAndProject" in p for p in plans) == 2 and not any("rangepartitioning" in p for p in plans)
    tree = _plan(last[0]).split("\n\n\n")[0]
    assert tree.count("LeftSemi") == 2
    semi, joins = tree.index("LeftSemi"), [m.start() for m in re.finditer("Join Inner", tree)]
    assert joins[0] < semi
