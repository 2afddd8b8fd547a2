"""Shuffles sized to the input, and named pairs that take one shuffle of numbers."""

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from basketlens import session
from basketlens.operators import explore as X
from basketlens.operators import graph as G
from basketlens.plans.registry import QUERIES
from basketlens.sources import star
from basketlens.sources import tickets as T
from test_plans import _plan


def test_shuffles_grow_with_the_lines(spark, sf_small, monkeypatch):
    """As many partitions as the lines need, never fewer than given; AQE merges up to the bound."""
    given = spark.conf.get("spark.sql.shuffle.partitions")
    star.baskets_from_star(spark, sf_small)
    assert spark.conf.get("spark.sql.shuffle.partitions") == given
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    rows = star.read_table(spark, sf_small, "lineitem").count()
    lines = star.baskets_from_star(spark, sf_small)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == -(-rows // 100)
    assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) <= session.TASK_BYTES
    assert lines.count() == rows
    monkeypatch.undo()
    star.baskets_from_star(spark, sf_small)
    assert spark.conf.get("spark.sql.shuffle.partitions") == given


@pytest.mark.parametrize("given, kept", [("10MB", session.TASK_BYTES), ("256k", 256 << 10), ("-1", -1)])
def test_no_side_is_broadcast_by_the_size_of_its_files(spark, sf_small, given, kept):
    """In a session with Spark's own thresholds too, so that a task's memory does not grow with the products or clients."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k) for k in (static, adaptive)}
    try:
        spark.conf.set(static, given)
        spark.conf.unset(adaptive)
        lines = star.baskets_from_star(spark, sf_small)
        for frame in (X.totals_by_product(lines), T.tickets_from_baskets(lines), T.shell_export_text(T.tickets_from_baskets(lines))):
            assert "BroadcastExchange" not in _plan(frame)
        for _ in range(2):  # again: as before
            assert spark.conf.get(static) == "-1" and int(spark.conf.get(adaptive)) == kept
            star.baskets_from_star(spark, sf_small)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scans_grow_with_the_lines(spark, sf_small, monkeypatch, tmp_path):
    """A task of a scan gets about so many lines, however many a split of the given size would hold."""
    given = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = star.table_path(sf_small, "lineitem")
    rows = star.read_table(spark, sf_small, "lineitem").count()
    want = sorted(map(tuple, T.flatten_baskets(T.tickets_from_baskets(star.baskets_from_star(spark, sf_small))).collect()), key=repr)
    assert int(re.sub("b$", "", spark.conf.get("spark.sql.files.maxPartitionBytes"))) == int(re.sub("b$", "", given))  # few lines: as given
    monkeypatch.setattr(session, "ROWS_PER_SCAN", 500)
    try:
        for _ in range(2):  # again: as before
            lines = star.baskets_from_star(spark, sf_small)
            assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= -(-os.path.getsize(path) * 500 // rows)
            assert star.read_table(spark, sf_small, "lineitem").rdd.getNumPartitions() >= rows // 500
        got = T.flatten_baskets(T.tickets_from_baskets(lines)).collect()
        assert sorted(map(tuple, got), key=repr) == want
        text = T.shell_export_text(T.tickets_from_baskets(lines)).select(F.regexp_replace("value", "\n *", " ").alias("value"))
        text.coalesce(1).write.text(f"{tmp_path}/sh")  # one document per line, cut into splits anywhere
        back = T.flatten_baskets(T.read_shell_export(spark, f"{tmp_path}/sh"))
        assert back.rdd.getNumPartitions() > 4 and sorted(map(tuple, back.collect()), key=repr) == want
        session.size_scans(spark, 0, path)  # no rows: as given
        assert star.read_table(spark, sf_small, "lineitem").rdd.getNumPartitions() < rows // 500
    finally:
        monkeypatch.undo()
        star.baskets_from_star(spark, sf_small)


def _named(spark, mem):
    names = spark.createDataFrame([(v, f"p{97 - v}") for v in range(60)], "number long, name string")
    return spark.createDataFrame(mem, "number long, link long"), names


def test_named_pairs_of_many_cells(spark, monkeypatch):
    """Several blocks and cells, pairs added up before or after the shuffle: the edges by brute force."""
    monkeypatch.setattr(G, "BLOCK_NAMES", 7)
    rnd = random.Random(5)
    for links, k in ((30, 4), (200, 25)):  # hardly any pair shared; nearly all
        mem = [(rnd.randrange(60), link) for link in range(links) for _ in range(k)]
        want = {}
        for link in range(links):
            on = {v for v, at in mem if at == link}
            for a in on:
                for b in on - {a}:
                    want[f"p{97 - a}", f"p{97 - b}"] = want.get((f"p{97 - a}", f"p{97 - b}"), 0) + 1
        df, names = _named(spark, mem)
        got = G.cooccurrence_edges(df, "number", "link", names=names).collect()
        assert {(r.orig, r.dest): r.linkWeight for r in got} == want and len(got) == len(want)
        strong = G.strongest_links(df, "number", "link", names=names).collect()
        assert {(r.orig, r.dest): r.linkWeight for r in strong} == {p: w for p, w in want.items() if p[0] < p[1]}


def test_names_do_not_travel_with_pairs(spark):
    """Where few pairs are shared, they are shuffled once, by cell, and then meet their names unsorted."""
    df, names = _named(spark, [(v, v // 4) for v in range(60)])
    tree = _plan(G.cooccurrence_edges(df, "number", "link", names=names)).split("\n\n\n")[0]
    plan = _plan(G.cooccurrence_edges(df, "number", "link", names=names))
    assert "ShuffledHashJoin" in tree
    assert not re.search(r"hashpartitioning\((orig|dest)#", plan)
    assert len(re.findall(r"Exchange\nInput \[3\]: \[cell#\w+, orig#\w+, dest#\w+\]", re.sub(r"\(\d+\) ", "", plan))) == 1


def test_cells_are_dealt_to_more_tasks_than_there_are(spark, monkeypatch):
    """With several tasks a cell, hardly a task gets more than two cells: its memory does not rest on luck."""
    scale = G.CELL_PAIRS // 5
    monkeypatch.setattr(G, "CELL_PAIRS", G.CELL_PAIRS / scale)
    monkeypatch.setattr(G, "TASK_PAIRS", G.TASK_PAIRS / scale)
    df, names = _named(spark, [(v, v // 4) for v in range(60)])
    edges = G.cooccurrence_edges(df, "number", "link", names=names)
    tasks = int(re.search(r"hashpartitioning\(cell#\w+, (\d+)\)", _plan(edges)).group(1))
    ends = 60 * 3
    side = -(-int(100 * (ends / 5) ** 0.5) // 100)
    assert tasks >= 3 * side * (side + 1) / 2
    assert edges.count() == ends


@pytest.mark.parametrize("name", ["tickets_shell_indented", "tickets_shell_export", "tickets_shell_back_to_back", "tickets_shell_one_per_line"])
def test_shell_documents_take_little_disk(spark, sf_small, name):
    """The files that a layout is written to are a small part of its text, and hold all of it."""
    with session.recorded_scratch() as paths:
        lines = QUERIES[name](spark, sf_small)
    path, = (p for p in paths if "tickets-shell" in p)
    text = spark.read.option("wholetext", True).text(path).agg(F.sum(F.length("value"))).first()[0]
    files = sum(os.path.getsize(f) for f in glob.glob(f"{path.removeprefix('file:')}/part-*"))
    assert text > 80 * star.read_table(spark, sf_small, "lineitem").count() and files < text / 3
    want = T.flatten_baskets(T.tickets_from_baskets(star.baskets_from_star(spark, sf_small))).drop("date")
    assert sorted(map(tuple, lines.drop("date").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_links_go_to_the_cells_where_they_are_smaller_than_their_pairs(spark, monkeypatch):
    """Links of many members, few pairs shared: no pair is shuffled; edges by brute force, from any cell size and for a hot link."""
    rnd = random.Random(11)
    names = spark.createDataFrame([(v, f"p{997 - v}") for v in range(300)], "number long, name string")
    for names_of_block, sizes in ((101, [30] * 12), (70, [250]), (300, [30, 20, 1, 2, 60, 25, 30, 20]), (60, [40] * 10)):
        monkeypatch.setattr(G, "BLOCK_NAMES", names_of_block)
        mem = [(v, link) for link, k in enumerate(sizes) for v in rnd.sample(range(300), k)]
        want = {}
        for link in range(len(sizes)):
            on = [v for v, at in mem if at == link]
            for a in on:
                for b in on:
                    if a != b:
                        want[f"p{997 - a}", f"p{997 - b}"] = want.get((f"p{997 - a}", f"p{997 - b}"), 0) + 1
        df = spark.createDataFrame(mem + mem[:9], "number long, link long")
        edges = G.cooccurrence_edges(df, "number", "link", names=names)
        plan = re.sub(r"\(\d+\) ", "", _plan(edges))
        assert not re.findall(r"Exchange\nInput \[3\]: \[cell#\w+, orig#\w+, dest#\w+\]", plan)
        assert len(re.findall(r"Exchange\nInput \[4\]: \[cell#\w+, _same#\w+, _left#\w+, _right#\w+\]", plan)) == 1
        assert not re.search(r"Condition : .*transform\(", plan)  # the arrays are computed once
        got = edges.collect()
        assert {(r.orig, r.dest): r.linkWeight for r in got} == want and len(got) == len(want)
        assert len(sizes) < 10 or max(want.values()) > 1
        assert [f.dataType.simpleString() for f in edges.schema] == ["string", "string", "bigint"]
