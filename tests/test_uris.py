"""Sources, results and written tables named by URI: ``file:`` and a ``viewfs:`` mount."""

import pytest
from pyspark.sql import functions as F

import basketlens.session as session
from basketlens.operators import indexing
from basketlens.sources.sinks import write_result
from basketlens.sources.star import baskets_from_star
from basketlens.sources.tickets import flatten_baskets, read_shell_export
from fixtures import EXPECTED_LINES, export_text


@pytest.fixture(params=["file", "viewfs"])
def by_uri(spark, request):
    """A function from a local folder to its URI."""
    if request.param == "file":
        yield lambda path: f"file:{path}"
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shop.link./disk", "file:///")
    yield lambda path: f"viewfs://shop/disk{path}"
    conf.unset("fs.viewfs.mounttable.shop.link./disk")


def test_tables_by_uri(spark, sf_small, by_uri):
    near, far = baskets_from_star(spark, sf_small), baskets_from_star(spark, by_uri(sf_small))
    assert far.exceptAll(near).count() == 0 and far.count() == near.count()


def test_export_by_uri(spark, tmp_path, by_uri):
    (tmp_path / "export.json").write_text(export_text(), encoding="utf-8")
    lines = flatten_baskets(read_shell_export(spark, by_uri(tmp_path / "export.json")))
    assert sorted(tuple(r) for r in lines.select("transac", "client", "prodName", "prodUds", "prodsCost", "mall").collect()) == EXPECTED_LINES


def test_results_by_uri(spark, tmp_path, by_uri):
    for n in (5, 3):  # the second result takes the place of the first
        path = write_result(spark.range(n).orderBy("id"), by_uri(tmp_path), "run", "one", "oneJSON")
    assert path.startswith(by_uri(tmp_path)) and [r.id for r in spark.read.json(path).orderBy("id").collect()] == [0, 1, 2]
    for _ in range(2):
        path = write_result(spark.range(5), by_uri(tmp_path), "run", "many", "parallelWriteJSON")
    assert spark.read.json(path).count() == 10


def test_written_tables_by_uri(spark, sf_small, tmp_path, by_uri, monkeypatch):
    """Label tables and restored labels, with the shared folder given by URI; nothing is left behind."""
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda _: by_uri(tmp_path))
    lines = baskets_from_star(spark, by_uri(sf_small))
    with session.scratch_scope(spark):
        labels = indexing.frequency_index(lines, "client")
        assert any(tmp_path.rglob("*.parquet")) and session._written[-1].startswith(by_uri(tmp_path))
        back = indexing.restore_labels(indexing.index_labels(lines, labels, "client").drop("client"), labels, "client")
        assert back.count() == lines.where(F.col("client").isNotNull()).count()
    assert not any(tmp_path.rglob("*.parquet"))
