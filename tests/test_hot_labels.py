"""Label joins where one label holds a third of all rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from basketlens.operators import indexing as I


@pytest.fixture
def merge_joins(spark):
    """No join side broadcast by its size, partitions as the shuffle made them."""
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _lines(spark, n=60_000):
    """One client on a third of all lines, the others on 30 each, some lines without a client."""
    client = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 1001 == 1, F.lit(None)).otherwise(F.concat(F.lit("c"), (F.col("id") % 2000).cast("string")))
    return spark.range(0, n, 1, 4).select(client.alias("client"), F.col("id").alias("transac"))


def test_hot_label_is_spread(spark, merge_joins):
    lines = _lines(spark)
    labels = I.frequency_index(lines, "client")
    joined = I.index_labels(lines, labels, "client")
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * statistics.median(sizes)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    back = I.restore_labels(joined.drop("client"), labels, "client")
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * statistics.median(sizes)


def test_same_rows_as_a_plain_join(spark):
    lines = _lines(spark, 6000).union(_lines(spark, 300))  # repeated rows stay repeated
    labels = I.frequency_index(lines.where("client <> 'c7'"), "client")  # a label that the table lacks
    joined = I.index_labels(lines, labels, "client")
    plain = lines.join(labels.select("client", "clientIndex"), "client")
    assert joined.columns == plain.columns and joined.exceptAll(plain).count() == 0 == plain.exceptAll(joined).count()
    assert joined.where("client = 'hot'").select("clientIndex").distinct().collect() == [(0,)]
    bare = I.index_labels(lines, labels.drop("frequency"), "client")
    assert bare.exceptAll(plain).count() == 0 == plain.exceptAll(bare).count()
    assert I.index_labels(lines.limit(0), labels, "client").count() == 0
    assert I.index_labels(lines, labels.limit(0), "client").count() == 0


def test_hot_labels_are_few(spark):
    """However the lines are spread, no more labels than the bound are broadcast, and every hot one is."""
    lines = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % (2 * I.HOT_LABELS)).cast("string"))).alias("client"), "id")
    labels = I.frequency_index(lines, "client")
    first = [r.client for r in labels.where(F.col("clientIndex") < I.HOT_LABELS).collect()]
    assert len(first) == I.HOT_LABELS and "hot" in first
    assert I.index_labels(lines, labels, "client").count() == 3000
