import random

from pyspark.sql import functions as F

from basketlens.functions.row_index import with_row_index


def test_row_index_matches_sort(spark):
    random.seed(7)
    rows = [(i, random.randint(0, 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score int").repartition(7)
    out = with_row_index(df, [F.col("score").desc(), F.col("id")], "pos").collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = sorted(out, key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(len(rows)))
    assert [(r["id"], r["score"]) for r in got] == expected


def test_row_index_empty(spark):
    df = spark.createDataFrame([], "id long")
    assert with_row_index(df, [F.col("id")], "pos").count() == 0
