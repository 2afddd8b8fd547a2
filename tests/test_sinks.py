import json
import os

import pytest

from basketlens.sources.sinks import write_result


def test_write_modes(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id * 2 AS v")
    base = str(tmp_path)
    p = write_result(df, base, "run1", "res", "parallelWriteJSON", params={"numClients": 0})
    rows = [json.loads(line) for f in os.listdir(p) if f.endswith(".json") for line in open(os.path.join(p, f))]
    assert sorted(r["id"] for r in rows) == list(range(5)) and all(r["numClients"] == 0 for r in rows)
    write_result(df, base, "run1", "res", "parallelWriteJSON")  # append
    assert spark.read.json(p).count() == 10
    one = write_result(df.orderBy("id"), base, "run1", "one", "oneJSON")
    for _ in range(2):  # overwritten, not appended
        parts = sorted(f for f in os.listdir(one) if f.endswith(".json"))
        assert [json.loads(x)["id"] for f in parts for x in open(os.path.join(one, f))] == list(range(5))
        write_result(df.orderBy("id"), base, "run1", "one", "oneJSON")
    assert write_result(df, base, "run1", "show", "standarOutput") is None


def test_bad_mode(spark, tmp_path):
    with pytest.raises(ValueError, match="csv"):
        write_result(spark.range(5), str(tmp_path), "r", "x", "csv")


def test_failed_replacement_leaves_the_result_before(spark, tmp_path):
    """Some tasks write, one fails: the earlier result is still read, and nothing else lies beside it."""
    from pyspark.sql import functions as F
    base = str(tmp_path)
    first = spark.range(5)
    path = write_result(first, base, "run", "r", "oneJSON")
    broken = spark.range(0, 400, 1, 4).select(F.when(F.col("id") < 350, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_result(broken, base, "run", "r", "oneJSON")
    assert sorted(r.id for r in spark.read.json(path).collect()) == [0, 1, 2, 3, 4]
    assert [p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")] == ["r"]
    write_result(spark.range(7, 9), base, "run", "r", "oneJSON")
    assert sorted(r.id for r in spark.read.json(path).collect()) == [7, 8]
    write_result(spark.range(1), f"file:{base}", "run", "r", "oneJSON")  # by URI
    assert [r.id for r in spark.read.json(path).collect()] == [0]
