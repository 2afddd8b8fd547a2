"""Result writer: the three output modes and the result layout.

Layout: ``<base>/<run id>/<result name>``. Run parameters and scalars that
belong to a result (top-N sizes, total units, RMSE, damping, ...) are added
as columns instead of being encoded in the path text.

* ``parallelWriteJSON`` - every task writes its own JSON-lines part (append)
* ``oneJSON``           - one result folder that replaces the one before once it
  is written whole; an ordered result is written as ordered parts, in parallel
* ``standarOutput``     - print the first rows
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens import schemas as S


def new_run_id(now: _dt.datetime | None = None) -> str:
    return (now or _dt.datetime.now()).strftime("%Y-%m-%d_%H.%M.%S")


def with_params(df: DataFrame, params: dict | None) -> DataFrame:
    if not params:
        return df
    return df.select(*[F.lit(v).alias(k) for k, v in params.items()], *df.columns)


def replace_json(df: DataFrame, path: str) -> None:
    """Write ``df`` as JSON lines in place of what lies at ``path``.

    The new result is written whole beside the old one and takes its name by two
    renames: a job that fails half-way leaves the old result as it was.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fresh, old = (target.suffix(f".{mark}-{uuid.uuid4().hex}") for mark in ("new", "old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.json(fresh.toString())
        before = fs.exists(target)
        if before and not fs.rename(target, old):
            raise OSError(f"{path} cannot be set aside")
        if not fs.rename(fresh, target):
            if before:
                fs.rename(old, target)
            raise OSError(f"{path} cannot be replaced")
        if before:
            fs.delete(old, True)
    finally:
        if fs.exists(fresh):
            fs.delete(fresh, True)


def write_result(df: DataFrame, base_dir: str, run_id: str, name: str, mode: str = "parallelWriteJSON",
                 params: dict | None = None) -> str | None:
    """Write one named result; returns its path (``None`` for console output)."""
    if mode not in S.OUTPUT_MODES:
        raise ValueError(f"unknown output mode {mode!r}; known modes: {', '.join(S.OUTPUT_MODES)}")
    out = with_params(df, params)
    path = f"{base_dir.rstrip('/')}/{run_id}/{name}"
    if mode == "parallelWriteJSON":
        out.write.mode("append").json(path)
        return path
    if mode == "oneJSON":
        replace_json(out, path)
        return path
    out.show(S.PREVIEW_ROWS, truncate=False)
    return None
