"""Helpers shared by the operators: table access, column checks, batch bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python. Documents run to 100,000s of bytes,
#: so the default of 10,000 rows would make batches of up to a gigabyte.
BATCH_ROWS = 500

#: The characters that separate words, as a Java and as a bytes.split() rule:
#: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def give_back() -> None:
    """Return the memory of a finished task to the system: its Python worker stays, for other tasks."""
    import ctypes
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each string of an Arrow column (null: empty)."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def hex64(column) -> F.Column:
    """A long as 16 lower-case hex digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
