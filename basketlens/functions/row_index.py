"""Distributed dense row index over a global sort order.

A global ``row_number()`` window without a partition key runs in one task;
this version keeps the work spread over all partitions:

1. ``orderBy`` range-partitions and sorts the rows (partition ``i`` holds
   the ``i``-th slice of the order);
2. in the same pass each row records its partition and its position inside
   it (``monotonically_increasing_id`` minus the partition base), and the
   rows are written as a table to the shared checkpoint folder, so the
   numbering is fixed once and cannot shift on recomputation;
3. each partition gets the number of rows before it (a running sum over one
   row per partition, a table whose size is the partition count);
4. index = partition offset + position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.session import ensure_checkpoint_dir, materialize

_PID = "_rowidx_pid"
_POS = "_rowidx_pos"
_N = "_rowidx_n"
_OFF = "_rowidx_off"


def with_row_index(df: DataFrame, order_by: list, name: str = "index", start: int = 0) -> DataFrame:
    """Add ``name`` = 0-based (or ``start``-based) position of each row in ``order_by``.

    ``order_by`` must be a total order (add a unique tiebreak) for the index
    to be deterministic.
    """
    ensure_checkpoint_dir(df.sparkSession)
    tagged = materialize(
        df.orderBy(*order_by)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33)),
        "row-index")
    running = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias(_N))
               .select(_PID, F.coalesce(F.sum(_N).over(running), F.lit(0)).alias(_OFF)))
    # one row per partition of ``ordered``: a size bound known before running
    return (tagged.join(F.broadcast(offsets), _PID)
            .withColumn(name, F.col(_OFF) + F.col(_POS) + F.lit(start))
            .drop(_PID, _POS, _OFF))
