"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app_name: str = "basketlens",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every analysis relies on.

    On a cluster, leave ``master`` unset and size ``shuffle_partitions`` to the
    data (about 128-256 MB of shuffle output per partition); AQE coalesces
    small partitions and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # No broadcast from file-size estimates (compressed sizes say little about
        # rows); AQE broadcasts a join side only after measuring its shuffle output.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
        # Small shuffles are not merged into a single task (at scale every
        # partition is far above this floor, so it changes nothing there).
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it up if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    always used. Only a local-mode session without the setting (tests) gets a
    fresh private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) for iterative jobs")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="basketlens-ckpt-"))
    return sc.getCheckpointDir()


# A task of a shuffle gets about so many rows, and so many bytes as written (rows of
# two or three numbers take about 10 bytes there, and some 100 in memory per operator).
ROWS_PER_TASK = 500_000
TASK_BYTES = 8 << 20
# A task of a scan, which deals rows out and does no more with them, gets about so many:
# beyond 200 shuffle partitions Spark holds what a task deals out, some 75 bytes a row.
ROWS_PER_SCAN = 2_000_000
_GIVEN = "spark.basketlens.givenShufflePartitions"
_GIVEN_SPLIT = "spark.basketlens.givenMaxPartitionBytes"


def size_scans(spark: SparkSession, rows: int, path: str) -> None:
    """Splits of the session's scans for the ``rows`` rows of the table in ``path``: at most as large as it was given."""
    given = spark.conf.get(_GIVEN_SPLIT, None)
    if given is None:
        given = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set(_GIVEN_SPLIT, given)
    jvm = spark.sparkContext._jvm
    largest = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given)
    if rows:
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        size = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hpath).getLength()
        largest = min(largest, -(-size * ROWS_PER_SCAN // rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(largest))


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Shuffle partitions of the session for an input of ``rows`` rows: at least as many as it was given.

    The memory of a task then does not grow with the input: neither does the number
    of partitions stay behind, nor does AQE merge small ones beyond ``TASK_BYTES``, nor
    is a join side broadcast by the size of its files, which says little about its size
    in a task: only AQE does, up to ``TASK_BYTES`` as measured.
    """
    given = spark.conf.get(_GIVEN, None)
    if given is None:
        given = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set(_GIVEN, given)
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(given), -(-rows // ROWS_PER_TASK))))
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    merged = in_bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(min(merged, TASK_BYTES)))
    planned = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    measured = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or planned
    if not measured.startswith("-"):  # a negative one: no broadcast
        measured = str(min(in_bytes(measured), TASK_BYTES))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", measured)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def given_partitions(spark: SparkSession) -> int:
    """The shuffle partitions that the session was given, before ``size_shuffles``."""
    return int(spark.conf.get(_GIVEN, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df, name: str = "state"):
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back (explicit schema: no inference job).

    Cuts the lineage like a reliable checkpoint, in a single job, and the
    result survives executor loss. Used for iterative state and for frames
    whose row placement must not change on recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Tables written by ``materialize`` inside the block are deleted when it ends."""
    mark = len(_written)
    try:
        yield
    finally:
        for path in _written[mark:]:
            drop_scratch(spark, path)
        del _written[mark:]


@contextlib.contextmanager
def recorded_scratch():
    """The list that this yields holds, when the block has ended, the tables written inside it."""
    mark, paths = len(_written), []
    try:
        yield paths
    finally:
        paths += _written[mark:]


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that this process has written under the checkpoint folder.

    A frame of a registered query reads such tables until it has been consumed:
    call this afterwards (``bench.py`` does; so does the end of the process).
    """
    _written.clear()
    drop_scratch(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/basketlens/{_RUN}")


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        with contextlib.suppress(Exception):  # the session may be gone
            clear_scratch(spark)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``materialize`` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for derived tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    _written.append(f"{base}/basketlens/{_RUN}/{name}-{next(_counter)}")
    return _written[-1]


def _count():
    n = 0
    while True:
        n += 1
        yield n


_counter = _count()
_written: list[str] = []
_RUN = f"{os.getpid()}-{uuid.uuid4().hex[:12]}"
atexit.register(_clear_at_exit)
