"""Incremental ticket ingest with Structured Streaming.

The source application reads a finished export in batch. When ticket files
keep arriving in a folder, the same scan and flattening run as a file
stream: each new file is parsed with the ticket schema, flattened to basket
lines and appended to a parquet basket table, exactly once per file
(progress is kept in the query's checkpoint location). The batch analyses
then read that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from basketlens import schemas as S
from basketlens.sources.tickets import flatten_baskets


def stream_baskets(spark: SparkSession, ticket_dir: str, max_files_per_trigger: int | None = None,
                   excluded=S.EXCLUDED_PRODUCTS) -> DataFrame:
    """Streaming basket lines from JSON-lines ticket files arriving in ``ticket_dir``."""
    reader = spark.readStream.schema(S.TICKET).option("mode", "DROPMALFORMED")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return flatten_baskets(reader.json(ticket_dir), excluded)


def append_baskets(lines: DataFrame, table_dir: str, checkpoint_dir: str,
                   available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Append streaming basket lines to a parquet table.

    ``available_now=True`` processes what is there and stops (scheduled
    ingest); otherwise the query keeps running with ``processing_time``.
    """
    writer = (lines.writeStream.format("parquet").outputMode("append")
              .option("path", table_dir).option("checkpointLocation", checkpoint_dir))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
