"""Frequency index of a label column, its inverse, and the top-N filter.

The index follows the usual frequency-descending string-indexer rule: the
label on the most line rows gets 0; ties are ordered by the label's text
(numeric labels compare as text too).

A label's index is its rank, so label joins know the hot labels: the first ones
are looked up map-side, and their rows do not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.row_index import with_row_index
from basketlens.session import materialize
from basketlens.schemas import index_column


#: The first so many labels are looked up map-side: among them is every label on more than one in so many rows.
HOT_LABELS = 200


def frequency_order(column: str, frequency: str = "frequency") -> list:
    """The order of a frequency index."""
    return [F.col(frequency).desc(), F.col(column).cast("string").asc()]


def _index_from_counts(counts: DataFrame, column: str, index_col: str) -> DataFrame:
    return (with_row_index(counts, frequency_order(column), index_col)
            .select(column, F.col(index_col).cast("int").alias(index_col), "frequency"))


def frequency_index(df: DataFrame, column: str, index_col: str | None = None) -> DataFrame:
    """Label table ``(column, <column>Index, frequency)`` fitted on ``df``.

    Work: one aggregation of ``df`` by label (partial counts map-side), then a
    distributed sort of the label table - never the line table - with a
    distributed row index.
    """
    index_col = index_col or index_column(column)
    counts = (df.where(F.col(column).isNotNull())
              .groupBy(column).agg(F.count(F.lit(1)).alias("frequency")))
    return _index_from_counts(counts, column, index_col)


def frequency_indexes(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Label tables of several columns fitted in one pass over ``df``.

    One grouping-sets aggregation counts every column's labels together
    (each row is expanded once per column and combined map-side); the small
    result is written once and each index is built from its part.
    """
    if len(columns) == 1:
        return {columns[0]: frequency_index(df, columns[0])}
    return {c: _index_from_counts(part, c, index_column(c)) for c, part in _label_counts(df, columns).items()}


def _label_counts(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """``(column, frequency)`` of each column, counted together and written once."""
    n = len(columns)
    counts = materialize(
        df.select(*columns)
        .groupingSets([[c] for c in columns], *columns)
        .agg(F.count(F.lit(1)).alias("frequency"), F.grouping_id().alias("_gid")),
        "label-counts")
    out = {}
    for i, c in enumerate(columns):
        only_c = (1 << n) - 1 - (1 << (n - 1 - i))
        out[c] = counts.where((F.col("_gid") == only_c) & F.col(c).isNotNull()).select(c, "frequency")
    return out


def top_indexes(df: DataFrame, sizes: dict[str, int]) -> dict[str, DataFrame]:
    """The first rows of each column's label table, ``sizes`` of them, without sorting the labels.

    Every partition keeps its ``n`` most frequent labels in a heap and the heaps are
    merged (order and limit in one operator); only the ``n`` labels left are numbered.
    """
    out = {}
    for c, part in _label_counts(df, list(sizes)).items():
        first = part.orderBy(*frequency_order(c)).limit(sizes[c])
        place = F.row_number().over(Window.orderBy(*frequency_order(c))) - 1  # n rows, a parameter
        out[c] = materialize(first.select(c, place.cast("int").alias(index_column(c)), "frequency"), "top-labels")
    return out


def _label_join(df: DataFrame, labels: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """Inner join of ``df`` with the label table on ``key``, which adds ``value``.

    The ``HOT_LABELS`` most frequent labels (that many rows at most, whatever the
    size of the data) are broadcast; a row that finds its label there goes on under
    a hash of its own instead of its label, so that a label on a third of all rows
    is spread over all tasks. The other labels are joined by sort-merge. A row
    without a label finds none and goes before the shuffle.
    """
    hot = labels.where(F.col(rank) < HOT_LABELS).select(key, F.col(value).alias("_hot"))
    # One key of both parts: a constant part of its own would be folded out of the join's keys.
    rest = labels.where(F.col(rank) >= HOT_LABELS).select(F.struct(F.col(key).alias("label"), F.lit(0).cast("long").alias("row")).alias("_at"), F.col(value).alias("_rest"))
    row = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.xxhash64(*df.columns).bitwiseOR(F.lit(1))).cast("long")
    found = (df.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left")
             .withColumn("_at", F.struct(F.col(key).alias("label"), row.alias("row")))
             .join(rest, "_at", "left")
             .withColumn(value, F.coalesce("_hot", "_rest"))
             .where(F.col(value).isNotNull()))
    return found.select(key, *[c for c in df.columns if c != key], value)


def index_labels(df: DataFrame, labels: DataFrame, column: str, index_col: str | None = None) -> DataFrame:
    """Attach ``<column>Index`` to ``df`` by joining the label table on the label."""
    index_col = index_col or index_column(column)
    return _label_join(df, labels, column, index_col, index_col)


def restore_labels(df: DataFrame, labels: DataFrame, column: str, index_col: str | None = None,
                   keep_index: bool = False) -> DataFrame:
    """Inverse of the index: join the label back, keeping its original type."""
    index_col = index_col or index_column(column)
    out = _label_join(df, labels, index_col, column, index_col)
    return out if keep_index else out.drop(index_col)


def top_labels(labels: DataFrame, column: str, n: int, index_col: str | None = None) -> DataFrame:
    index_col = index_col or index_column(column)
    return labels.where(F.col(index_col) < n).select(column)


def keep_top(df: DataFrame, labels: DataFrame, column: str, n: int, index_col: str | None = None) -> DataFrame:
    """Keep rows whose label is among the ``n`` most frequent (``n == 0``: no filter).

    A left-semi join with the ``n`` selected labels; whether it is broadcast is
    decided at run time from their measured size.
    """
    if not column or n == 0:
        return df
    return df.join(top_labels(labels, column, n, index_col), column, "left_semi")


def index_baskets(lines: DataFrame, client_labels: DataFrame, product_labels: DataFrame,
                  client: str = "client", product: str = "prodName") -> DataFrame:
    """The indexed basket table: lines + ``clientIndex`` + ``prodNameIndex``."""
    return index_labels(index_labels(lines, client_labels, client), product_labels, product)
