"""Connected components by random contraction, as joins and aggregations.

Each round every vertex is merged into the neighbour (or itself) that comes
first in an order drawn anew from a hash of the round. The expected number of
vertices falls by a constant factor per round whatever the graph's shape (long
paths included), and a vertex of very high degree is only ever aggregated with
map-side combining. Each round's tables are written under the shared
checkpoint folder: a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` long pairs -> one row ``(vertex, root)`` per vertex with a link.

    Vertices with equal ``root`` are connected; which vertex is the root is
    arbitrary but the same on every run. Loops are ignored; no edges: no rows.
    """
    live = materialize(_undirected(edges), "edges")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        seed = len(rounds)
        both = live.union(live.select("v", "u"))
        nearest = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(seed)).alias("h"), F.col("v"))).alias("m"))
        merged = materialize(nearest.select(
            "u", F.when(F.col("m.h") < F.xxhash64("u", F.lit(seed)), F.col("m.v")).otherwise(F.col("u")).alias("to")), "merge")
        rounds.append(merged)
        left = merged.select("u", F.col("to").alias("ru"))
        right = merged.select(F.col("u").alias("v"), F.col("to").alias("rv"))
        live = materialize(_undirected(live.join(left, "u").join(right, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))), "edges")
    if not rounds:
        return live.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    labels = rounds[0].select(F.col("u").alias("vertex"), F.col("to").alias("root"))
    for merged in rounds[1:]:
        step = merged.select(F.col("u").alias("root"), F.col("to").alias("next"))
        labels = labels.join(step, "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))
    return materialize(labels, "labels")


def _undirected(edges: DataFrame) -> DataFrame:
    return (edges.filter(F.col("u") != F.col("v"))
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
