"""Iterative vertex ranks on the co-purchase graph, computed from memberships.

Both algorithms move rank along weighted edges ``w(u, v)`` = number of links
shared by ``u`` and ``v``, divided by the sender's out-weight ``W(u)``. Summed
over the senders, a vertex receives

    sum_u x(u) * w(u, v) = sum over links L of v of ( S(L) - x(v) ),
    S(L) = sum of x(u) over the members u of L,

so one step is two aggregations over the membership table - members to
links, links back to members - and never touches the (quadratic) pair set.
A link held by a third of all rows costs a third of the membership rows, not
the square of it. The per-vertex state is written after every step as a table in
the shared checkpoint folder, bucketed on the vertex like the memberships: no
step shuffles the state or the memberships, the plan stays one step long, and a
lost executor recomputes at most one step.

* ``lazy_walk_rank`` - each step ``r'(v) = d*r(v) + (1-d) * sum_u r(u) w(u,v)/W(u)``,
  start 1.0, stop when ``max |r' - r| <= tol`` or after ``max_iter`` steps.
  Vertices without edges take no part.
* ``pagerank`` - delta-propagation PageRank to a tolerance on the
  multigraph: start ``pr = delta = reset``; a vertex that received something
  in the last step and whose ``delta > tol`` sends ``delta * w/W``; receivers
  add ``damping * message`` and become the next senders; stop when nobody
  has anything to send; scale so ranks sum to the number of vertices (isolated ones
  included, they keep the start value).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.operators.graph import K, L, V
from basketlens.session import drop_scratch, ensure_checkpoint_dir, materialize, scratch_path

# A vertex (link) has one sub-key per so many memberships.
HOT_KEY_SIZE = 100_000


@dataclass
class RankRun:
    ranks: DataFrame            # (v, rank)
    steps: int = 0
    trace: list = field(default_factory=list)   # per-step tolerance / receiver count


class _Tables:
    """Bucketed tables under the shared checkpoint folder, deleted by ``release``."""

    def __init__(self, spark):
        ensure_checkpoint_dir(spark)
        self.spark, self.parts, self.names = spark, int(spark.conf.get("spark.sql.shuffle.partitions")), {}

    def write(self, df: DataFrame, keys: list[str], label: str, dealt: bool = False) -> DataFrame:
        """``df`` bucketed on ``keys`` into as many buckets as a shuffle has partitions: joins on the keys shuffle it no more.

        ``dealt``: its partitions are by ``keys`` already (it comes from an aggregation or a join on them).
        """
        name, path = f"{label}_{uuid.uuid4().hex}", scratch_path(self.spark, label)
        self.names[name] = path
        ((df if dealt else df.repartition(self.parts, *keys)).write.bucketBy(self.parts, *keys).option("path", path).saveAsTable(name))
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_scratch(self.spark, self.names.pop(name))

    def release(self) -> None:
        for name in list(self.names):
            self.drop(name)


class _State:
    """The per-vertex table, bucketed on the vertex; each write replaces the one before."""

    def __init__(self, tables: _Tables):
        self.tables, self.name, self.frame = tables, None, None

    def write(self, df: DataFrame, **metrics: Column) -> dict:
        """Write ``df``, delete the previous table, and give ``metrics`` of it."""
        before, known = self.name, set(self.tables.names)
        self.frame = self.tables.write(df, [V], "rank_state", dealt=True)
        self.name = next(iter(set(self.tables.names) - known))
        if before:
            self.tables.drop(before)
        return self.frame.agg(*[m.alias(k) for k, m in metrics.items()]).first().asDict()

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` of the state as a table of its own, which outlives this one."""
        return materialize(df, "ranks")


@dataclass
class Memberships:
    """Membership in links of 2+ members (the only ones carrying rank), in two
    bucketed tables: ``by_vertex`` on the vertex, ``by_link`` on the link. The
    state is bucketed like the first and sums per link come partitioned like the
    second, so a step shuffles only partial sums: once to links, once to vertices.

    A vertex (link) with more than ``hot_key_size`` memberships is kept apart, in
    ``hot_by_vertex`` on ``(v, vs)`` and ``hot_by_link`` on ``(link, ls)``: a
    vertex with n links has ``cv = ceil(n / hot_key_size)`` sub-vertices by a
    hash of the link, a link with k members ``cl`` sub-links by a hash of the
    vertex, and the rows that meet them are replicated over the sub-keys. No
    task holds more than about ``hot_key_size`` memberships of one key. None
    where there is no such key.
    ``base = (v, W, n, cv)``: out-weight, number of multi-member links and
    split factor per vertex.
    """
    by_vertex: DataFrame
    by_link: DataFrame
    hot_by_vertex: DataFrame | None
    hot_by_link: DataFrame | None
    base: DataFrame


def _split(size, hot_key_size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / F.lit(hot_key_size))).cast("int")


def _links_of_vertices(ms: DataFrame, tables: _Tables, hot_key_size: int = HOT_KEY_SIZE) -> Memberships:
    multi = tables.write(ms.where(F.col(K) > 1).select(V, L, K, _split(F.col(K), hot_key_size).alias("cl")), [L], "by_link")
    base = tables.write(multi.groupBy(V).agg(F.sum(F.col(K) - 1).cast("double").alias("W"), F.count(F.lit(1)).alias("n"))
                        .withColumn("cv", _split(F.col("n"), hot_key_size)), [V], "vertices", dealt=True)
    hot_vertices = base.where("cv > 1").select(V, "cv")
    any_hot = multi.agg(F.max("cl").alias("cl")).first()["cl"] or 1, base.agg(F.max("cv").alias("cv")).first()["cv"] or 1
    # Only the few vertices that are split are joined; there are none on most data.
    of_vertex = multi.select(V, L, "cl")
    hot_by_vertex = hot_by_link = None
    if any_hot[1] > 1:
        split = of_vertex.join(hot_vertices, V)
        hot_by_vertex = tables.write(split.select(V, F.pmod(F.xxhash64(L), "cv").cast("int").alias("vs"), L, "cl"), [V, "vs"], "hot_by_vertex")
        of_vertex = of_vertex.join(hot_vertices, V, "left_anti")
    if any_hot[0] > 1:
        hot_by_link = tables.write(multi.where("cl > 1").select(L, F.pmod(F.xxhash64(V), "cl").cast("int").alias("ls"), V), [L, "ls"], "hot_by_link")
    return Memberships(tables.write(of_vertex, [V], "by_vertex"), multi.where("cl = 1").select(L, V), hot_by_vertex, hot_by_link, base)


def _replicate(df: DataFrame, count_col: str, name: str) -> DataFrame:
    """One copy of each row per sub-key ``0 .. count-1``."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(count_col) - 1))).drop(count_col)


def _meet(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, of which each task hashes its part: neither side is sorted."""
    return rows.join(few.hint("shuffle_hash"), keys, how)


def _gather(mem: Memberships, sent: DataFrame) -> DataFrame:
    """``(v, T, AA)``: per vertex, the sum over its links of the link totals of
    ``sent.x`` and of the number of senders. ``sent``: ``(v, x, cv)`` of senders.

    What meets the memberships has one row per vertex or link and is hashed, a
    bucket at a time; the memberships stream past it, unsorted. The split
    factors travel only where a link is split.
    """
    split = ["cl"] if mem.hot_by_link is not None else []
    reached = _meet(mem.by_vertex, sent.select(V, "x"), [V]).select(L, "x", *split)
    if mem.hot_by_vertex is not None:
        reached = reached.unionByName(_meet(mem.hot_by_vertex, _replicate(sent.where("cv > 1"), "cv", "vs"), [V, "vs"]).select(L, "x", *split))
    per_link = reached.groupBy(L).agg(F.sum("x").alias("S"), F.count(F.lit(1)).alias("A"), *[F.max(c).alias(c) for c in split])
    back = _meet(mem.by_link, per_link.drop("cl"), [L]).select(V, "S", "A")
    if mem.hot_by_link is not None:
        back = back.unionByName(_meet(mem.hot_by_link, _replicate(per_link.where("cl > 1"), "cl", "ls"), [L, "ls"]).select(V, "S", "A"))
    return back.groupBy(V).agg(F.sum("S").alias("T"), F.sum("A").alias("AA"))


def lazy_walk_rank(ms: DataFrame, damping: float = 0.15, tolerance: float = 0.01,
                   max_iter: int = 10, hot_key_size: int = HOT_KEY_SIZE) -> RankRun:
    """G6 on sized memberships ``(v, link, k)``; returns ``(v, rank)``."""
    tables = _Tables(ms.sparkSession)
    try:
        mem = _links_of_vertices(ms, tables, hot_key_size)
        state = _State(tables)
        rank, steps, tol, trace = F.lit(1.0), 0, 1.0, []
        state.frame = mem.base.select(V, "W", "n", "cv", rank.alias("rank"))
        while tol > tolerance and steps < max_iter:
            now = state.frame
            got = _gather(mem, now.select(V, (F.col("rank") / F.col("W")).alias("x"), "cv"))
            own = F.col("n") * (F.col("rank") / F.col("W"))
            new = _meet(now, got, [V]).select(
                V, "W", "n", "cv", F.col("rank").alias("old"),
                (F.col("rank") * damping + (F.col("T") - own) * (1.0 - damping)).alias("rank"))
            tol = state.write(new, tol=F.max(F.abs(F.col("old") - F.col("rank"))))["tol"] or 0.0
            steps += 1
            trace.append(tol)
        return RankRun(state.result(state.frame.select(V, "rank")), steps, trace)
    finally:
        tables.release()


def pagerank(ms: DataFrame, vertices: DataFrame, damping: float = 0.85, tolerance: float = 0.01,
             max_iter: int | None = None, hot_key_size: int = HOT_KEY_SIZE) -> RankRun:
    """G9 on sized memberships ``(v, link, k)`` and the vertex set ``(v)``; returns ``(v, rank)``."""
    reset = 1.0 - damping
    keep = 1.0 - reset
    start = 0.0 + keep * (reset / (1.0 - reset))
    is_sender = F.col("active") & (F.col("delta") > tolerance) & F.col("W").isNotNull()
    senders, receivers = F.count(F.when(is_sender, 1)), F.count(F.when(F.col("active"), 1))
    tables = _Tables(ms.sparkSession)
    try:
        mem = _links_of_vertices(ms, tables, hot_key_size)
        state = _State(tables)
        seen = state.write(vertices.select(V).distinct().join(mem.base, V, "left")
                           .select(V, "W", "n", "cv", F.lit(start).alias("pr"), F.lit(start - 0.0).alias("delta"),
                                   F.lit(True).alias("active")), senders=senders)
        steps, trace = 0, []
        while seen["senders"] and (max_iter is None or steps < max_iter):
            now = state.frame
            x = F.col("delta") * (1.0 / F.col("W"))
            got = _gather(mem, now.where(is_sender).select(V, x.alias("x"), "cv"))
            y, s = F.when(is_sender, x).otherwise(F.lit(0.0)), F.when(is_sender, F.lit(1)).otherwise(F.lit(0))
            joined = _meet(now, got, [V], "left")
            receives = F.coalesce(F.col("AA") - F.col("n") * s, F.lit(0)) > 0
            new_pr = F.col("pr") + (F.col("T") - F.col("n") * y) * keep
            new = joined.select(
                V, "W", "n", "cv",
                F.when(receives, new_pr).otherwise(F.col("pr")).alias("pr"),
                F.when(receives, new_pr - F.col("pr")).otherwise(F.col("delta")).alias("delta"),
                receives.alias("active"))
            seen = state.write(new, senders=senders, receivers=receivers)
            steps += 1
            trace.append(seen["receivers"])
        final = state.frame
        total = final.agg(F.sum("pr").alias("s"), F.count(F.lit(1)).alias("n")).select(
            (F.col("n").cast("double") / F.col("s")).alias("f")).scalar()
        return RankRun(state.result(final.select(V, (F.col("pr") * total).alias("rank"))), steps, trace)
    finally:
        tables.release()
