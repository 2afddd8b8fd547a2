"""Conversation prefix trie in double arrays.

Conversations are cut into segments of ``SEGMENT`` turns (nearly all have one).
A segment's context is the prefix before it, known by a 128-bit key that is the
exclusive or of hashes of (depth, turn), so that segments of one conversation
need not meet to find it. Segments are dealt by range of their turn sequences:
a shard of the trie is a stretch of the sorted sequences, however many
conversations share them.

A task packs each stretch into a double array over dense turn numbers (a child
lies at ``BASE[node] + number``; ``CHECK`` there names its parent) and walks its
conversations through it. A stretch shares nodes with others only on the paths
of its first and last sequence, and on those of conversations of several
segments: these nodes are open. All other nodes are finished in the task. Open
nodes come back as one row per path and depth, with what the stretch alone knows
of them, and are merged globally: each open node is counted on the first of its
paths, and sums of subtrees are sums along paths from the end, added up per node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.blocks import runs
from basketlens.session import materialize

#: Turns of a segment, and of the segments that one double array holds (about).
SEGMENT, STRETCH = 64, 100_000
#: Places that are tried for a node's children before the end of the arrays.
TRIES = 64
#: The rows of a parent with very many children are dealt over so many keys.
SALT = 32
CLOSED, OPEN, END = 0, 1, 2


class DoubleArray:
    """``BASE`` and ``CHECK`` over sorted, distinct sequences of symbols. Node 0 is the root.

    Symbols are numbered densely as nodes come up, a node's children together: a
    symbol that has one parent, as nearly all turns have, lies next to its
    siblings, which packs the arrays tightly.
    """

    def __init__(self, sequences: list[tuple]):
        nodes = sum(map(len, sequences)) + 1
        self.base, self.check = [0] * nodes, [-1] * nodes
        self.check[0] = 0  # the root is its own parent
        self.code: dict = {}
        self.order = [0]  # parents before children
        self._free = self._end = 1
        todo = [(0, 0, len(sequences), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(sequences[lo]) == depth:
                lo += 1
            if lo == hi:
                continue
            edges = [lo]
            if sequences[hi - 1][depth] != sequences[lo][depth]:
                edges += [i for i in range(lo + 1, hi) if sequences[i][depth] != sequences[i - 1][depth]]
            codes = [self.code.setdefault(sequences[i][depth], len(self.code)) for i in edges]
            base = self.base[node] = self._place(codes)
            for code, a, b in zip(codes, edges, [*edges[1:], hi]):
                self.check[base + code] = node
                self.order.append(base + code)
                todo.append((base + code, a, b, depth + 1))
            self._end = max(self._end, base + max(codes) + 1)
        del self.base[self._end:], self.check[self._end:]

    def _place(self, codes: list[int]) -> int:
        """A base with a free slot for every code: first fit among ``TRIES`` places, else behind all others."""
        check, first = self.check, self._free
        while first < len(check) and check[first] >= 0:
            first += 1
        self._free = first
        low, high = min(codes), max(codes)
        for at in (*range(first, min(first + TRIES, self._end)), max(first, self._end)):
            base = at - low
            if base + high >= len(check):
                more = base + high + 1 - len(check)
                check += [-1] * more
                self.base += [0] * more
            if all(check[base + c] < 0 for c in codes):
                return base
        raise AssertionError("the slots behind all others are free")

    def child(self, node: int, symbol) -> int:
        """The child of ``node`` by ``symbol``, or -1."""
        code = self.code.get(symbol)
        at = -1 if code is None else self.base[node] + code
        return at if 0 < at < len(self.check) and self.check[at] == node else -1


#: The columns that a stretch gives.
SCHEMA = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in (
    "path", "depth", "k1", "k2", "p1", "p2", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "chars")], ("ends", pa.string())])


def _stretch(rows: list[tuple]) -> list[tuple]:
    """The output rows of one stretch of sorted ``(j, k1, k2, conv, n, digests, chars, x1, x2)``."""
    contexts = {c: i for i, c in enumerate(dict.fromkeys(r[:3] for r in rows))}
    paths = [(contexts[r[:3]], *r[5]) for r in rows]
    trie = DoubleArray(list(dict.fromkeys(paths)))
    size = len(trie.check)
    members, least, chars = [0] * size, [None] * size, [0] * size
    depth, keys, ends, walked = {}, {}, {}, []
    last, nodes = None, []
    for i, (row, path) in enumerate(zip(rows, paths)):
        j, k1, k2, conv, n, _, lengths, _, _ = row
        if path != last:
            node, nodes, last = 0, [], path
            for k, c in enumerate(path):
                node = trie.child(node, c)
                nodes.append(node)
                depth[node] = j * SEGMENT + k
                if k:
                    chars[node] = lengths[k - 1]
            keys[nodes[0]] = (k1, k2)
        for node in nodes:
            members[node] += 1
            if least[node] is None or conv < least[node]:
                least[node] = conv
        if i in (0, len(rows) - 1) or n > SEGMENT:
            walked.append((row, nodes))
        if j == max(0, n - 1) // SEGMENT:
            ends.setdefault(nodes[-1], []).append(conv)
    out, given = [], set()
    opened = {node for _, nodes in walked for node in nodes}
    children, leaves, saved = [0] * size, [0] * size, [0] * size  # of the finished nodes below
    for node in reversed(trie.order[1:]):
        if node not in opened:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * chars[node]
            parent = trie.check[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    for (j, k1, k2, conv, _, _, _, x1, x2), nodes in walked:
        key, parent = (k1, k2), (None, None)
        for k, node in enumerate(nodes):
            if k:
                parent, key = key, (key[0] ^ x1[k - 1], key[1] ^ x2[k - 1])
                keys[node] = key
            elif j:
                continue  # given as the last node of the segment before
            known = (members[node], children[node], leaves[node], saved[node]) if node not in given else (0, 0, 0, 0)
            given.add(node)
            out.append((OPEN, conv, depth[node], *key, *parent, least[node], None, *known, chars[node], None))
    for node in trie.order[1:]:
        over, own = trie.check[node], sorted(ends.get(node, ()))
        if node in opened:
            out += [(END, conv, depth[node], *keys[node], *[None] * 10) for conv in own]
        else:
            above = (*keys[over], None) if over in opened else (None, None, least[over])
            out.append((CLOSED, None, depth[node], None, None, *above[:2], least[node], above[2], members[node], children[node], leaves[node], saved[node], chars[node],
                        hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()))
    return out


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_stretch(rows)), SCHEMA)], schema=SCHEMA)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            rows.append(row)
            size += len(row[5]) + 1
            if size >= STRETCH:
                yield given()
                rows, size = [], 0
    if rows:
        yield given()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, read as a stream: one running hash, however many ids."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())])
    now, running, out = None, None, []
    for key, batch in runs(batches, ("depth", "k1", "k2")):
        if key != now:
            if running:
                out.append((*now, running.hexdigest()))
            now, running, begun = key, hashlib.sha256(), False
        running.update((("," if begun else "") + ",".join(map(str, batch.column("path").to_pylist()))).encode())
        begun = True
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
            out = []
    if running:
        out.append((*now, running.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)


def positions(conversations: DataFrame) -> DataFrame:
    """``conv, pos, digest, chars``: every turn with its place from 0 in its conversation.

    Ordered by turn, null first; rows with equal turns by role and text. A null
    role or text is empty; rows without conv_id take no part. ``digest`` stands
    for role and text. Places come from one sort by range, so that a
    conversation may have any number of turns.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    placed = materialize(rows.orderBy("conv", F.col("turn").asc_nulls_first(), "role", "text").select(
        "conv", digest.alias("digest"), F.length("text").alias("chars"), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at")), "placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low")).select(
        "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    indexed = placed.join(F.broadcast(offsets), "part").select("conv", (F.col("at") + F.col("shift")).alias("at"), "digest", "chars")
    first = indexed.groupBy("conv").agg(F.min("at").alias("first"))
    return indexed.join(first, "conv").select("conv", (F.col("at") - F.col("first")).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(conv, pos, digest, chars, n)`` and ``(conv, n)`` of conversations that begin like the first of their group.

    Conversation c takes the first h turns of conversation c - c % group, then
    its own after its first h; h = crc32 of c in decimal, modulo ``most``. n:
    its number of turns (the second frame holds those without any, too).
    """
    turns = materialize(turns, "turns")
    head = turns.filter((F.col("conv") % group == 0) & (F.col("pos") < most - 1)).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head")).withColumnRenamed("conv", "donor")
    own = turns.groupBy("conv").agg(F.count("*").alias("m")).withColumns({
        "h": (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int"), "donor": F.col("conv") - F.col("conv") % group})
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:long,digest:binary,chars:int>>")), F.lit(1), F.col("h"))
    convs = materialize(own.join(head, "donor", "left").select("conv", "h", taken.alias("head"), (F.size(taken) + F.greatest(F.lit(0), F.col("m") - F.col("h"))).alias("n")), "convs")
    tail = turns.join(convs.select("conv", "h", "n", F.size("head").alias("taken")), "conv").filter("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars", "n")
    begun = convs.select("conv", "n", F.explode("head").alias("t")).select("conv", "t.pos", "t.digest", "t.chars", "n")
    return tail.unionByName(begun), convs.select("conv", "n")


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``j, k1, k2, conv, n, digests, chars, x1, x2``: at most ``SEGMENT`` turns each, with the key of the prefix before them."""
    mixed = {x: F.xxhash64(F.lit(seed), F.col("pos"), F.col("digest")) for x, seed in (("x1", 1), ("x2", 2))}
    cut = turns.withColumns(mixed).withColumn("j", F.floor(F.col("pos") / SEGMENT)).groupBy("conv", "j").agg(
        F.max("n").alias("n"), F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"),
        F.sort_array(F.collect_list(F.struct("pos", "digest", "chars", "x1", "x2"))).alias("turns"))  # at most SEGMENT
    before = Window.partitionBy("conv").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    keyed = cut.filter(F.col("n") > SEGMENT).withColumns({k: F.coalesce(F.bit_xor(s).over(before), F.lit(0)) for k, s in (("k1", "s1"), ("k2", "s2"))})
    whole = cut.filter(F.col("n") <= SEGMENT).withColumns({"k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long")})
    lists = keyed.unionByName(whole).select("j", "k1", "k2", "conv", "n", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"),
                                            F.col("turns.x1").alias("x1"), F.col("turns.x2").alias("x2"))
    bare = convs.filter("n = 0").selectExpr("0L j", "0L k1", "0L k2", "conv", "n", "cast(array() as array<binary>) digests", "cast(array() as array<int>) chars",
                                            "cast(array() as array<long>) x1", "cast(array() as array<long>) x2")
    return lists.unionByName(bare)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every distinct sequence of first d turns of a conversation as a node of depth d.

    ``turns``: ``conv, pos, digest, chars, n`` with places from 0 and n turns a
    conversation; ``convs``: ``conv, n`` of all. Per node: ``conv_id`` (smallest
    member: conversation that begins so), ``depth``, ``parent_conv_id`` (of the
    root null), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in its
    subtree, itself included), ``saved_tokens`` (over its subtree: characters of
    a node's last turn times members but one), ``ends_sha256`` (of the ids,
    ascending, of members of just d turns). No conversations: no rows.
    """
    spark = turns.sparkSession
    order = ("j", "k1", "k2", "digests", "conv")
    cut = materialize(segments(turns, convs), "segments")
    dealt = cut.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {'int' if f.name == 'kind' else 'string' if f.name == 'ends' else 'long'}" for f in SCHEMA)
    given = materialize(dealt.mapInArrow(_tries, schema), "nodes")
    key = ["depth", "k1", "k2"]
    opened = given.filter(F.col("kind") == OPEN)
    merged = materialize(opened.groupBy(*key).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv"), F.min("path").alias("path"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]), "open-nodes")
    below = merged.filter("p1 IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more"))
    nodes = merged.join(below, key, "left").fillna(0, ["more"]).withColumn("n_children", F.col("n_children") + F.col("more")).withColumns({
        "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")})
    nodes = materialize(nodes, "open-nodes")
    along = opened.select("path", *key).join(nodes.select("path", "depth", "n_leaves", "saved"), ["path", "depth"], "left").fillna(0, ["n_leaves", "saved"])
    along = along.withColumn("j", F.floor(F.col("depth") / SEGMENT))
    later = Window.partitionBy("path").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = along.groupBy("path", "j").agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s")).select(
        "path", "j", F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"))
    inside = Window.partitionBy("path", "j").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)  # at most SEGMENT rows
    totals = along.withColumns({"il": F.sum("n_leaves").over(inside), "is": F.sum("saved").over(inside)}).join(sums, ["path", "j"]).groupBy(*key).agg(
        F.sum(F.col("il") + F.col("l")).alias("n_leaves"), F.sum(F.col("is") + F.col("s")).alias("saved"))
    ends = given.filter(F.col("kind") == END).select(*key, "path").repartition(*key).sortWithinPartitions(*key, "path").mapInArrow(
        _digests, "depth long, k1 long, k2 long, ends string")
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv"))
    columns = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    shared = nodes.drop("n_leaves", "saved").join(totals, key).join(ends, key, "left").join(over, ["depth", "p1", "p2"], "left").withColumn(
        "ends", F.coalesce("ends", F.sha2(F.lit(""), 256))).select(columns)
    closed = given.filter(F.col("kind") == CLOSED)
    salted = closed.filter("p1 IS NOT NULL").drop("parent_conv").withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALT)).cast("int")).join(
        over.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["depth", "p1", "p2", "salt"]).select(columns)
    out = closed.filter("p1 IS NULL").select(columns).unionByName(salted).unionByName(shared)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
