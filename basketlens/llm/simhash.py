"""SimHash near-duplicate classes by the generalised pigeonhole principle.

Fingerprints of all documents are collapsed to the distinct ones. Their 64 bits
are grouped into partitions of correlated bits, and each partition i gets its
own threshold t_i, with sum(t_i + 1) = max_bits + 1: two fingerprints within
``max_bits`` then agree to within t_i bits in at least one partition. Number of
partitions and thresholds come from a dynamic program over estimated costs
(signatures written plus candidates checked), estimated from bit counts over
all fingerprints. Every fingerprint writes its value of each partition and the
values within t_i bits; fingerprints that share a value are candidates and are
verified on all 64 bits.

A value's candidates are never emitted as pairs: verified links are reduced to
a spanning forest inside the task. A value with more than ``BLOCK`` candidates
is split into blocks, and each pair of blocks is one unit of work.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import column_bytes, give_back, hex64
from basketlens.llm.components import components
from basketlens.session import materialize

#: Candidates of one value that one task handles at once.
BLOCK = 8192
#: Up to so many candidates are compared by shifting, beyond it by search.
SMALL = 64
#: Cost of checking a candidate relative to writing a signature.
CHECK_COST = 0.02
#: Shingles hashed at a time (bounds memory for very long texts).
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles (no word: 0)."""
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits on ASCII white space
    n = len(words) - shingle + 1
    if not words:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, max(n, 1), CHUNK):
        part = words[at:at + CHUNK + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle))) if n > 0 else [part]
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > max(n, 1)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row; fp is the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in column_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
        give_back()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- partitions and thresholds

def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((64, 64), np.int64)
        n = 0
        for frame in frames:
            bits = np.unpackbits(frame["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(frame)
        yield pd.DataFrame({"i": np.append(np.repeat(np.arange(64), 64), 64), "j": np.append(np.tile(np.arange(64), 64), 64), "c": np.append(both.ravel(), n)})
    rows = distinct.select("fp").mapInPandas(run, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()  # 4,097 rows at any size
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        if r["i"] == 64:
            n = r["c"]
        else:
            both[r["i"], r["j"]] = r["c"]
    return n, both


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the 64 bits into ``parts`` groups of near-equal width, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        width = (64 + k) // parts
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < width:
            nxt = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(nxt)
            left.discard(nxt)
        groups.append(sorted(group))
    return groups


def plan(n: int, both: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """The cheapest ``[(bits, threshold)]`` by estimated cost; partitions without a threshold are left out."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)  # chance that two fingerprints differ in a bit
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for parts in range(1, max_bits + 2):
        groups = correlated_groups(n, both, parts)
        cost = []
        for g in groups:
            dist = np.array([1.0])
            for b in g:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            row = [0.0]
            for t in range(max_bits + 1):
                probes = sum(math.comb(len(g), k) for k in range(t + 1))
                row.append(probes + CHECK_COST * n / 2 * dist[:t + 1].sum())
            cost.append(row)  # cost[i][t + 1]
        # dynamic program: the least cost of the first i partitions with sum(t + 1) = s
        table: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in table[-1].items():
                for t1, extra in enumerate(row):
                    if s + t1 <= max_bits + 1 and c + extra < nxt.get(s + t1, (math.inf,))[0]:
                        nxt[s + t1] = (c + extra, [*chosen, t1 - 1])
            table.append(nxt)
        c, thresholds = table[-1][max_bits + 1]
        if c < best[0]:
            best = (c, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return best[1]


def signatures(distinct: DataFrame, scheme: list[tuple[list[int], int]]) -> DataFrame:
    """``(part, value, fp)``: per fingerprint and partition its value and all values within the threshold."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy(np.int64)
            u = fp.view(np.uint64)
            for part, (bits, t) in enumerate(scheme):
                value = np.zeros(len(u), np.uint64)
                for k, b in enumerate(bits):
                    value |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
                for flips in range(t + 1):
                    for combo in itertools.combinations(range(len(bits)), flips):
                        mask = np.uint64(sum(1 << k for k in combo))
                        yield pd.DataFrame({"part": np.full(len(u), part, np.int32), "value": (value ^ mask).view(np.int64), "fp": fp})
    return distinct.select("fp").mapInPandas(run, "part int, value long, fp long")


# ---------------------------------------------------------------- verification

def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between distinct fingerprints, by breadth-first search.

    Each fingerprint is compared with those not yet reached, so a dense group
    costs little more than its size and only a group without links costs its square.
    """
    rest = fps.view(np.uint64).copy()
    us, vs = [], []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= max_bits
            if near.any():
                found = rest[near]
                us.append(np.full(len(found), at))
                vs.append(found)
                frontier.extend(found)
                rest = rest[~near]
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)


def links(signature_rows: DataFrame, max_bits: int) -> DataFrame:
    """Verified links ``(u, v)`` that connect whatever shares a signature value."""
    schema = "kind int, part int, value long, block int, u long, v long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple[int, int] | None = None
        held: list[np.ndarray] = []
        size = blocks = 0

        def out(kind, part, value, block, u, v):
            return pd.DataFrame({"kind": np.full(len(u), kind, np.int32), "part": np.full(len(u), part, np.int32), "value": np.full(len(u), value, np.int64), "block": np.full(len(u), block, np.int32), "u": u, "v": v})

        def close():
            """What the current value's held fingerprints give: links, or one more block of a large value."""
            if size and blocks:
                members = np.concatenate(held)
                return out(1, *key, blocks, members, members)
            if size > 1:
                return out(0, 0, 0, 0, *forest(np.concatenate(held), max_bits))
            return None

        for frame in frames:
            part, value, fp = (frame[c].to_numpy() for c in ("part", "value", "fp"))
            if not len(fp):
                continue
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0)) + 1
            starts, ends = np.append(0, new), np.append(new, len(fp))
            sizes = ends - starts
            inner = np.ones(len(starts), bool)
            inner[0] = inner[-1] = False  # the first and last value of a batch may go on in another
            small = inner & (sizes > 1) & (sizes <= SMALL)
            if small.any():
                group = np.repeat(np.where(small, np.arange(len(starts)), -1), sizes)
                for shift in range(1, int(sizes[small].max())):
                    same = np.flatnonzero((group[shift:] == group[:-shift]) & (group[shift:] >= 0))
                    if not len(same):
                        break
                    near = same[np.bitwise_count((fp[same] ^ fp[same + shift]).view(np.uint64)) <= max_bits]
                    if len(near):
                        yield out(0, 0, 0, 0, fp[near], fp[near + shift])
            for k in np.flatnonzero(~inner | (sizes > SMALL)):
                now = (int(part[starts[k]]), int(value[starts[k]]))
                if now != key:
                    if (done := close()) is not None:
                        yield done
                    key, held, size, blocks = now, [], 0, 0
                at = starts[k]
                while at < ends[k]:
                    take = min(ends[k] - at, BLOCK - size)
                    held.append(fp[at:at + take])
                    size += take
                    at += take
                    if size == BLOCK:
                        members = np.concatenate(held)
                        yield out(1, *key, blocks, members, members)
                        held, size, blocks = [], 0, blocks + 1
        if (done := close()) is not None:
            yield done

    spread = signature_rows.repartition("part", "value").sortWithinPartitions("part", "value")
    found = materialize(spread.mapInPandas(run, schema), "links")
    small = found.filter("kind = 0").select("u", "v")
    # A value with at least BLOCK fingerprints: every pair of its blocks is compared.
    large = found.filter("kind = 1").select("part", "value", "block", F.col("u").alias("fp"))
    last = large.groupBy("part", "value").agg(F.max("block").alias("last"))
    paired = (large.join(last, ["part", "value"])
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
              .select("part", "value", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "fp"))

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        u, v = forest(frame["fp"].drop_duplicates().to_numpy(np.int64), max_bits)
        return pd.DataFrame({"u": u, "v": v})

    return small.union(paired.groupBy("part", "value", "a", "b").applyInPandas(pair, "u long, v long"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked;
    ``component_id`` is the smallest id reachable over links. A null or empty
    text has fingerprint zero and is linked like any other; repeated rows come
    back as often as they come in; rows with a null id take part, but a class
    of such rows only has a null ``component_id``. Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    scheme = plan(*bit_counts(distinct), max_bits)
    roots = components(links(signatures(distinct, scheme), max_bits))
    rooted = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", hex64("fp").alias("fingerprint"), "component_id")
