"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort.

What is asked: every byte covered by a ``length``-byte string that also starts
somewhere else. Sorting all suffixes would move each byte hundreds of times, so
the suffixes that are sorted start at *anchors*, positions that depend only on
the bytes around them: in each window of ``length`` bytes, the ``GRAM``-byte
strings with the smallest hash. Equal windows hold equal anchors at equal
offsets, so every repeat is seen from an anchor. Anchors whose gram occurs once
in the corpus are left out (a distinguishing-prefix test by hash, as in
distributed string sorting); exact copies of a text are sorted once.

Around an anchor at byte a, a window that starts at a - o lies in the repeat
that a and another anchor b share if o <= L(a, b) and length - o <= R(a, b),
the common bytes to the left and right of the two. Two sorts give exact answers
for every pair that is long on one side:

* right suffix, then the reversed left context: neighbours in this order have
  the longest common right part, and among partners with a full right part the
  longest left part;
* reversed left context, then right suffix: the same with sides exchanged.

Neighbours in either order are also compared on their other side, which settles
most windows that lie in a pair cut off on both sides. Where the two bounds
leave a window undecided, the windows themselves are sorted, in the same way.

Each sort: a map task sorts runs of bounded size, front-codes them and cuts them
at splitters drawn from a sample; a reduce task merges the runs of its range
with a loser tree that carries common prefix lengths, so that no known prefix
is compared again. Equal strings are one entry with a list of positions, so a
passage in a third of all documents is as cheap as any other. The first and
last strings of the ranges are compared on the driver (one pair per range).
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import column_bytes, give_back
from basketlens.session import materialize

#: Bytes of the strings by which anchors are chosen and matched first.
GRAM = 128
#: Bytes of strings that one sorted run holds.
RUN_BYTES = 16 << 20
#: Strings of one front-coded block, and strings aimed at per range.
BLOCK_STRINGS = 256
RANGE_STRINGS = 150_000
#: Sampled strings per range from which the splitters are drawn.
SAMPLES_PER_RANGE = 20

Strings = Iterator[tuple[bytes, int, int]]  # string, text id, position


# ---------------------------------------------------------------- anchors

def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` (a power of two) bytes from each position."""
    h = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    base, k = np.uint64(0xD1342543DE82EF95), 1
    while k < gram:
        h = h[:-k] * base + h[k:]
        with np.errstate(over="ignore"):
            base = base * base
        k *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[:len(x) - (width - k)], x[width - k:]) if width > k else x


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the smallest grams of all windows of ``length`` bytes, and their hashes."""
    if len(text) < length:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    width = length - gram + 1
    least = _sliding(h, width, np.minimum)  # of each window
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(h == _sliding(padded, width, np.maximum)).astype(np.int32)
    return at, h[at].view(np.int64)


# ---------------------------------------------------------------- front-coded runs and their merge

def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def encode(entries: list[tuple[bytes, int, list[int], list[int]]]) -> bytes:
    """Entries (string, common prefix with the one before, text ids, positions) -> a compressed block."""
    lcps = np.array([0] + [e[1] for e in entries[1:]], np.int32)
    tails = [e[0][p:] for e, p in zip(entries, lcps.tolist())]
    head = np.array([len(entries), sum(len(e[2]) for e in entries)], np.int64)
    parts = [head, lcps, np.array([len(t) for t in tails], np.int32), np.array([len(e[2]) for e in entries], np.int64),
             np.array([i for e in entries for i in e[2]], np.int64), np.array([p for e in entries for p in e[3]], np.int32)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts) + b"".join(tails))


def decode(block: bytes) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray]]:
    """The entries of a block, in order."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, refs = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16
    lcps = np.frombuffer(raw, np.int32, n, at).tolist()
    sizes = np.frombuffer(raw, np.int32, n, at + 4 * n).tolist()
    counts = np.frombuffer(raw, np.int64, n, at + 8 * n).tolist()
    at += 16 * n
    ids, positions = np.frombuffer(raw, np.int64, refs, at), np.frombuffer(raw, np.int32, refs, at + 8 * refs)
    at += 12 * refs
    string, ref = b"", 0
    for p, size, count in zip(lcps, sizes, counts):
        string = string[:p] + raw[at:at + size]
        yield string, p, ids[ref:ref + count], positions[ref:ref + count]
        at += size
        ref += count


class Run:
    """A sorted run, read block by block."""

    def __init__(self, blocks: list[bytes]):
        self.entries = self._read(blocks)
        self.string: bytes | None = None
        self.prefix = 0  # common prefix with the last string that the tree gave out
        self.advance()

    @staticmethod
    def _read(blocks):
        last = None
        for k, block in enumerate(blocks):
            for n, (string, p, ids, positions) in enumerate(decode(block)):
                yield string, (common_prefix(last, string, 0) if last is not None and n == 0 else p), ids, positions
                last = string
            blocks[k] = None

    def advance(self):
        entry = next(self.entries, None)
        if entry is None:
            self.string, self.prefix = None, -1
        else:
            self.string, self.prefix, self.ids, self.positions = entry


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray]]:
    """Loser-tree merge: (string, common prefix with the string given out before, ids, positions)."""
    k = len(runs)
    if not k:
        return

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix then counts against the winner."""
        x, y = runs[a], runs[b]
        if x.string is None:
            return b, a
        if y.string is None or x.prefix > y.prefix:
            return a, b
        if x.prefix < y.prefix:
            return b, a
        p = common_prefix(x.string, y.string, x.prefix)
        if x.string[p:p + 1] <= y.string[p:p + 1]:
            y.prefix = p
            return a, b
        x.prefix = p
        return b, a

    for run in runs:
        run.prefix = 0 if run.string is not None else -1
    losers = [-1] * k
    for leaf in range(k):  # build: a leaf climbs until it finds an empty place
        at, node = leaf, (leaf + k) // 2
        while node > 0 and losers[node] >= 0:
            at, losers[node] = play(at, losers[node])
            node //= 2
        losers[node] = at
    while True:
        winner = runs[losers[0]]
        if winner.string is None:
            return
        yield winner.string, winner.prefix, winner.ids, winner.positions
        winner.advance()
        at, node = losers[0], (losers[0] + k) // 2
        while node > 0:
            at, losers[node] = play(at, losers[node])
            node //= 2
        losers[0] = at


Shared = tuple[np.ndarray, np.ndarray, int, int, int, tuple[int, int, int, int]]


def longest_shared(entries: Iterator[tuple[bytes, int, np.ndarray, np.ndarray]], ends: list, first: int) -> Iterator[Shared]:
    """Per string: (ids, positions, longest prefix shared with any other, edge, number of the string, pairs).

    edge is 1 for the range's first string, 2 for its last, 3 for both; ``ends``
    gets those two strings. pairs: what the string shares with the one before
    it, in its first ``first`` bytes and in those behind, and the same for the
    one after it (0, 0 where unknown). A string found twice is given out as it
    comes, so the positions of a frequent string are never held together.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    string, best, seen, number, before = b"", 0, 0, 0, (0, 0)

    def flush(edge, after):
        for ids, positions in held:
            yield ids, positions, best, edge, number, (*before, *after)
        held.clear()

    for s, p, ids, positions in entries:
        if seen and p == len(s) == len(string):
            best = len(s)
            yield from flush(0, (0, 0))
            yield ids, positions, best, 0, number, (*before, 0, 0)
            seen += len(ids)
            continue
        pair = (0, 0)
        if seen:
            best = max(best, p)
            pair = (p, common_prefix(string[first:], s[first:], 0)) if p < first else (0, 0)
            yield from flush(0 if number else 1, pair)
            number += 1
        else:
            ends.append(s)
        string, seen, before = s, len(ids), pair
        best = len(s) if seen > 1 else p
        held.append((ids, positions))
    if seen:
        ends.append(string)
        yield from flush(2 if number else 3, (0, 0))


# ---------------------------------------------------------------- the distributed sort

def shared_prefixes(rows: DataFrame, strings: Callable[[dict], Strings], expected: int, first: int) -> DataFrame:
    """``(text_id, pos, best, string_id, pairs)``: for each string of ``rows``, the longest prefix shared with any other.

    Equal strings have equal ``string_id``. ``pairs`` holds what a string shares
    with its neighbours, in its ``first`` bytes and behind (see :func:`longest_shared`).

    ``strings`` makes the strings of one row (a dict of its columns);
    ``expected`` is about how many there are in all.
    """
    spark = rows.sparkSession
    ranges = max(1, -(-expected // RANGE_STRINGS))
    share = min(1.0, SAMPLES_PER_RANGE * ranges / max(1, expected))

    def sample(batches):
        for batch in batches:
            got = [s for row in _rows(batch) for s, i, p in strings(row) if (i * 0x9E3779B1 + p * 0x85EBCA77) % 65536 < 65536 * share]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["s"])

    drawn = sorted(r["s"] for r in rows.mapInArrow(sample, "s binary").collect()) if ranges > 1 else []
    splitters = sorted({bytes(drawn[len(drawn) * k // ranges]) for k in range(1, ranges)}) if drawn else []

    def runs(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def close():
            held.sort()
            out, entries, dest = [], [], -1
            last = b""

            def put():
                if entries:
                    out.append((dest, (part << 24) + number, len(out), encode(entries)))
                    entries.clear()

            for s, i, p in held:
                if entries and s == last:
                    entries[-1][2].append(i)
                    entries[-1][3].append(p)
                    continue
                to = bisect.bisect_right(splitters, s)
                if to != dest or len(entries) >= BLOCK_STRINGS:
                    put()
                    dest = to
                entries.append((s, common_prefix(last, s, 0) if entries else 0, [i], [p]))
                last = s
            put()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["dest", "run", "seq", "block"])

        for batch in batches:
            for row in _rows(batch):
                for item in strings(row):
                    held.append(item)
                    size += len(item[0]) + 100
                    if size > RUN_BYTES:
                        yield close()
                        size, number = 0, number + 1
        if held:
            yield close()
        give_back()

    def merged(batches):
        def emit(dest, blocks):
            ends: list[bytes] = []
            out = longest_shared(merge([Run(b) for b in blocks]), ends, first)
            got, n = [], 0
            for item in out:
                got.append(item)
                n += len(item[0])
                if n > 20_000:
                    yield result(dest, got)
                    got, n = [], 0
            if got:
                yield result(dest, got)
            yield pa.RecordBatch.from_arrays([pa.array([None, None], pa.int64()), pa.array([0, 0], pa.int32()), pa.array([0, 0], pa.int32()), pa.array([1, 2], pa.int32()), pa.array([dest, dest], pa.int32()), pa.array([0, 0], pa.int64()), pa.nulls(2, pa.list_(pa.int32())), pa.array(ends, pa.binary())], names)

        names = ["text_id", "pos", "best", "edge", "dest", "string_id", "pairs", "string"]

        def result(dest, got):
            sizes = [len(g[0]) for g in got]
            n = sum(sizes)
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got])),
                pa.array(np.repeat(np.array([g[2] for g in got], np.int32), sizes)), pa.array(np.repeat(np.array([g[3] for g in got], np.int32), sizes)),
                pa.array(np.full(n, dest, np.int32)), pa.array(np.repeat(np.array([(dest << 32) + g[4] for g in got], np.int64), sizes)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), pa.array(np.repeat(np.array([g[5] for g in got], np.int32), sizes, axis=0).ravel())),
                pa.nulls(n, pa.binary())], names)

        now, run, blocks = None, None, []
        for batch in batches:
            for dest, r, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if dest != now:
                    if blocks:
                        yield from emit(now, blocks)
                    now, run, blocks = dest, None, []
                if r != run:
                    run = r
                    blocks.append([])
                blocks[-1].append(block)
        if blocks:
            yield from emit(now, blocks)
        give_back()

    exchanged = (rows.mapInArrow(runs, "dest int, run long, seq int, block binary")
                 .repartition(len(splitters) + 1, "dest").sortWithinPartitions("dest", "run", "seq"))
    found = materialize(exchanged.mapInArrow(merged, "text_id long, pos int, best int, edge int, dest int, string_id long, pairs array<int>, string binary"), "shared")
    ends = sorted((r["dest"], r["edge"], bytes(r["string"])) for r in found.filter("string is not null").select("dest", "edge", "string").collect())
    across = []  # two rows per range: a bound known before, so they are broadcast
    for (d1, _, last), (d2, _, first) in zip(ends[1::2], ends[2::2]):
        p = common_prefix(last, first, 0)
        across += [(d1, 2, p), (d2, 1, p)]
    rows_out = found.filter("string is null")
    if across:
        edges = spark.createDataFrame(across, "d int, e int, p int").groupBy(F.col("d").alias("dest")).agg(
            F.max(F.expr("if(e = 1, p, 0)")).alias("before"), F.max(F.expr("if(e = 2, p, 0)")).alias("after"))
        rows_out = rows_out.join(F.broadcast(edges), "dest", "left").withColumn("best", F.greatest(
            "best", F.expr("if(edge in (1, 3), before, 0)"), F.expr("if(edge in (2, 3), after, 0)")))
    return rows_out.select("text_id", "pos", "best", "string_id", "pairs")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = [batch.column(k) for k in range(batch.num_columns)]
    for n in range(batch.num_rows):
        yield {name: column[n].as_py() for name, column in zip(batch.schema.names, columns)}


# ---------------------------------------------------------------- the operator

def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The repeated strings of all texts of ``docs``: ``(digests, spans, texts)``.

    ``digests``: one row per row of ``docs`` with its columns but the text, and
    ``sha`` (of the UTF-8 bytes) and ``n_bytes``. ``spans``: ``(sha, copies,
    starts)`` per distinct text with repeats; all windows from ``starts.lo`` to
    ``starts.hi`` start a repeated string, and ``starts`` is null where the
    text is an exact copy (all of it is repeated). ``texts``: ``(sha, text)``
    of the distinct texts that may have repeats.
    """
    reach = length - gram  # most bytes of a window to the left of its anchor
    names = [c for c in docs.columns if c != text_col]
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")

    def anchor_rows(batches):
        for batch in batches:
            found = [anchors(t, length, gram) for t in column_bytes(batch.column(1))]
            grams = [pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([g for _, g in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *grams], ["sha", "pos", "gram"])

    digests = materialize(docs.select(*names, F.sha2(raw, 256).alias("sha"), F.octet_length(raw).cast("long").alias("n_bytes")), "digests")
    found = materialize(docs.select(F.unhex(F.sha2(raw, 256)).alias("sha"), raw.alias("text")).filter(F.octet_length("text") >= length)
                        .mapInArrow(anchor_rows, "sha binary, pos array<int>, gram array<long>")
                        .withColumn("row", F.monotonically_increasing_id()), "anchors")
    copies = found.groupBy("sha").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    firsts = found.join(copies.select("row", "copies"), "row")
    each = firsts.select(F.col("row").alias("text_id"), "sha", "copies", F.explode(F.arrays_zip("pos", "gram")).alias("a")).select("text_id", "a.pos", "a.gram")
    # a table of its own: a join of two shuffled sides can split a gram that very many texts share
    repeated = materialize(each.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated")
    shared = each.join(repeated, "gram").groupBy("text_id").agg(F.collect_list(F.struct("pos", "gram")).alias("at"))
    listed = shared.join(firsts.select(F.col("row").alias("text_id"), "sha"), "text_id")

    def once(batches):
        seen = set()  # text ids of this hash partition: all copies of a text meet here
        for batch in batches:
            ids = batch.column("text_id").to_pylist()
            new = []
            for i in ids:
                new.append(i not in seen)
                seen.add(i)
            yield batch.filter(pa.array(new))

    texts = materialize(
        docs.select(F.unhex(F.sha2(raw, 256)).alias("sha"), raw.alias("text")).filter(F.octet_length("text") >= length)
        .join(listed.hint("shuffle_hash"), "sha").select("text_id", "sha", "text", F.col("at.pos").alias("pos"), F.col("at.gram").alias("gram"))
        .mapInArrow(once, "text_id long, sha binary, text binary, pos array<int>, gram array<long>"), "texts")
    expected = texts.agg(F.sum(F.size("pos"))).first()[0] or 0

    def right_first(row):
        text = row["text"]
        mirrored = text[::-1]
        n = len(text)
        for a in row["pos"]:
            right = text[a:a + length]
            yield (right + mirrored[n - a:n - a + reach] if len(right) == length else right), row["text_id"], a

    def left_first(row):
        text = row["text"]
        mirrored = text[::-1]
        n = len(text)
        for a in row["pos"]:
            left = mirrored[n - a:n - a + reach]
            yield (left + text[a:a + length] if len(left) == reach else left), row["text_id"], a

    by_right = shared_prefixes(texts.select("text_id", "text", "pos"), right_first, expected, length).select("text_id", "pos", "string_id", F.col("best").alias("r"), F.col("pairs").alias("rp"))
    by_left = shared_prefixes(texts.select("text_id", "text", "pos"), left_first, expected, reach).select("text_id", "pos", F.col("best").alias("l"), F.col("pairs").alias("lp"))
    # Offsets known to be repeated: what the two sorts prove, and what a neighbour in either order shares on both sides.
    known = F.expr(f"""array_sort(filter(array(
        named_struct('lo', 0, 'hi', r - {length}),
        named_struct('lo', if(l >= {reach} + {gram}, {2 * length - gram} - l, {length}), 'hi', {reach}),
        named_struct('lo', {length} - rp[0], 'hi', rp[1]), named_struct('lo', {length} - rp[2], 'hi', rp[3]),
        named_struct('lo', {length} - lp[1], 'hi', lp[0]), named_struct('lo', {length} - lp[3], 'hi', lp[2])), s -> s.lo <= s.hi))""")
    both = materialize(by_right.join(by_left, ["text_id", "pos"]).select(
        "text_id", "pos", "string_id", F.expr(f"least(r, {length})").alias("right"), F.expr(f"least(l, {reach})").alias("left"), known.alias("known"))
        .withColumn("lo", F.expr(f"aggregate(known, {length} - right, (at, s) -> if(s.lo <= at, greatest(at, s.hi + 1), at))"))
        .withColumn("hi", F.expr("aggregate(reverse(array_sort(transform(known, s -> named_struct('hi', s.hi, 'lo', s.lo)))), left, (at, s) -> if(s.hi >= at, least(at, s.lo - 1), at))")), "extents")
    spans = both.select("text_id", "pos", F.explode("known").alias("k")).select("text_id", (F.col("pos") - F.col("k.hi")).alias("lo"), (F.col("pos") - F.col("k.lo")).alias("hi"))

    # The offsets from lo to hi are undecided; their possible partners are the anchors with the same gram.
    # Anchors with equal bytes all around have equal windows: one of them stands for all (the others are decided).
    undecided = both.filter("lo <= hi")
    if not undecided.isEmpty():
        grams = materialize(each.join(repeated, "gram"), "grams")
        asked = undecided.join(grams, ["text_id", "pos"]).groupBy("gram").agg(F.min("lo").alias("from"), F.max("hi").alias("to"))
        alike = [F.expr(f"if(right >= {length}, {a}, {b})") for a, b in (("string_id", "-1L"), ("0L", "text_id"), ("0", "pos"))]  # at a text's end only the right side is compared
        stand_ins = (both.filter(f"{length} - right <= left").groupBy(*alike)
                     .agg(F.min(F.struct("text_id", "pos", "left", "right")).alias("m")).select("m.*"))
        windows = (stand_ins.join(grams, ["text_id", "pos"]).join(asked, "gram")
                   .select("text_id", "pos", F.expr(f"greatest(`from`, {length} - right)").alias("lo"), F.expr("least(`to`, left)").alias("hi")).filter("lo <= hi")
                   .groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct(F.expr("pos - hi").alias("lo"), F.expr("pos - lo").alias("hi")))).alias("w")))
        asked_texts = materialize(texts.select("text_id", "text").join(windows.hint("shuffle_hash"), "text_id"), "open")
        n_windows = asked_texts.agg(F.sum(F.expr(
            "aggregate(w, named_struct('at', -1, 'n', 0), (s, x) -> named_struct('at', greatest(s.at, x.hi), 'n', s.n + greatest(0, x.hi - greatest(x.lo - 1, s.at))), s -> s.n)"))).first()[0] or 0

        def window_strings(row):
            text = row["text"]
            for lo, hi in merged_ranges([(w["lo"], w["hi"]) for w in row["w"]]):
                for s in range(lo, hi + 1):
                    yield text[s:s + length], row["text_id"], s

        single = shared_prefixes(asked_texts, window_strings, n_windows, length).filter(F.col("best") >= length)
        spans = spans.union(single.select("text_id", F.col("pos").alias("lo"), F.col("pos").alias("hi")))

    starts = materialize(spans.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("starts")), "starts")
    shas = firsts.select(F.col("row").alias("text_id"), "sha", "copies")
    per_text = shas.join(starts, "text_id", "left").filter("copies > 1 or starts is not null").select(
        F.lower(F.hex("sha")).alias("sha"), "copies", F.expr("if(copies > 1, null, starts)").alias("starts"))
    return digests, materialize(per_text, "spans"), texts.select(F.lower(F.hex("sha")).alias("sha"), "text")


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed integer ranges, as disjoint ranges in order (touching ones joined)."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def removed_runs(starts: list, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges ``[from, to)`` of a text from the starts of its repeated windows."""
    return [(lo, hi + 1) for lo, hi in merged_ranges([(s["lo"], s["hi"] + length - 1) for s in starts])]


def _changes(spans: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Per distinct text with repeats: ``(sha, kept, kept_text, kept_sha, removed, runs)``; removed is -1 where all of it goes."""
    def cut(batches):
        for batch in batches:
            out = []
            for row in _rows(batch):
                text = row["text"]
                runs = removed_runs(row["starts"], length)
                parts, at = [], 0
                for lo, hi in runs:
                    parts.append(text[at:lo])
                    at = hi
                kept = b"".join([*parts, text[at:]])
                out.append((row["sha"], kept, kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest(), len(text) - len(kept), len(runs)))
            kinds = (pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["sha", "kept", "kept_text", "kept_sha", "removed", "runs"])

    schema = "sha string, kept binary, kept_text string, kept_sha string, removed long, runs long"
    partly = texts.join(spans.filter("starts is not null").hint("shuffle_hash"), "sha").select("sha", "text", "starts").mapInArrow(cut, schema)
    nothing = F.lit(b"")
    whole = spans.filter("starts is null").select("sha", nothing.alias("kept"), F.lit("").alias("kept_text"), F.sha2(nothing, 256).alias("kept_sha"), F.lit(-1).cast("long").alias("removed"), F.lit(1).cast("long").alias("runs"))
    return partly.union(whole)


def dedup_texts(docs: DataFrame, text_col: str = "text", length: int = 400, gram: int = GRAM) -> DataFrame:
    """``docs`` without its text, with ``n_bytes, n_removed, n_spans, kept`` (binary; null: nothing removed) and ``kept_sha256``.

    Every byte covered by a ``length``-byte string that also starts elsewhere,
    in any text or the same, is removed. ``gram`` (a power of two, at most
    ``length``) is the width of the anchors. A null text is an empty one. Other
    columns, null ids and repeated rows come back as they are (a repeated row is
    a copy: from ``length`` bytes on, all of its text goes).
    """
    names = [c for c in docs.columns if c != text_col]
    clash = {c: f"__in_{k}" for k, c in enumerate(names)}
    digests, spans, texts = repeated_spans(docs.select(*[F.col(c).alias(clash[c]) for c in names], F.col(text_col).alias("text")), "text", length, gram)
    return digests.join(_changes(spans, texts, length), "sha", "left").select(
        *[F.col(clash[c]).alias(c) for c in names], "n_bytes",
        F.expr("case when removed is null then 0L when removed < 0 then n_bytes else removed end").alias("n_removed"),
        F.coalesce("runs", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), "kept")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut out of its text (a character of which a part goes, goes)."""
    _, spans, texts = repeated_spans(docs.select(F.col(text_col).alias("text")), "text", length, gram)
    changed = _changes(spans, texts, length).select(F.col("sha").alias("__sha"), F.col("kept_text").alias("__kept"))
    shas = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    return docs.withColumn("__sha", shas).join(changed, "__sha", "left").withColumn(text_col, F.coalesce("__kept", F.col(text_col))).select(docs.columns)
