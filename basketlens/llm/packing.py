"""Mixture-controlled packing: deficit round-robin over source queues.

All documents are tokenised once, cut into shards by a hash of the id, and each
shard is packed on its own: its documents wait in one queue per source, and a
window of ``window`` tokens is filled by visiting the sources in turn. A visit
adds the source's quantum (its target share of a window) to its deficit and
serves as much of the deficit as queue and window allow; what is left is
carried to the next window. A shard begins with the deficits that the shards
before it leave: since a shard serves all of its queues, these follow from the
token totals per shard and source alone, so all shards are packed at once.

Documents are cut where a window ends. A shard's windows are full but for its
last tokens, which are laid into windows whose sizes are powers of two: no
window has any padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import give_back
from basketlens.session import materialize

#: Tokens aimed at per shard (a shard is packed in one task: 2 bytes a token).
SHARD_TOKENS = 1 << 21
#: Parts of words whose ids a tokenizing task remembers from one batch to the next.
CACHE_PARTS = 1 << 19
#: Bytes of text that are tokenised together.
TEXT_BYTES = 6 << 20
#: A word of Latin letters with punctuation around: its parts are tokens apart from each other. (An apostrophe
#: before letters can be part of a token; the dotted capital I becomes two characters in lower case.)
PARTS = r"^(?P<lead>[!-&(-/:-@\[-`{-~]*)(?P<core>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"


class WordTokenizer:
    """Ids of texts under a tokenizer of words.

    For a tokenizer that lower-cases, never joins what a blank or line feed
    separates, and cuts a word between letters and punctuation: a text's ids
    are then its words' ids in a row, and a word's those of its parts. Distinct
    parts are tokenised once; texts are put together from them by array
    operations.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        #: Whether an id ends a word. (A part of a word is one word to the tokenizer: its last id shows its end.)
        self.ends = np.zeros(1 << 16, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        #: Part -> number; the ids of part k are flat[first[k]:first[k + 1]]. Part 0 is empty.
        self.number, self.flat, self.first = {"": 0}, np.empty(0, "<u2"), np.zeros(2, np.int64)

    @classmethod
    def of_worker(cls, path: str) -> WordTokenizer:
        """The tokenizer of this Python worker, which serves many tasks: the parts that it knows stay."""
        import tokenizers
        kept = vars(tokenizers).setdefault("_of_worker", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _numbers(self, strings: pa.Array, parts: bool) -> np.ndarray:
        """Numbers of strings, which are tokenised if new; ``parts``: each is a single word to the tokenizer."""
        strings = strings.dictionary_encode()
        distinct = strings.dictionary.to_pylist()
        new = [s for s in distinct if s not in self.number]
        ids, sizes = [self.flat], []
        for at in range(0, len(new), 4096):
            chunk = new[at:at + 4096]
            if parts:
                got = np.array(self.tokenizer.encode_batch_fast([" ".join(chunk)], add_special_tokens=False)[0].ids, "<u2")
                ids.append(got)
                sizes.append(np.diff(np.flatnonzero(self.ends[got]) + 1, prepend=0))
                assert len(sizes[-1]) == len(chunk)
            else:
                got = [e.ids for e in self.tokenizer.encode_batch_fast(chunk, add_special_tokens=False)]
                ids += [np.array(g, "<u2") for g in got]
                sizes.append(np.array([len(g) for g in got], np.int64))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.flat = np.concatenate(ids)
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
        return np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[strings.indices.to_numpy()]

    def texts(self, column: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit numbers (null: none)."""
        if len(self.number) > CACHE_PARTS:
            self._forget()
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        found = pc.extract_regex(distinct, PARTS)
        plain = pc.and_(found.is_valid(), pc.invert(pc.match_substring(distinct, "<|")))  # that may open a special token
        chosen, numbers = plain.to_numpy(zero_copy_only=False), np.zeros((len(distinct), 3), np.int64)
        inner = found.filter(plain)
        for k, part in enumerate((inner.field("lead"), pc.utf8_lower(inner.field("core")), inner.field("tail"))):
            numbers[chosen, k] = self._numbers(part, True)
        numbers[~chosen, 0] = self._numbers(distinct.filter(pc.invert(plain)), False)
        flat, sizes = _gathered(self.flat, self.first[:-1][numbers].ravel(), np.diff(self.first)[numbers].ravel())
        size = sizes.reshape(-1, 3).sum(axis=1)
        which = words.indices.to_numpy()
        flat, sizes = _gathered(flat, (np.cumsum(size) - size)[which], size[which])
        ends = np.append(0, np.cumsum(sizes))[split.offsets.to_numpy() - split.offsets[0].as_py()] * 2
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``flat[start:start + size]`` one after another, and their sizes."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, n_tokens, ids)``: ids are 16-bit, with the end id (a null text has the end id only)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = WordTokenizer.of_worker(tokenizer_path), np.array([end_id], "<u2").tobytes()
        held, size = [], 0

        def out():
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = [b + end for chunk in rows.column(2).chunks for b in tokenizer.texts(chunk)]
            done = pa.table([rows.column(0), rows.column(1), pa.array([len(b) // 2 for b in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "n_tokens", "ids"])
            held.clear()
            return done.to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > TEXT_BYTES:
                yield from out()
                size = 0
        if held:
            yield from out()
        give_back()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, source string, n_tokens long, ids binary")


def window_sizes(tokens: int, window: int) -> list[int]:
    """Full windows, then the binary digits of the rest: each is full or a power of two."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def deficit_round_robin(queues: list[list[tuple[int, int]]], shares: list[float], deficits: list[float], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, window number, offset)`` that serve all queues.

    ``queues``: per source its documents ``(document, tokens)`` in order;
    ``shares``: each source's target share of the tokens; ``deficits``: tokens
    owed to each source at the start (may be negative).
    """
    left = [sum(n for _, n in q) for q in queues]
    at, done = [0] * len(queues), [0] * len(queues)
    pieces: list[tuple[int, int, int, int, int]] = []

    def serve(k: int, tokens: int, number: int, offset: int) -> int:
        """The next tokens of queue k go into a window; returns the window's new offset."""
        left[k] -= tokens
        deficits[k] -= tokens
        queue, i, start = queues[k], at[k], done[k]
        while tokens:
            doc, n = queue[i]
            piece = n - start
            if piece > tokens:
                pieces.append((doc, start, tokens, number, offset))
                offset += tokens
                start += tokens
                break
            pieces.append((doc, start, piece, number, offset))
            offset += piece
            tokens -= piece
            i, start = i + 1, 0
        at[k], done[k] = i, start
        return offset

    waiting = [k for k in range(len(queues)) if left[k]]
    for number, size in enumerate(window_sizes(sum(left), window)):
        for k in waiting:
            deficits[k] += shares[k] * size
        first, offset = number % len(waiting), 0
        for k in waiting[first:] + waiting[:first]:  # the visit of each source
            tokens = min(math.ceil(deficits[k]), left[k], size - offset)
            if tokens > 0:
                offset = serve(k, tokens, number, offset)
        while offset < size:  # queues ran dry, or sources are ahead: those owed most serve ahead of their turn
            waiting = [k for k in waiting if left[k]]
            k = max(waiting, key=lambda k: deficits[k])
            part = shares[k] / (sum(shares[j] for j in waiting) or 1.0)
            offset = serve(k, min(left[k], max(1, math.ceil((size - offset) * part))), number, offset)
        waiting = [k for k in waiting if left[k]]
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, weights: dict[str | None, float] | None = None,
         seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces ``(doc_id, document, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)``.

    ``document`` numbers the rows. ``weights``: target token proportions by source (unnamed sources share
    what their tokens call for); by default all sources drain together, in
    proportion to their tokens. Every token of every row lies in one piece. A
    null or empty text is its end id alone; a null source is a source; rows
    with equal or null ids are documents of their own; other columns are
    ignored. An empty table gives no piece.
    """
    docs = materialize(tokenised(docs, tokenizer_path, end_id, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // SHARD_TOKENS))
    dealt = docs.withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, row, {seed}), {shards}L)"))
    by_source = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    wanted = F.col("source_tokens").cast("double")
    for source, weight in (weights or {}).items():
        wanted = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(weight) * total)).otherwise(wanted)
    shares = by_source.select("source", (wanted / F.sum(wanted).over(Window.partitionBy(F.lit(0)))).alias("share"))
    cells = dealt.groupBy("shard", "source").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per SHARD_TOKENS tokens
    before = cells.groupBy("shard").agg(F.sum("tokens").alias("t")).select("shard", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"))
    same = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    served = cells.select("shard", "source", F.coalesce(F.sum("tokens").over(same), F.lit(0)).alias("served"))
    owed = materialize(served.join(before, "shard").join(shares, served["source"].eqNullSafe(shares["source"])).select(
        "shard", served["source"], "share", (F.col("share") * F.col("before") - F.col("served")).alias("owed")), "owed")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        left = left.sort_values(["place", "row"], kind="stable").reset_index(drop=True)
        right = right.sort_values("source", na_position="last").reset_index(drop=True)
        number = {None if pd.isna(s) else s: k for k, s in enumerate(right["source"])}
        queues: list[list[tuple[int, int]]] = [[] for _ in number]
        for doc, (source, n) in enumerate(zip(left["source"], left["n_tokens"])):
            queues[number[None if pd.isna(source) else source]].append((doc, int(n)))
        pieces = deficit_round_robin(queues, right["share"].tolist(), right["owed"].tolist(), window)
        doc, start, length, seq, offset = np.array(pieces, np.int64).T
        sizes = left["n_tokens"].to_numpy(np.int64)
        narrow = b"".join(left["ids"])  # of the whole shard, in the documents' order
        wide = memoryview(np.frombuffer(narrow, "<u2").astype("<u4").tobytes())
        begin = (np.cumsum(sizes) - sizes)[doc] + start
        cuts = list(zip(begin.tolist(), (begin + length).tolist()))
        return pd.DataFrame({
            "doc_id": left["doc_id"].array[doc], "document": left["row"].to_numpy()[doc], "source": left["source"].array[doc], "start": start, "length": length,
            "ids_crc32": [zlib.crc32(wide[4 * a:4 * b]) for a, b in cuts], "doc_tokens": sizes[doc],
            "sequence_id": (shard << 32) + seq, "offset": offset, "ids": [narrow[2 * a:2 * b] for a, b in cuts]})

    left = dealt.select("shard", F.xxhash64("doc_id", F.lit(seed + 1)).alias("place"), "row", "doc_id", "source", "n_tokens", "ids")
    return left.groupBy("shard").cogroup(owed.groupBy("shard")).applyInPandas(
        run, "doc_id long, document long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
