"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. It is never
looked into: the conversation's prefixes of 0, 1, 2, ... turns are rendered and
consecutive outputs compared. What a longer prefix adds is the last turn's
span; an output that does not start with the one before shows a template that
rewrites history. Inside its span a turn's text is located by rendering the
same prefix once more with another text: what both outputs share at the front
and at the end is template. The text found is unescaped and held against the
turn's.

Rendering every prefix costs the square of a conversation's length in
characters copied; conversations are streamed one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

# ---------------------------------------------------------------- the default template

#: Control strings of this and other chat formats: their second character is set apart by a backslash in texts.
CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Set apart every control string, and every backslash."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def turn_template(turns: list[Turn]) -> str:
    """``<|turn|>role``, line feed, text, ``<|end|>`` and a line feed for each turn."""
    return "".join([f"<|turn|>{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}<|end|>\n" for role, text in turns])


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of :func:`turn_template`."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


# ---------------------------------------------------------------- black-box rendering

def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b)) + 1  # the first lo characters agree, the first hi do not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def locate(template: Template, turns: list[Turn], unescape: Callable[[str], str] = unescape) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """Render ``turns``: ``(output, spans, rewrites)``.

    spans: per turn (from, to, text from, text to) in the output; text from is
    -1 where the turn's text is not in its span word for word (after
    unescaping). rewrites: the turns whose addition changed what stood before;
    the spans of all turns up to there are then not to be trusted and are -1.
    """
    before = template([])
    spans: list[tuple[int, int, int, int]] = []
    rewrites: list[int] = []
    for k, (role, text) in enumerate(turns):
        now = template(turns[:k + 1])
        if now.startswith(before):
            start = len(before)
        else:
            start = _shared(before, now)
            rewrites.append(k)
            spans = [(-1, -1, -1, -1)] * k
        probe = next(c for c in "xyz" if c not in (text[:1], text[-1:]))
        other = template([*turns[:k], (role, probe)])
        lo = _shared(now, other)
        tail = _shared(now[lo:][::-1], other[lo:][::-1])
        hi = len(now) - tail
        if lo < start or unescape(now[lo:hi]) != text:
            lo = hi = -1
        spans.append((start, len(now), lo, hi))
        before = now
    return before, spans, rewrites


def format_conversations(conversations: DataFrame, template: Template = turn_template, learn: tuple[str, ...] = ("assistant",),
                         unescape: Callable[[str], str] = unescape) -> DataFrame:
    """Format every conversation of ``(conv_id, turn, role, text)`` rows.

    Per conversation: ``conv_id, n_turns, formatted, spans`` (an array of
    ``start, end, text_start, text_end`` in code points of ``formatted``, and
    ``role``), ``loss_mask`` (the text ranges of the turns whose role is in
    ``learn``), ``rewrites`` (turns that changed earlier output). Rows are
    ordered by turn, null first; rows with equal turns by role and text. A null
    role or text is empty; rows without conv_id are one conversation; other
    columns are ignored.
    """
    ranges = "array<struct<start:int,end:int>>"
    schema = f"conv_id long, n_turns long, formatted string, spans array<struct<start:int,end:int,text_start:int,text_end:int,role:string>>, loss_mask {ranges}, rewrites array<int>"

    def rendered(conv: int | None, turns: list[Turn]) -> dict:
        output, spans, rewrites = locate(template, turns, unescape)
        return {"conv_id": conv, "n_turns": len(turns), "formatted": output,
                "spans": [dict(zip(("start", "end", "text_start", "text_end"), s), role=r) for s, (r, _) in zip(spans, turns)],
                "loss_mask": [{"start": s[2], "end": s[3]} for s, (r, _) in zip(spans, turns) if r in learn and s[2] >= 0],
                "rewrites": rewrites}

    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                       ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("role", pa.string())]))),
                       ("loss_mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("rewrites", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, out, size, begun = None, [], [], 0, False

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if begun and c != conv:
                    out.append(rendered(conv, turns))
                    size += len(out[-1]["formatted"])
                    turns = []
                    if size > 4_000_000 or len(out) >= 1000:
                        yield batch_of(out)
                        out, size = [], 0
                conv, begun = c, True
                turns.append((role or "", text or ""))
        if begun:
            out.append(rendered(conv, turns))
        if out:
            yield batch_of(out)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, read back from ``formatted`` and ``loss_mask`` alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(k).to_pylist() for k in range(3))):
                turns = parse(text)
                whole = "".join([f"{role}\n{t}\n" for role, t in turns])
                loss = "".join([unescape(text[m["start"]:m["end"]]) for m in mask])
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(run, schema)
