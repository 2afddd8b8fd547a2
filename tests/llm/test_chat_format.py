"""Chat formatting: exact round trips, spans, and templates that rewrite history."""

import hashlib
import random

import duckdb

from basketlens.llm import chat_format as cf

BITS = ["a", "\\", "<", "|", ">", "s", "/", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "\n", "<|end|>", "<|turn|>", " ", "x", "y", "é", ""]


def test_round_trips_and_spans():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices(BITS, k=rng.randrange(0, n)))
    for _ in range(3000):
        turns = [(word(4), word(9)) for _ in range(rng.randrange(0, 5))]
        out, spans, rewrites = cf.locate(cf.turn_template, turns)
        assert cf.parse(out) == turns and rewrites == []
        assert [cf.unescape(out[a:b]) for _, _, a, b in spans] == [t for _, t in turns]
        assert "".join(out[a:b] for a, b, _, _ in spans) == out
        for s in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert all(s not in out[a:b] for _, _, a, b in spans)


def test_rewriting_template_is_found():
    def last_only(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t[:1]}" for k, (r, t) in enumerate(turns))
    _, spans, rewrites = cf.locate(last_only, [("u", "abc"), ("a", "def")])
    assert rewrites == [1] and spans[0] == (-1, -1, -1, -1)
    def upper(turns):
        return "".join(t.upper() for _, t in turns)
    assert cf.locate(upper, [("u", "abc")])[1][0][2] == -1  # the text is not there word for word


def test_conversations(spark, sf_small):
    from basketlens.llm.queries import ORACLES, op5_chat_formatting
    got = {r.conv_id: r for r in op5_chat_formatting(spark, sf_small).collect()}
    rows = spark.read.parquet(f"{sf_small}/conversations.parquet").orderBy("conv_id", "turn").collect()
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_small}/conversations.parquet')")
    want = con.execute(ORACLES["op5_chat_formatting"]).fetchdf()
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {tuple(r) for r in want[columns].itertuples(index=False)} == {tuple(r[c] for c in columns) for r in got.values()}


def test_nulls_ties_long_and_empty(spark):
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "hi\\", "x"), (None, 0, "user", "no id", "x"), (2, None, "user", "first", "x"), (2, 0, "ro\nle", "b", "x"), (2, 0, "ro\nle", "b", "x"), (3, 0, "assistant", "[INST]" * 50_000, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans string")
    out = {r.conv_id: r for r in cf.format_conversations(frame).collect()}
    assert [cf.parse(out[k].formatted) for k in (1, 2, None)] == [[("", "hi\\"), ("assistant", "")], [("user", "first"), ("ro\nle", "b"), ("ro\nle", "b")], [("user", "no id")]]
    d = {r.conv_id: r for r in cf.digests(cf.format_conversations(frame)).collect()}
    assert d[3].loss_chars == 300_000 and d[1].loss_chars == 0 and d[2].n_turns == 3
    assert cf.format_conversations(frame.limit(0)).count() == 0


def test_many_turns(spark):
    frame = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(400)], "conv_id long, turn long, role string, text string")
    row = cf.format_conversations(frame).first()
    assert len(row.spans) == 400 and [cf.unescape(row.formatted[m["start"]:m["end"]]) for m in row.loss_mask] == [f"turn {k} " * 20 for k in range(1, 400, 2)]
