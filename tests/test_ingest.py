import datetime as dt

from pyspark.sql import functions as F

from basketlens.sources import tickets as T
from fixtures import EXPECTED_LINES, export_text

COLS = ["transac", "client", "prodName", "prodUds", "prodsCost", "mall"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode("utf-8"))
    return str(p)


def test_shell_export_flattens_to_expected_lines(spark, tmp_path):
    path = _write(tmp_path, "export.json", export_text())
    tickets = T.read_shell_export(spark, path)
    assert sorted(r["_id"] for r in tickets.select("_id").collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert _rows(T.flatten_baskets(tickets)) == EXPECTED_LINES


def test_shell_export_crlf_and_final_newline(spark, tmp_path):
    for i, (crlf, nl) in enumerate([(True, False), (False, True), (True, True)]):
        path = _write(tmp_path, f"export{i}.json", export_text(crlf=crlf, final_newline=nl))
        assert _rows(T.flatten_baskets(T.read_shell_export(spark, path))) == EXPECTED_LINES


def test_shell_export_values(spark, tmp_path):
    path = _write(tmp_path, "export.json", export_text())
    tickets = T.read_shell_export(spark, path)
    first = tickets.where("_id = 1").first()
    assert first["date"] == dt.date(2019, 5, 3)
    assert first["client"] == 77000000001
    assert first["items"][0]["desc"] == "ZUMO PERA 0,2 L"
    neg = tickets.where("_id = 3").first()
    assert neg["client"] is None and neg["items"][0]["n_unit"] == -1.0


def test_json_lines_drop_malformed(spark, tmp_path):
    text = "\n".join([
        '{"_id": 1, "client": 5, "date": "2016-01-14", "items": [{"desc": "A", "n_unit": 1, "net_am": 2.0}], "mall": 1}',
        '{"_id": 2, "client": 5, "date": "2016-01-14", "items": [{"desc": "B", "n_unit": 1, "net_am": 2.0}]',
        '{"_id": 3, "client": null, "date": "2016-01-14", "items": [{"desc": "C", "n_unit": 1, "net_am": 2.0}]}',
        '{"_id": 4, "client": 6, "date": "2016-01-15T10:00:00.000+0000", '
        '"items": [{"desc": "BOLSA CARREFOUR", "n_unit": 1, "net_am": 0.1}, {"desc": "D", "n_unit": 2, "net_am": 3.0}]}',
    ])
    lines = T.flatten_baskets(T.read_tickets(spark, _write(tmp_path, "t.jsonl", text)))
    got = sorted((r.transac, r.prodName, r.date) for r in lines.collect())
    assert got == [(1, "A", dt.date(2016, 1, 14)), (4, "D", dt.date(2016, 1, 15))]


def test_ticket_roundtrip_through_both_formats(spark, tmp_path):
    lines = T.flatten_baskets(T.read_shell_export(spark, _write(tmp_path, "e.json", export_text())))
    tickets = T.tickets_from_baskets(lines)
    tickets.write.json(str(tmp_path / "jl"))
    assert _rows(T.flatten_baskets(T.read_tickets(spark, str(tmp_path / "jl")))) == EXPECTED_LINES
    T.shell_export_text(tickets).write.text(str(tmp_path / "sh"))
    back = T.flatten_baskets(T.read_shell_export(spark, str(tmp_path / "sh")))
    assert _rows(back) == EXPECTED_LINES
    assert back.where(F.col("transac") == 1).first()["date"] == dt.date(2019, 5, 3)


def test_large_tickets_split_into_bounded_documents(spark, tmp_path):
    lines = T.flatten_baskets(T.read_shell_export(spark, _write(tmp_path, "e.json", export_text())))
    docs = T.tickets_from_baskets(lines, max_items=1).collect()
    assert len(docs) > 4 and len({r["_id"] for r in docs}) == 4
    assert max(len(r["items"]) for r in docs) < 3
    docs = spark.createDataFrame(docs, T.tickets_from_baskets(lines).schema)
    assert _rows(T.flatten_baskets(docs)) == EXPECTED_LINES


def _documents(n=5, name="PAN"):
    return [f'{{ "_id" : NumberInt({i}), "mall" : NumberInt(1), "date" : ISODate("2020-02-0{i}T10:00:00.000+0000"), '
            f'"items" : [ {{ "net_am" : 1.5, "n_unit" : NumberInt(2), "desc" : "{name}" }} ], "client" : NumberLong(7) }}'
            for i in range(1, n + 1)]


def _layouts(docs):
    pretty = [d.replace(", ", ",\n  ").replace("{ ", "{\n  ").replace(" }", "\n}") for d in docs]
    return {
        "one per line": "\n".join(docs),
        "back to back": "".join(docs),
        "pretty": "\n".join(pretty),
        "pretty crlf": "\r\n".join(p.replace("\n", "\r\n") for p in pretty) + "\r\n",
        "indented": "\n".join("    " + p.replace("\n", "\n    ") for p in pretty),
        "array": "[\n" + ",\n".join(docs) + "\n]\n",
        "blank lines": "\n\n" + "\n\n\n".join(docs) + "\n\n",
    }


def test_shell_export_layouts(spark, tmp_path):
    for name, text in _layouts(_documents()).items():
        got = T.read_shell_export(spark, _write(tmp_path, name.replace(" ", "_") + ".json", text)).collect()
        assert sorted((r["_id"], r["client"], r["items"][0]["n_unit"], r["items"][0]["desc"]) for r in got) == [
            (i, 7, 2.0, "PAN") for i in range(1, 6)], name


def test_shell_export_many_splits(spark, tmp_path):
    path = _write(tmp_path, "big.json", "\n".join(_documents(9) * 40))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        tickets = T.read_shell_export(spark, path)
        assert tickets.rdd.getNumPartitions() > 4
        assert sorted(r["_id"] for r in tickets.collect()) == sorted(list(range(1, 10)) * 40)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_product_text_is_kept(spark, tmp_path):
    for text in ("PACK, NumberInt(3)", ': ISODate(\\"x\\")', "a } , { b", "tab\\\\", '\\"_id\\" : 4', "NumberLong(1)"):
        got = T.read_shell_export(spark, _write(tmp_path, "p.json", "\n".join(_documents(2, text)))).collect()
        assert [r["items"][0]["desc"] for r in got] == [text.replace('\\"', '"').replace("\\\\", "\\")] * 2


def test_input_that_cannot_be_cut_fails(spark, tmp_path):
    for text in ("garbage\n" + _documents(1)[0], "\n".join(_documents(2, "_id"))):
        try:
            T.read_shell_export(spark, _write(tmp_path, "bad.json", text)).collect()
        except Exception as e:
            assert "not a document" in str(e)
        else:
            raise AssertionError("read without complaint")


def test_both_scans_drop_the_same_documents(spark, tmp_path):
    good, bad = _documents(2)
    bad = bad.replace("NumberInt(2), \"desc\"", '"abc", "desc"').replace('"items" : [ ', '"items" : [ { "net_am" : 1, "n_unit" : 1, "desc" : "X" }, ')
    plain = [d.replace("NumberInt(", "").replace("NumberLong(", "").replace("ISODate(", "").replace(")", "") for d in (good, bad)]
    shell = T.flatten_baskets(T.read_shell_export(spark, _write(tmp_path, "s.json", good + bad)))
    lines = T.flatten_baskets(T.read_tickets(spark, _write(tmp_path, "l.jsonl", "\n".join(plain))))
    assert _rows(shell) == _rows(lines) == [(1, 7, "PAN", 2.0, 1.5, 1)]


def test_writers_keep_fractions_and_line_separators(spark, tmp_path):
    rows = [(1, 5, dt.date(2020, 1, 1), p, u, c, 1) for p, u, c in (
        ("a b", 2.5, 1.0), ("c\u0085d", -0.25, 0.125), ("e\nf\"g\\", 3.0, 2.0), ("e\nf\"g\\", 3.0, 2.0), ("none", None, None))]
    rows.append((None, 6, dt.date(2020, 1, 2), "no ticket number", 1.0, 1.0, None))
    lines = spark.createDataFrame(rows, "transac long, client long, date date, prodName string, prodUds double, prodsCost double, mall int")
    want = sorted(map(str, lines.select(*COLS).collect()))
    for max_items in (10_000, 2):
        tickets = T.tickets_from_baskets(lines, max_items)
        T.shell_export_text(tickets).write.text(str(tmp_path / f"sh{max_items}"))
        tickets.write.json(str(tmp_path / f"js{max_items}"))
        for back in (T.read_shell_export(spark, str(tmp_path / f"sh{max_items}")), T.read_tickets(spark, str(tmp_path / f"js{max_items}"))):
            assert sorted(map(str, T.flatten_baskets(back).select(*COLS).collect())) == want


def test_a_document_is_parsed_once(spark, tmp_path):
    """No filter below the parse repeats it, and no pattern is tried from every blank of an indented line."""
    import contextlib
    import io
    import time

    (tmp_path / "a.json").write_text('{"_id" : NumberInt(1), "mall" : null, "date" : null, "items" : [{"net_am" : 1.5, "n_unit" : NumberInt(2), "desc" : "N I NumberInt(3) [x] "}], "client" : NumberLong("7")}')
    lines = T.flatten_baskets(T.read_shell_export(spark, str(tmp_path)))
    assert [(r.transac, r.client, r.prodName, r.prodUds, r.prodsCost) for r in lines.collect()] == [(1, 7, "N I NumberInt(3) [x] ", 2.0, 1.5)]
    with contextlib.redirect_stdout(io.StringIO()) as out:
        lines.explain()
    assert out.getvalue().count("from_json(") == 1
    wide = tmp_path / "wide"
    wide.mkdir()
    (wide / "a.json").write_text('{"_id" : 1,' + " " * 200_000 + '"client" : 7, "items" : []}')
    t0 = time.perf_counter()
    assert T.read_shell_export(spark, str(wide)).count() == 1
    assert time.perf_counter() - t0 < 10
