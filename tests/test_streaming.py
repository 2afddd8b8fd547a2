from basketlens.sources import tickets as T
from basketlens.streaming.ingest import append_baskets, stream_baskets
from fixtures import EXPECTED_LINES, export_text

COLS = ["transac", "client", "prodName", "prodUds", "prodsCost", "mall"]


def test_stream_ingest_appends_all_files(spark, tmp_path):
    src = tmp_path / "export.json"
    src.write_text(export_text())
    tickets = T.tickets_from_baskets(T.flatten_baskets(T.read_shell_export(spark, str(src))))
    inbox = tmp_path / "inbox"
    tickets.where("_id <= 2").write.json(str(inbox / "a"))
    tickets.where("_id > 2").write.json(str(inbox / "b"))
    stream = spark.readStream.schema(T.S.TICKET).json(str(inbox / "*"))
    q = append_baskets(T.flatten_baskets(stream), str(tmp_path / "table"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "table")).select(*COLS).collect())
    assert got == EXPECTED_LINES
    q2 = append_baskets(stream_baskets(spark, str(inbox / "a")), str(tmp_path / "t2"), str(tmp_path / "c2"))
    q2.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 6
