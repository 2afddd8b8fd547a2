import pytest
from pyspark.sql import functions as F

from basketlens.operators import explore as X
from basketlens.operators import indexing as I
from basketlens.sources import tickets as T
from fixtures import export_text


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("exp") / "export.json"
    p.write_text(export_text())
    return T.flatten_baskets(T.read_shell_export(spark, str(p))).cache()


@pytest.fixture(scope="module")
def client_labels(lines):
    return I.frequency_index(lines, "client")


def _by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_totals(lines):
    t = X.totals(lines).first().asDict()
    assert t == {"total_clients": 3, "total_different_products": 5, "total_products_sold": 11.0,
                 "total_earnings": 31.99, "total_transactions": 4}


def test_totals_of_nulls_and_nothing(spark, lines):
    """A null is no value, its line counts; no lines: counts of nothing."""
    odd = lines.withColumn("client", F.lit(None).cast(lines.schema["client"].dataType))
    assert X.totals(odd).first().asDict() == {"total_clients": 0, "total_different_products": 5, "total_products_sold": 11.0,
                                              "total_earnings": 31.99, "total_transactions": 4}
    assert tuple(X.totals(lines.limit(0)).first()) == (0, 0, None, None, 0)
    plan = X.totals(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 2


def test_totals_by_product(lines):
    p = _by(X.totals_by_product(lines), "prodName")
    assert p["PAN (BARRA) {GRANDE}"] == {"prodName": "PAN (BARRA) {GRANDE}", "avgPrice": 1.83, "udsSold": 6.0,
                                         "earnings": 11.0, "transacWithProd": 2}
    assert p["CAJA REGALO"]["avgPrice"] is None and p["CAJA REGALO"]["udsSold"] == 0.0


def test_shares(lines):
    earns = X.prods_most_earns(lines).collect()
    assert earns[0]["prodName"] == "PAN (BARRA) {GRANDE}" and earns[0]["percentEarning"] == 34.39
    assert abs(sum(r["percentEarning"] for r in earns) - 100) < 0.05
    sold = X.prods_most_sold(lines).collect()
    assert [r["udsSold"] for r in sold] == sorted((r["udsSold"] for r in sold), reverse=True)


def test_frequency_index_ties_alphabetical(lines, client_labels):
    prods = {r["prodName"]: r["prodNameIndex"] for r in I.frequency_index(lines, "prodName").collect()}
    assert prods == {"PAN (BARRA) {GRANDE}": 0, "ZUMO PERA 0,2 L": 1, "CAJA REGALO": 2,
                     "LIBRO SOLO": 3, "MUESTRA GRATIS": 4}
    clients = {r["client"]: r["clientIndex"] for r in client_labels.collect()}
    assert clients == {77000000002: 0, 77000000001: 1, 77000000003: 2}


def test_client_reports(lines, client_labels):
    c = _by(X.totals_by_client(lines, client_labels), "clientIndex")[0]
    assert c == {"clientIndex": 0, "avgSpentPerProd": 1.75, "amountOfProds": 5.0, "variety": 4,
                 "spent": 13.5, "transacOfClient": 2}
    units = _by(X.clients_buy_more(lines, client_labels), "clientIndex")[0]
    assert units["percentAmountOfProds"] == 45.45
    money = _by(X.clients_buy_more(lines, client_labels, denominator="earnings"), "clientIndex")[0]
    assert money["percentAmountOfProds"] == 15.63
    assert _by(X.clients_spent_per_transaction(lines, client_labels), "clientIndex")[0]["avgSpentPerTransac"] == 6.75
    assert _by(X.clients_prods_per_transaction(lines, client_labels), "clientIndex")[0]["avgProdsPerTransac"] == 2.5
    assert _by(X.clients_variety(lines, client_labels), "clientIndex")[0]["percentVariety"] == 80.0
    assert _by(X.clients_most_transactions(lines, client_labels), "clientIndex")[0]["percentTransacOfClient"] == 50.0
    reports = X.all_reports(lines, client_labels)
    assert len(reports) == 12


def test_keep_top_and_restore(lines, client_labels):
    assert I.keep_top(lines, client_labels, "client", 0).count() == lines.count()
    top1 = I.keep_top(lines, client_labels, "client", 1)
    assert {r.client for r in top1.collect()} == {77000000002}
    assert I.keep_top(lines, client_labels, "client", 99).count() == lines.count()
    indexed = I.index_labels(lines, client_labels, "client").drop("client")
    back = I.restore_labels(indexed, client_labels, "client")
    assert sorted(r.client for r in back.collect()) == sorted(r.client for r in lines.collect())


def test_money_is_rounded_after_the_sum(spark):
    from basketlens.operators import explore as X
    lines = spark.range(1000).selectExpr("id AS transac", "1L AS client", "'P' AS prodName", "1.0D AS prodUds", "0.125D AS prodsCost")
    assert X.totals(lines).first()["total_earnings"] == 125.0
    assert X.totals_by_product(lines).first()["earnings"] == 125.0
    assert X.totals_by_client(lines).first()["spent"] == 125.0
