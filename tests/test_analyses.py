import os

import pytest

from basketlens import schemas as S
from basketlens.plans.analyses import run_analyses
from basketlens.session import clear_scratch, ensure_checkpoint_dir
from basketlens.sources import tickets as T
from fixtures import export_text


def test_run_all_four_analyses(spark, tmp_path):
    src = tmp_path / "export.json"
    src.write_text(export_text())
    lines = T.flatten_baskets(T.read_shell_export(spark, str(src)))
    app, mode, clients, prods, *_, vertex, edge, props = S.CONFIG_KEYS
    everything = {clients: "0", prods: "0"}
    explore, als, graph_d, graph_x = S.APPS
    configs = [
        {app: explore, **everything},
        {app: explore, clients: "2", prods: "2", mode: "standarOutput"},
        {app: als, **everything},
        {app: graph_d, **everything, vertex: "prodName", edge: "transac"},
        {app: graph_x, **everything, vertex: "prodNameIndex", props: "prodName", edge: "transac", mode: "oneJSON"},
        {app: graph_d, clients: "2", prods: "3", vertex: "prodName", edge: "transac"},
    ]
    written = run_analyses(spark, lines, configs, str(tmp_path / "out"), run_id="r1")
    assert "cfg0/DataExplorer_totals" in written and "cfg0/DataExplorer_clientswithMostProductVariety" in written
    assert written["cfg1/DataExplorer_totals"] is None
    assert "cfg2/RecommenderALS(prodNameIndex,clientIndex)_by_prodUds" in written
    assert "cfg3/GraphD(prodName,transac).pageRank_rankedVertex" in written
    totals = spark.read.json(written["cfg0/DataExplorer_totals"]).first()
    assert totals["total_transactions"] == 4 and totals["numClients"] == 0
    ranked = spark.read.json(written["cfg4/GraphX(prodName,transac).pageRank_rankedVertex"])
    assert ranked.count() == 5
    assert all(os.path.exists(p) for p in written.values() if p)
    assert spark.read.json(written["cfg0/DataExplorer_prodsMostSold"]).first()["total_products_sold"] == totals["total_products_sold"]
    error = spark.read.json(written["cfg2/RecommenderALS(prodNameIndex,clientIndex)_rmse"]).first()
    assert spark.read.json(written["cfg2/RecommenderALS(prodNameIndex,clientIndex)_by_prodUds"]).first()["rmse"] == error["rmse"]
    # nothing that the run wrote under the checkpoint folder is left
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    left = [f for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")]
    clear_scratch(spark)
    assert len([f for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")]) == 0 <= len(left)


def test_unknown_app(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, "A", 1.0, 1.0)], "transac long, client long, prodName string, "
                                  "prodUds double, prodsCost double")
    with pytest.raises(ValueError):
        run_analyses(spark, lines, [{"appName": "Nope"}], str(tmp_path))
    for bad in ({"outputMode": "csv"}, {"direction": "x"}, {"numClients": "many"}):
        with pytest.raises(ValueError):
            run_analyses(spark, lines, [{"appName": "DataExplorer"}, bad], str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
