"""The four analyses as runnable units, driven by plain configuration dicts.

``run_analyses(spark, lines, configs, out_dir)`` does what the source
application's launcher does for one input:

1. check every configuration;
2. fit the client and product frequency indexes on the whole basket table;
3. per configuration: keep the top ``numClients`` / ``numProds`` (0 = all) by
   semi-joins, attach the indexes that the analysis needs to what is left, run
   the analysis named by ``appName`` and write its results.

Intermediate tables are deleted when the run ends.

Configuration keys and defaults follow the source application:
``appName`` (DataExplorer | RecommenderALS | RecommenderGraphD | RecommenderGraphX),
``outputMode`` (parallelWriteJSON), ``numClients`` (10), ``numProds`` (10);
ALS: ``usersCol`` (clientIndex), ``itemsCol`` (prodNameIndex), ``ratingsCol`` (prodUds),
plus our ``direction`` (users_for_items, the source's result: items stand in
the solver's user position; or items_for_users) and ``seed``;
graphs: ``vertexCol`` (prodName / prodNameIndex), ``edgeCol`` (clientIndex),
``vertexPropertiesCol`` (prodName).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens import schemas as S
from basketlens.operators import als as A
from basketlens.operators import explore as X
from basketlens.operators import graph as G
from basketlens.operators import indexing as I
from basketlens.operators import rank as RK
from basketlens.session import materialize, scratch_scope
from basketlens.sources.sinks import new_run_id, write_result

DIRECTIONS = ("users_for_items", "items_for_users")


def _int(config: dict, key: str, default: int) -> int:
    return int(config.get(key, default))


def data_explorer(config: dict, df: DataFrame, client_labels: DataFrame) -> dict[str, DataFrame]:
    name = config.get("appName", "DataExplorer")
    reports = X.all_reports(df, client_labels, config.get("buyMoreDenominator", "units"))
    return {f"{name}_{k}": v for k, v in reports.items()}


def recommender_als(config: dict, df: DataFrame, client_labels: DataFrame,
                    product_labels: DataFrame) -> dict[str, DataFrame]:
    name = config.get("appName", "RecommenderALS")
    users = config.get("usersCol", "clientIndex")
    items = config.get("itemsCol", "prodNameIndex")
    rating = config.get("ratingsCol", S.UNITS)
    users, items = (items, users) if config.get("direction", DIRECTIONS[0]) == DIRECTIONS[0] else (users, items)
    seed = _int(config, "seed", 42)
    parts = A.split_ratings(A.ratings(df, items, users, rating), *sorted([users, items]), seed)
    fit = A.fit_als(parts, users, items, rating, seed=seed)
    labels = {"clientIndex": (client_labels, S.CLIENT), "prodNameIndex": (product_labels, S.PRODUCT)}
    error = materialize(A.rmse(fit), "rmse")
    recs = A.recommendations(fit, S.RECOMMENDATIONS_PER_KEY, *labels.get(users, (None, None)), *labels.get(items, (None, None)))
    recs = recs.withColumn("rmse", error.select("rmse").scalar())
    return {f"{name}({users},{items})_by_{rating}": recs, f"{name}({users},{items})_rmse": error}


def recommender_graph_d(config: dict, df: DataFrame) -> dict[str, DataFrame]:
    vertex = config.get("vertexCol", S.PRODUCT)
    link = config.get("edgeCol", "clientIndex")
    tag = f"GraphD({vertex},{link})"
    ms = materialize(G.with_link_sizes(G.memberships(df, vertex, link)), "memberships")
    half = materialize(G.half_edges(ms), "half-edges")
    run = RK.lazy_walk_rank(ms, S.LAZY_WALK_DAMPING, S.LAZY_WALK_TOLERANCE, S.LAZY_WALK_MAX_ITER)
    ranked = (run.ranks.select(F.col("v").alias("orig"), "rank")
              .withColumn("dampFact", F.lit(S.LAZY_WALK_DAMPING)).withColumn("tol", F.lit(S.LAZY_WALK_TOLERANCE))
              .orderBy(F.col("rank").desc(), "orig"))
    return {
        f"{tag}_strongestLinks": G.ranked_links(half),
        f"{tag}_vertexNumNeighbours": G.neighbour_counts(half),
        f"{tag}_vertexOutLinks": G.ranked_out_links(ms),
        f"{tag}.pageRank_rankedVertex": ranked,
    }


def recommender_graph_x(config: dict, df: DataFrame, product_labels: DataFrame) -> dict[str, DataFrame]:
    vertex = config.get("vertexCol", "prodNameIndex")
    prop = config.get("vertexPropertiesCol", S.PRODUCT)
    link = config.get("edgeCol", "clientIndex")
    tag = f"GraphX({prop},{link})"
    known = product_labels.select(vertex, prop) if {vertex, prop} <= set(product_labels.columns) else None
    members = materialize(G.memberships(df, vertex, link), "memberships")
    run = RK.pagerank(G.with_link_sizes(members), members.select("v"), S.PAGERANK_DAMPING, S.PAGERANK_TOLERANCE)
    named = G.vertex_properties(df, vertex, prop) if known is None else known.select(F.col(vertex).alias("v"), prop)
    ranked = (run.ranks.join(named, "v").select(prop, "rank")
              .withColumn("dampFact", F.lit(S.PAGERANK_DAMPING)).withColumn("tol", F.lit(S.PAGERANK_TOLERANCE))
              .orderBy(F.col("rank").desc(), prop))
    return {
        f"{tag}_summary": G.graph_summary(df, vertex, link),
        f"{tag}_strongestLinks": G.strongest_links_directed(df, vertex, prop, link, props=known),
        f"{tag}_vertexOutDegree": G.vertex_out_degree(df, vertex, prop, link, props=known),
        f"{tag}.pageRank_rankedVertex": ranked,
    }


def check_config(config: dict) -> dict:
    """The configuration, if an analysis can be run from it."""
    app, mode = config.get("appName", "DataExplorer"), config.get("outputMode", "parallelWriteJSON")
    if app not in S.APPS:
        raise ValueError(f"unknown appName {app!r}; expected one of {S.APPS}")
    if mode not in S.OUTPUT_MODES:
        raise ValueError(f"unknown outputMode {mode!r}; expected one of {S.OUTPUT_MODES}")
    if config.get("direction", DIRECTIONS[0]) not in DIRECTIONS:
        raise ValueError(f"unknown direction {config['direction']!r}; expected one of {DIRECTIONS}")
    for key in ("numClients", "numProds", "seed"):
        _int(config, key, 0)
    return config


def run_analyses(spark: SparkSession, lines: DataFrame, configs: list[dict], out_dir: str,
                 run_id: str | None = None) -> dict[str, str | None]:
    """Run each configuration over ``lines``; returns ``cfg<i>/<result name> -> path``
    (results go to ``<out_dir>/<run_id>/cfg<i>/<result name>``)."""
    run_id = run_id or new_run_id()
    configs = [check_config(c) for c in configs or [{}]]
    written: dict[str, str | None] = {}
    with scratch_scope(spark):
        labels = I.frequency_indexes(lines, [S.CLIENT, S.PRODUCT])
        client_labels, product_labels = (materialize(labels[c], "labels") for c in (S.CLIENT, S.PRODUCT))
        for i, config in enumerate(configs):
            app = config.get("appName", "DataExplorer")
            n_clients, n_prods = _int(config, "numClients", 10), _int(config, "numProds", 10)
            kept = I.keep_top(I.keep_top(lines, client_labels, S.CLIENT, n_clients), product_labels, S.PRODUCT, n_prods)
            with scratch_scope(spark):
                if app == "DataExplorer":
                    results = data_explorer(config, kept, client_labels)
                else:
                    df = I.index_baskets(kept, client_labels, product_labels)
                    if app == "RecommenderALS":
                        results = recommender_als(config, df, client_labels, product_labels)
                    elif app == "RecommenderGraphD":
                        results = recommender_graph_d(config, df)
                    else:
                        results = recommender_graph_x(config, df, product_labels)
                params = {"numClients": n_clients, "numProds": n_prods}
                for name, result in results.items():
                    # one folder per configuration: runs of the same analysis never mix
                    written[f"cfg{i}/{name}"] = write_result(result, out_dir, f"{run_id}/cfg{i}", name,
                                                             config.get("outputMode", "parallelWriteJSON"), params)
    return written
