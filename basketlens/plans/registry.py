"""Named queries over a test-data folder: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query runs on the whole tables of the folder. Parameters mirror the
source application's defaults; top-N selections use the (15, 15) setting of
its exploration example.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens import schemas as S
from basketlens.functions.columns import round_half_even
from basketlens.operators import als as A
from basketlens.operators import explore as X
from basketlens.operators import graph as G
from basketlens.operators import indexing as I
from basketlens.operators import rank as RK
from basketlens.session import materialize, scratch_path
from basketlens.sources import tickets as T
from basketlens.sources.sinks import new_run_id, write_result
from basketlens.sources.star import baskets_from_star, product_names

TOP = 15
#: Sizes of the shipped examples select few lines of evenly spread tables; this one selects hundreds.
WIDE = 300
ALS_SEED = 42
NAME = "name"
#: Factors are floats: a residual below this is rounding.
SOLVED = 1e-5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _lines(spark, sf_dir, with_mall=False):
    return baskets_from_star(spark, sf_dir, with_mall=with_mall)


def _client_labels(lines):
    return I.frequency_index(lines, S.CLIENT)


def _product_labels(lines):
    return I.frequency_index(lines, S.PRODUCT)


def _keyed(spark, sf_dir):
    """Lines with the product as a number, and the names of the numbers."""
    return baskets_from_star(spark, sf_dir, with_mall=False, with_key=True), product_names(spark, sf_dir)


def _both_labels(lines):
    """Client and product label tables from one pass over the lines."""
    labels = I.frequency_indexes(lines, [S.CLIENT, S.PRODUCT])
    return labels[S.CLIENT], labels[S.PRODUCT]


# ---- ingest and indexing -------------------------------------------------

@query
def basket_lines(spark, sf_dir):
    """The flat basket table; ``date`` rendered as ISO text for a type-neutral compare."""
    lines = _lines(spark, sf_dir, with_mall=True)
    return lines.withColumn(S.DATE, F.date_format(S.DATE, "yyyy-MM-dd"))


@query
def frequency_index_product(spark, sf_dir):
    return _product_labels(_lines(spark, sf_dir))


@query
def frequency_index_client(spark, sf_dir):
    return _client_labels(_lines(spark, sf_dir))


@query
def indexed_baskets(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return I.index_baskets(lines, *_both_labels(lines)).select(
        S.TRANSAC, S.CLIENT, S.PRODUCT, S.UNITS, S.COST, "clientIndex", "prodNameIndex")


@query
def top_n_baskets(spark, sf_dir):
    kept, clients, products = _top(spark, sf_dir, TOP)
    return I.index_baskets(kept, clients, products).select(
        S.TRANSAC, S.CLIENT, S.PRODUCT, S.UNITS, S.COST, "clientIndex", "prodNameIndex")


# ---- exploration reports -------------------------------------------------

@query
def totals(spark, sf_dir):
    return X.totals(_lines(spark, sf_dir))


@query
def totals_by_product(spark, sf_dir):
    return X.totals_by_product(_lines(spark, sf_dir))


@query
def prods_most_sold(spark, sf_dir):
    return X.prods_most_sold(_lines(spark, sf_dir))


@query
def prods_most_earns(spark, sf_dir):
    return X.prods_most_earns(_lines(spark, sf_dir))


@query
def prods_most_popular(spark, sf_dir):
    return X.prods_most_popular(_lines(spark, sf_dir))


@query
def totals_by_client(spark, sf_dir):
    return X.totals_by_client(_lines(spark, sf_dir), fit_index=True)


@query
def clients_spent_more(spark, sf_dir):
    return X.clients_spent_more(_lines(spark, sf_dir), fit_index=True)


@query
def clients_buy_more(spark, sf_dir):
    return X.clients_buy_more(_lines(spark, sf_dir), denominator="units", fit_index=True)


@query
def clients_buy_more_reference(spark, sf_dir):
    return X.clients_buy_more(_lines(spark, sf_dir), denominator="earnings", fit_index=True)


@query
def clients_most_transactions(spark, sf_dir):
    return X.clients_most_transactions(_lines(spark, sf_dir), fit_index=True)


@query
def clients_spent_per_transaction(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return X.clients_spent_per_transaction(lines, by_client=X.totals_by_client(lines, fit_index=True))


@query
def clients_prods_per_transaction(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return X.clients_prods_per_transaction(lines, by_client=X.totals_by_client(lines, fit_index=True))


@query
def clients_variety(spark, sf_dir):
    return X.clients_variety(_lines(spark, sf_dir), fit_index=True)


@query
def top_n_totals_by_client(spark, sf_dir):
    """R6 on the top-(15,15) selection, as the exploration example configures it."""
    kept, clients, _ = _top(spark, sf_dir, TOP)
    return X.totals_by_client(kept, clients)


# ---- co-purchase graph ---------------------------------------------------
# DataFrame-graph form: vertex = product name, link = ticket (or client).
# Multigraph form: vertex = product index, property = product name, link = ticket.

@query
def cooccurrence_edges_transac(spark, sf_dir):
    lines, names = _keyed(spark, sf_dir)
    return G.cooccurrence_edges(lines, S.PRODUCT_KEY, S.TRANSAC, names=names)


@query
def cooccurrence_edges_client(spark, sf_dir):
    lines, names = _keyed(spark, sf_dir)
    return G.cooccurrence_edges(lines, S.PRODUCT_KEY, S.CLIENT, names=names)


@query
def strongest_links(spark, sf_dir):
    lines, names = _keyed(spark, sf_dir)
    return G.strongest_links(lines, S.PRODUCT_KEY, S.TRANSAC, names=names)


@query
def vertex_neighbours(spark, sf_dir):
    lines, names = _keyed(spark, sf_dir)
    return G.vertex_neighbours(lines, S.PRODUCT_KEY, S.TRANSAC, names=names)


@query
def vertex_out_links(spark, sf_dir):
    lines, names = _keyed(spark, sf_dir)
    return G.vertex_out_links(lines, S.PRODUCT_KEY, S.TRANSAC, names=names)


@query
def graph_summary(spark, sf_dir):
    return G.graph_summary(_keyed(spark, sf_dir)[0], S.PRODUCT_KEY, S.TRANSAC)


@query
def strongest_links_directed(spark, sf_dir):
    lines, names = _keyed(spark, sf_dir)
    return G.strongest_links_directed(lines, S.PRODUCT_KEY, S.PRODUCT, S.TRANSAC, props=names)


@query
def strongest_links_by_name(spark, sf_dir):
    """G7 where many vertices share a property: products by number, merged by their bare names."""
    lines = _keyed(spark, sf_dir)[0].withColumn(NAME, F.regexp_replace(S.PRODUCT, "#[0-9]+$", ""))
    return G.strongest_links_directed(lines, S.PRODUCT_KEY, NAME, S.TRANSAC)


@query
def vertex_out_degree(spark, sf_dir):
    lines, names = _keyed(spark, sf_dir)
    return G.vertex_out_degree(lines, S.PRODUCT_KEY, S.PRODUCT, S.TRANSAC, props=names)


def _lazy_walk(spark, sf_dir, link):
    lines, names = _keyed(spark, sf_dir)
    ms = G.sized_memberships(lines, S.PRODUCT_KEY, link)
    run = RK.lazy_walk_rank(ms, S.LAZY_WALK_DAMPING, S.LAZY_WALK_TOLERANCE, S.LAZY_WALK_MAX_ITER)
    return (run.ranks.join(names.withColumnRenamed(S.PRODUCT_KEY, "v"), "v")
            .select(F.col(S.PRODUCT).alias("orig"), round_half_even("rank", 6).alias("rank"))
            .orderBy(F.col("rank").desc(), "orig"))


@query
def lazy_walk_rank(spark, sf_dir):
    return _lazy_walk(spark, sf_dir, S.TRANSAC)


@query
def lazy_walk_rank_client(spark, sf_dir):
    """G6 with the source's default link (the client): dense co-purchase, ~40 pairs per membership."""
    return _lazy_walk(spark, sf_dir, S.CLIENT)


@query
def pagerank(spark, sf_dir):
    lines, names = _keyed(spark, sf_dir)
    ms = materialize(G.memberships(lines, S.PRODUCT_KEY, S.TRANSAC), "memberships")
    run = RK.pagerank(G.with_link_sizes(ms), ms.select("v"), S.PAGERANK_DAMPING, S.PAGERANK_TOLERANCE)
    return (run.ranks.join(names.withColumnRenamed(S.PRODUCT_KEY, "v"), "v")
            .select(S.PRODUCT, round_half_even("rank", 6).alias("rank"))
            .orderBy(F.col("rank").desc(), S.PRODUCT))


# ---- ratings, label decoding, ALS ---------------------------------------

def _ratings_by_label(lines):
    """(prodName, client, prodUds) summed per pair - aggregated before any index lookup."""
    return A.ratings(lines, S.PRODUCT, S.CLIENT, S.UNITS)


@query
def ratings(spark, sf_dir):
    """A5 in index space: (prodNameIndex, clientIndex, prodUds)."""
    lines = _lines(spark, sf_dir)
    pairs = _ratings_by_label(lines)
    return (I.index_baskets(pairs, *_both_labels(lines))
            .select("prodNameIndex", "clientIndex", S.UNITS))


@query
def restore_labels(spark, sf_dir):
    """index-space ratings decoded back to their labels (original types kept)."""
    lines = _lines(spark, sf_dir)
    clients, products = _both_labels(lines)
    indexed = I.index_baskets(_ratings_by_label(lines), clients, products).select(
        "prodNameIndex", "clientIndex", S.UNITS)
    decoded = I.restore_labels(I.restore_labels(indexed, products, S.PRODUCT), clients, S.CLIENT)
    return decoded.select(S.PRODUCT, S.CLIENT, S.UNITS)


def als_parts(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    clients, products = _both_labels(lines)
    triples = I.index_baskets(_ratings_by_label(lines), clients, products).select("prodNameIndex", "clientIndex", S.UNITS)
    return A.split_ratings(triples, "clientIndex", "prodNameIndex", ALS_SEED), clients, products


@query
def als_split(spark, sf_dir):
    """M1: every rating with its part."""
    return als_parts(spark, sf_dir)[0]


def _users_for_items(spark, sf_dir):
    parts, clients, products = als_parts(spark, sf_dir)
    fit = A.fit_als(parts, "prodNameIndex", "clientIndex", S.UNITS, seed=ALS_SEED)
    return fit, A.recommendations(fit, S.RECOMMENDATIONS_PER_KEY, products, S.PRODUCT, clients, S.CLIENT)


@query
def als_users_for_items(spark, sf_dir):
    """M1-M7 as the source binds them (product in the user position): the 10 likeliest clients of every product."""
    return _users_for_items(spark, sf_dir)[1]


@query
def als_list_shape(spark, sf_dir):
    """M6, M7: of every product's list its length, distinct clients, order, and whether all clients are known."""
    fit, lists = _users_for_items(spark, sf_dir)
    known = fit.rows("train").agg(F.count_distinct("clientIndex").cast("long").alias("n")).scalar()
    e = F.col("recommendations")
    scores = F.transform(e, lambda x: x[S.UNITS])
    return lists.select(
        S.PRODUCT, F.size(e).alias("n"), F.size(F.array_distinct(F.transform(e, lambda x: x[S.CLIENT]))).alias("n_distinct"),
        (scores == F.reverse(F.array_sort(scores))).alias("descending"), known.alias("known_clients"))


@query
def als_items_for_users(spark, sf_dir):
    """M6-M7 the other way: the 10 best products for every client."""
    parts, clients, products = als_parts(spark, sf_dir)
    fit = A.fit_als(parts, "clientIndex", "prodNameIndex", S.UNITS, seed=ALS_SEED)
    return A.recommendations(fit, S.RECOMMENDATIONS_PER_KEY, clients, S.CLIENT, products, S.PRODUCT)


@query
def als_rmse(spark, sf_dir):
    """M4-M5: held-out RMSE with train/test sizes (one row)."""
    parts, _, _ = als_parts(spark, sf_dir)
    return A.rmse(A.fit_als(parts, "prodNameIndex", "clientIndex", S.UNITS, seed=ALS_SEED))


@query
def als_normal_equations(spark, sf_dir):
    """M2, M3: every product of the training part, its rows there, and whether its factors solve their equations."""
    fit = A.fit_als(als_parts(spark, sf_dir)[0], "prodNameIndex", "clientIndex", S.UNITS, seed=ALS_SEED)
    return A.normal_equations(fit).select("prodNameIndex", "train_rows", F.coalesce(F.col("residual") < SOLVED, F.lit(False)).alias("solved"))


@query
def als_scored_rows(spark, sf_dir):
    """M4, M5: sizes of both parts, and the held-out rows that have a prediction (pairs of known keys)."""
    return als_rmse(spark, sf_dir).select("train_rows", "test_rows", "scored_rows")


# ---- configured runs: the sizes of the shipped examples --------------------

def _top(spark, sf_dir, n):
    """Lines of the ``n`` most frequent clients and products, and the label tables of those."""
    labels = I.top_indexes(_lines(spark, sf_dir), {S.CLIENT: n, S.PRODUCT: n})
    clients, products = labels[S.CLIENT], labels[S.PRODUCT]
    return baskets_from_star(spark, sf_dir, with_mall=False, clients=clients, products=products), clients, products


@query
def configured_products_10(spark, sf_dir, n=S.EXPLORATION_TOP):
    """Exploration, 10 x 10: R4 over the selection."""
    return X.prods_most_earns(_top(spark, sf_dir, n)[0])


@query
def configured_ratings_30(spark, sf_dir, n=S.ALS_TOP):
    """ALS, 30 x 30: the triples that the model is fitted on."""
    kept, clients, products = _top(spark, sf_dir, n)
    return I.index_baskets(_ratings_by_label(kept), clients, products).select("prodNameIndex", "clientIndex", S.UNITS)


@query
def configured_graph_d_10(spark, sf_dir, n=S.GRAPH_D_TOP):
    """DataFrame graph, 10 x 10, product names by client (the default link; few tickets are shared): G5 over the selection."""
    return G.vertex_out_links(_top(spark, sf_dir, n)[0], S.PRODUCT, S.CLIENT)


@query
def configured_graph_x_5(spark, sf_dir, n=S.GRAPH_X_TOP):
    """Multigraph, 5 x 5, product indexes with their names: G7 over the selection, by client."""
    kept, _, products = _top(spark, sf_dir, n)
    indexed = I.index_labels(kept, products, S.PRODUCT)
    return G.strongest_links_directed(indexed, "prodNameIndex", S.PRODUCT, S.CLIENT, props=products)


@query
def configured_products_wide(spark, sf_dir):
    return configured_products_10(spark, sf_dir, WIDE)


@query
def configured_ratings_wide(spark, sf_dir):
    return configured_ratings_30(spark, sf_dir, WIDE)


@query
def configured_graph_d_wide(spark, sf_dir):
    return configured_graph_d_10(spark, sf_dir, WIDE)


@query
def configured_graph_x_wide(spark, sf_dir):
    return configured_graph_x_5(spark, sf_dir, WIDE)


# ---- results written and read back ------------------------------------------

def _read_back(spark, frame, name, mode, params):
    path = write_result(frame, scratch_path(spark, "results"), new_run_id(), name, mode, params)
    return spark.read.schema(_result_schema(params, frame)).json(path)


def _result_schema(params, frame):
    """The schema of a written result: its parameters, then its columns."""
    return ", ".join([*(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in params.items()),
                      *(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)])


@query
def written_totals(spark, sf_dir):
    """K1, K5: R1 written in parallel with its run's parameters, read back."""
    return _read_back(spark, X.totals(_lines(spark, sf_dir)), "totals", "parallelWriteJSON", {"numClients": 0, "numProds": 0})


@query
def written_prods_most_sold(spark, sf_dir):
    """K2, K5: R3 with the total that its shares refer to, replacing an earlier result, read back."""
    lines = _lines(spark, sf_dir)
    tot = X.totals(lines)
    ranked = X.prods_most_sold(lines, tot=tot).withColumn("total_products_sold", tot.select("total_products_sold").scalar())
    return _read_back(spark, ranked, "prodsMostSold", "oneJSON", {"numClients": 0, "numProds": 0})


# ---- ticket documents derived from the tables, read back ----------------

def _tickets(spark, sf_dir):
    return T.tickets_from_baskets(_lines(spark, sf_dir, with_mall=True))


def _flat(tickets):
    return T.flatten_baskets(tickets).withColumn(S.DATE, F.date_format(S.DATE, "yyyy-MM-dd"))


@query
def tickets_json_lines(spark, sf_dir):
    """S1 + P1-P4: tickets written as JSON lines, scanned with the ticket schema and flattened."""
    path = scratch_path(spark, "tickets-json")
    _tickets(spark, sf_dir).write.json(path)
    return _flat(T.read_tickets(spark, path))


def _shell(spark, sf_dir, layout, line_sep="\n"):
    """S2 + P1-P4: tickets written in the shell export dialect in one layout, parsed in parallel and flattened.

    The text, mostly names of fields and blanks, is written compressed: a file, read
    by one task, holds what a task of the writer's shuffle held.
    """
    path = scratch_path(spark, "tickets-shell")
    text = T.shell_export_text(_tickets(spark, sf_dir))
    text.select(layout(F.col("value")).alias("value")).write.option("lineSep", line_sep).option("compression", "gzip").text(path)
    return _flat(T.read_shell_export(spark, path))


@query
def tickets_shell_export(spark, sf_dir):
    """S2, pretty-printed: the closing brace of a document in column 0."""
    return _shell(spark, sf_dir, lambda v: v)


@query
def tickets_shell_one_per_line(spark, sf_dir):
    """S2, one document per line."""
    return _shell(spark, sf_dir, lambda v: F.regexp_replace(v, "\n *", " "))


@query
def tickets_shell_back_to_back(spark, sf_dir):
    """S2, no separator between documents."""
    return _shell(spark, sf_dir, lambda v: F.regexp_replace(v, "\n *", " "), line_sep="\u0020")


@query
def tickets_shell_indented(spark, sf_dir):
    """S2, every line indented, CRLF line ends."""
    return _shell(spark, sf_dir, lambda v: F.concat(F.lit("    "), F.replace(v, F.lit("\n"), F.lit("\r\n    ")), F.lit("\r")))
