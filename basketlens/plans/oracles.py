"""Independent SQL formulations (DuckDB dialect) of the registered queries.

They read the star tables directly and are written the plain way (explicit
pairs for the graph, unrolled steps for the ranks), so they check the Spark
plans rather than repeat them. Rounding follows the same rule on both sides:
cast to DECIMAL(38,6), round half-even, cast to DOUBLE.
"""

from __future__ import annotations

from basketlens import schemas as S


def R(expr: str, digits: int) -> str:
    return f"CAST(round_even(CAST(({expr}) AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def MONEY(expr: str) -> str:
    return f"sum(CAST({expr} AS DECIMAL(38,6)))"


def DIV(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


def PCT(value: str, total: str) -> str:
    return R(DIV(f"CAST({value} AS DOUBLE) * 100.0", total), 2)


_EXCLUDED = ", ".join("'" + p.replace("'", "''") + "'" for p in S.EXCLUDED_PRODUCTS)

LINES = f"""lines AS MATERIALIZED (
  SELECT l.l_orderkey AS transac, o.o_custkey AS client, CAST(o.o_orderdate AS DATE) AS date,
         p.p_name || '#' || CAST(p.p_partkey AS VARCHAR) AS prodName,
         CAST(l.l_quantity AS DOUBLE) AS prodUds, CAST(l.l_extendedprice AS DOUBLE) AS prodsCost
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  WHERE o.o_custkey IS NOT NULL
    AND p.p_name || '#' || CAST(p.p_partkey AS VARCHAR) NOT IN ({_EXCLUDED})
)"""

CLABELS = """clabels AS MATERIALIZED (
  SELECT client, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(client AS VARCHAR)) - 1 AS INTEGER)
           AS clientIndex, count(*) AS frequency
  FROM lines GROUP BY client
)"""

PLABELS = """plabels AS MATERIALIZED (
  SELECT prodName, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(prodName AS VARCHAR)) - 1 AS INTEGER)
           AS prodNameIndex, count(*) AS frequency
  FROM lines GROUP BY prodName
)"""

TOTALS = f"""tot AS MATERIALIZED (
  SELECT count(DISTINCT client) AS total_clients,
         count(DISTINCT prodName) AS total_different_products,
         {R('sum(prodUds)', 0)} AS total_products_sold,
         {R(MONEY('prodsCost'), 2)} AS total_earnings,
         count(DISTINCT transac) AS total_transactions
  FROM lines
)"""

BYPROD = f"""byprod AS MATERIALIZED (
  SELECT prodName,
         {R('avg(' + DIV('prodsCost', 'prodUds') + ')', 2)} AS avgPrice,
         {R('sum(prodUds)', 0)} AS udsSold,
         {R(MONEY('prodsCost'), 2)} AS earnings,
         count(DISTINCT transac) AS transacWithProd
  FROM lines GROUP BY prodName
)"""

BYCLIENT = f"""byclient AS MATERIALIZED (
  SELECT c.clientIndex, a.avgSpentPerProd, a.amountOfProds, a.variety, a.spent, a.transacOfClient
  FROM (
    SELECT client,
           {R('avg(' + DIV('prodsCost', 'prodUds') + ')', 2)} AS avgSpentPerProd,
           {R('sum(prodUds)', 2)} AS amountOfProds,
           count(DISTINCT prodName) AS variety,
           {R(MONEY('prodsCost'), 2)} AS spent,
           count(DISTINCT transac) AS transacOfClient
    FROM lines GROUP BY client) a
  JOIN clabels c ON a.client = c.client
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _share(src: str, key: str, value: str, pct: str, total: str) -> str:
    return (with_(*src) + f"SELECT {key}, {value}, {PCT(value, f'(SELECT {total} FROM tot)')} AS {pct} "
            f"FROM {'byprod' if key == 'prodName' else 'byclient'}")


TOPN = """kept AS MATERIALIZED (
  SELECT l.* FROM lines l
  WHERE l.client IN (SELECT client FROM clabels WHERE clientIndex < 15)
    AND l.prodName IN (SELECT prodName FROM plabels WHERE prodNameIndex < 15)
)"""

ORACLES: dict[str, str] = {
    "basket_lines": """
SELECT l.l_orderkey AS transac, o.o_custkey AS client, strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') AS date,
       p.p_name || '#' || CAST(p.p_partkey AS VARCHAR) AS prodName,
       CAST(l.l_quantity AS DOUBLE) AS prodUds, CAST(l.l_extendedprice AS DOUBLE) AS prodsCost,
       CAST(n.n_regionkey AS INTEGER) AS mall
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_custkey IS NOT NULL
  AND p.p_name || '#' || CAST(p.p_partkey AS VARCHAR) NOT IN (""" + _EXCLUDED + ")",
    "frequency_index_product": with_(LINES, PLABELS) + "SELECT prodName, prodNameIndex, frequency FROM plabels",
    "frequency_index_client": with_(LINES, CLABELS) + "SELECT client, clientIndex, frequency FROM clabels",
    "indexed_baskets": with_(LINES, CLABELS, PLABELS) + """
SELECT l.transac, l.client, l.prodName, l.prodUds, l.prodsCost, c.clientIndex, p.prodNameIndex
FROM lines l JOIN clabels c ON l.client = c.client JOIN plabels p ON l.prodName = p.prodName""",
    "top_n_baskets": with_(LINES, CLABELS, PLABELS, TOPN) + """
SELECT l.transac, l.client, l.prodName, l.prodUds, l.prodsCost, c.clientIndex, p.prodNameIndex
FROM kept l JOIN clabels c ON l.client = c.client JOIN plabels p ON l.prodName = p.prodName""",
    "totals": with_(LINES, TOTALS) + "SELECT * FROM tot",
    "totals_by_product": with_(LINES, BYPROD) + "SELECT * FROM byprod",
    "prods_most_sold": _share((LINES, TOTALS, BYPROD), "prodName", "udsSold", "percentUdsSold",
                              "total_products_sold"),
    "prods_most_earns": _share((LINES, TOTALS, BYPROD), "prodName", "earnings", "percentEarning",
                               "total_earnings"),
    "prods_most_popular": _share((LINES, TOTALS, BYPROD), "prodName", "transacWithProd",
                                 "percentTransacWithProd", "total_transactions"),
    "totals_by_client": with_(LINES, CLABELS, BYCLIENT) + "SELECT * FROM byclient",
    "clients_spent_more": _share((LINES, CLABELS, TOTALS, BYCLIENT), "clientIndex", "spent", "percentSpent",
                                 "total_earnings"),
    "clients_buy_more": _share((LINES, CLABELS, TOTALS, BYCLIENT), "clientIndex", "amountOfProds",
                               "percentAmountOfProds", "total_products_sold"),
    "clients_buy_more_reference": _share((LINES, CLABELS, TOTALS, BYCLIENT), "clientIndex", "amountOfProds",
                                         "percentAmountOfProds", "total_earnings"),
    "clients_most_transactions": _share((LINES, CLABELS, TOTALS, BYCLIENT), "clientIndex", "transacOfClient",
                                        "percentTransacOfClient", "total_transactions"),
    "clients_spent_per_transaction": with_(LINES, CLABELS, BYCLIENT)
    + f"SELECT clientIndex, {R(DIV('spent', 'transacOfClient'), 2)} AS avgSpentPerTransac FROM byclient",
    "clients_prods_per_transaction": with_(LINES, CLABELS, BYCLIENT)
    + f"SELECT clientIndex, {R(DIV('amountOfProds', 'transacOfClient'), 2)} AS avgProdsPerTransac FROM byclient",
    "clients_variety": _share((LINES, CLABELS, TOTALS, BYCLIENT), "clientIndex", "variety", "percentVariety",
                              "total_different_products"),
    "top_n_totals_by_client": with_(LINES, CLABELS, PLABELS, TOPN) + f"""
SELECT c.clientIndex, a.avgSpentPerProd, a.amountOfProds, a.variety, a.spent, a.transacOfClient
FROM (
  SELECT client,
         {R('avg(' + DIV('prodsCost', 'prodUds') + ')', 2)} AS avgSpentPerProd,
         {R('sum(prodUds)', 2)} AS amountOfProds,
         count(DISTINCT prodName) AS variety,
         {R(MONEY('prodsCost'), 2)} AS spent,
         count(DISTINCT transac) AS transacOfClient
  FROM kept GROUP BY client) a
JOIN clabels c ON a.client = c.client""",
}


# ---- co-purchase graph: explicit pairs ----------------------------------

def _graph_ctes(link: str) -> tuple:
    mem = f"""mem AS MATERIALIZED (SELECT DISTINCT prodName AS v, {link} AS link FROM lines)"""
    edges = """edges AS MATERIALIZED (
  SELECT a.v AS orig, b.v AS dest, count(*) AS linkWeight
  FROM mem a JOIN mem b ON a.link = b.link AND a.v <> b.v
  GROUP BY a.v, b.v
)"""
    return (LINES, mem, edges)


def _f(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def lazy_walk_sql(damping: float = S.LAZY_WALK_DAMPING, tolerance: float = S.LAZY_WALK_TOLERANCE,
                  max_iter: int = S.LAZY_WALK_MAX_ITER, link: str = "transac") -> str:
    ctes = list(_graph_ctes(link))
    ctes.append("w AS MATERIALIZED (SELECT orig AS v, CAST(sum(linkWeight) AS DOUBLE) AS w FROM edges GROUP BY orig)")
    ctes.append("r0 AS MATERIALIZED (SELECT v, CAST(1.0 AS DOUBLE) AS rank FROM w)")
    ctes.append("g0 AS MATERIALIZED (SELECT TRUE AS go)")
    d = _f(damping)
    for i in range(1, max_iter + 1):
        ctes.append(f"""c{i} AS MATERIALIZED (
  SELECT e.dest AS v, sum(((e.linkWeight * (1.0 - {d})) / w.w) * r.rank) AS add
  FROM edges e JOIN r{i-1} r ON e.orig = r.v JOIN w ON w.v = e.orig GROUP BY e.dest)""")
        ctes.append(f"""n{i} AS MATERIALIZED (
  SELECT r.v, r.rank * {d} + c.add AS rank, r.rank AS old FROM r{i-1} r JOIN c{i} c ON r.v = c.v)""")
        ctes.append(f"""r{i} AS MATERIALIZED (
  SELECT n.v, CASE WHEN g.go THEN n.rank ELSE n.old END AS rank FROM n{i} n CROSS JOIN g{i-1} g)""")
        ctes.append(f"""g{i} AS MATERIALIZED (
  SELECT g.go AND (SELECT max(abs(old - rank)) FROM n{i}) > {_f(tolerance)} AS go FROM g{i-1} g)""")
    return with_(*ctes) + f"SELECT v AS orig, {R('rank', 6)} AS rank FROM r{max_iter}"


def pagerank_sql(damping: float = S.PAGERANK_DAMPING, tolerance: float = S.PAGERANK_TOLERANCE,
                 steps: int = 40) -> str:
    reset = 1.0 - damping
    keep = 1.0 - reset
    start = 0.0 + keep * (reset / (1.0 - reset))
    ctes = list(_graph_ctes("transac"))
    ctes.append("w AS MATERIALIZED (SELECT orig AS v, CAST(sum(linkWeight) AS DOUBLE) AS w FROM edges GROUP BY orig)")
    ctes.append(f"""p0 AS MATERIALIZED (
  SELECT DISTINCT prodName AS v, {_f(start)} AS pr, {_f(start - 0.0)} AS delta, TRUE AS active FROM lines)""")
    for i in range(1, steps + 1):
        ctes.append(f"""m{i} AS MATERIALIZED (
  SELECT e.dest AS v, sum(p.delta * (1.0 / w.w) * e.linkWeight) AS msg
  FROM edges e JOIN p{i-1} p ON e.orig = p.v JOIN w ON w.v = e.orig
  WHERE p.active AND p.delta > {_f(tolerance)} GROUP BY e.dest)""")
        ctes.append(f"""p{i} AS MATERIALIZED (
  SELECT p.v,
         CASE WHEN m.v IS NULL THEN p.pr ELSE p.pr + m.msg * {_f(keep)} END AS pr,
         CASE WHEN m.v IS NULL THEN p.delta ELSE (p.pr + m.msg * {_f(keep)}) - p.pr END AS delta,
         m.v IS NOT NULL AS active
  FROM p{i-1} p LEFT JOIN m{i} m ON p.v = m.v)""")
    return with_(*ctes) + (f"SELECT v AS prodName, {R('pr * (CAST(t.n AS DOUBLE) / t.s)', 6)} AS rank "
                           f"FROM p{steps} CROSS JOIN (SELECT count(*) AS n, sum(pr) AS s FROM p{steps}) t")


ORACLES.update({
    "cooccurrence_edges_transac": with_(*_graph_ctes("transac")) + "SELECT orig, dest, linkWeight FROM edges",
    "cooccurrence_edges_client": with_(*_graph_ctes("client")) + "SELECT orig, dest, linkWeight FROM edges",
    "strongest_links": with_(*_graph_ctes("transac")) + "SELECT orig, dest, linkWeight FROM edges WHERE orig < dest",
    "vertex_neighbours": with_(*_graph_ctes("transac")) + "SELECT orig, count(*) AS neighbours FROM edges GROUP BY orig",
    "vertex_out_links": with_(*_graph_ctes("transac"))
    + "SELECT orig, CAST(sum(linkWeight) AS BIGINT) AS linksOfVertex FROM edges GROUP BY orig",
    "graph_summary": with_(*_graph_ctes("transac"))
    + "SELECT (SELECT count(DISTINCT prodName) FROM lines) AS num_vertices, "
      "CAST((SELECT coalesce(sum(linkWeight), 0) FROM edges) AS BIGINT) AS num_edges",
    "strongest_links_directed": with_(*_graph_ctes("transac"))
    + "SELECT orig AS prodName_orig, dest AS prodName_dest, CAST(linkWeight AS BIGINT) AS num_of_transac FROM edges",
    "vertex_out_degree": with_(*_graph_ctes("transac"))
    + "SELECT orig AS prodName, CAST(sum(linkWeight) AS BIGINT) AS outDegree FROM edges GROUP BY orig",
    "lazy_walk_rank": lazy_walk_sql(),
    "lazy_walk_rank_client": lazy_walk_sql(link="client"),
    "pagerank": pagerank_sql(),
})


ORACLES.update({
    "ratings": with_(LINES, CLABELS, PLABELS) + """
SELECT p.prodNameIndex, c.clientIndex, r.prodUds
FROM (SELECT prodName, client, sum(prodUds) AS prodUds FROM lines GROUP BY prodName, client) r
JOIN clabels c ON r.client = c.client JOIN plabels p ON r.prodName = p.prodName""",
    "restore_labels": with_(LINES) + "SELECT prodName, client, sum(prodUds) AS prodUds FROM lines GROUP BY prodName, client",
    "tickets_json_lines": ORACLES["basket_lines"],
    "tickets_shell_export": ORACLES["basket_lines"],
})


# ---- split, lists, configured runs, results read back ----------------------

_PARTS = """rated AS MATERIALIZED (
  SELECT p.prodName, p.prodNameIndex, c.clientIndex, r.prodUds,
         CASE WHEN substr(md5(CAST(c.clientIndex AS VARCHAR) || ':' || CAST(p.prodNameIndex AS VARCHAR) || ':42'), 1, 8)
                   < 'cccccccc' THEN 'train' ELSE 'test' END AS part
  FROM (SELECT prodName, client, sum(prodUds) AS prodUds FROM lines GROUP BY prodName, client) r
  JOIN clabels c ON r.client = c.client JOIN plabels p ON r.prodName = p.prodName
)"""


def _selected(n: int) -> str:
    return TOPN.replace("< 15", f"< {n}").replace("kept AS", "chosen AS") + """,
lines2 AS MATERIALIZED (SELECT * FROM chosen)"""


def _on_selection(cte: str) -> str:
    return cte.replace("FROM lines", "FROM lines2")


_KEPT_MEM = "mem AS MATERIALIZED (SELECT DISTINCT prodName AS v, client AS link FROM lines2)"

ORACLES.update({
    "als_split": with_(LINES, CLABELS, PLABELS, _PARTS) + "SELECT prodNameIndex, clientIndex, prodUds, part FROM rated",
    "als_list_shape": with_(LINES, CLABELS, PLABELS, _PARTS) + """
SELECT r.prodName, CAST(least(10, k.n) AS INTEGER) AS n, CAST(least(10, k.n) AS INTEGER) AS n_distinct,
       TRUE AS descending, k.n AS known_clients
FROM (SELECT DISTINCT prodName FROM rated WHERE part = 'train') r
CROSS JOIN (SELECT count(DISTINCT clientIndex) AS n FROM rated WHERE part = 'train') k""",
    "als_normal_equations": with_(LINES, CLABELS, PLABELS, _PARTS) + """
SELECT prodNameIndex, count(*) AS train_rows, TRUE AS solved FROM rated WHERE part = 'train' GROUP BY prodNameIndex""",
    "als_scored_rows": with_(LINES, CLABELS, PLABELS, _PARTS) + """
SELECT count(*) FILTER (WHERE part = 'train') AS train_rows, count(*) FILTER (WHERE part = 'test') AS test_rows,
       count(*) FILTER (WHERE part = 'test' AND prodNameIndex IN (SELECT prodNameIndex FROM rated WHERE part = 'train')
                          AND clientIndex IN (SELECT clientIndex FROM rated WHERE part = 'train')) AS scored_rows
FROM rated""",
    "written_totals": with_(LINES, TOTALS)
    + "SELECT CAST(0 AS INTEGER) AS numClients, CAST(0 AS INTEGER) AS numProds, * FROM tot",
    "written_prods_most_sold": with_(LINES, TOTALS, BYPROD)
    + f"SELECT CAST(0 AS INTEGER) AS numClients, CAST(0 AS INTEGER) AS numProds, prodName, udsSold, "
      f"{PCT('udsSold', '(SELECT total_products_sold FROM tot)')} AS percentUdsSold, "
      "(SELECT total_products_sold FROM tot) AS total_products_sold FROM byprod",
    **{f"tickets_shell_{layout}": ORACLES["basket_lines"] for layout in ("one_per_line", "back_to_back", "indented")},
})


def _configured(name: str, exploration: int, als: int, graph_d: int, graph_x: int) -> dict[str, str]:
    """The configured runs at given sizes; ``name`` makes a query's name of its stem and size."""
    graph = lambda n: with_(LINES, CLABELS, PLABELS, _selected(n), _KEPT_MEM, _graph_ctes("client")[2])
    return {
        name.format("products", exploration): with_(LINES, CLABELS, PLABELS, _selected(exploration), _on_selection(TOTALS), _on_selection(BYPROD))
        + f"SELECT prodName, earnings, {PCT('earnings', '(SELECT total_earnings FROM tot)')} AS percentEarning FROM byprod",
        name.format("ratings", als): with_(LINES, CLABELS, PLABELS, _selected(als)) + """
SELECT p.prodNameIndex, c.clientIndex, r.prodUds
FROM (SELECT prodName, client, sum(prodUds) AS prodUds FROM lines2 GROUP BY prodName, client) r
JOIN clabels c ON r.client = c.client JOIN plabels p ON r.prodName = p.prodName""",
        name.format("graph_d", graph_d): graph(graph_d) + "SELECT orig, CAST(sum(linkWeight) AS BIGINT) AS linksOfVertex FROM edges GROUP BY orig",
        name.format("graph_x", graph_x): graph(graph_x)
        + "SELECT orig AS prodName_orig, dest AS prodName_dest, CAST(linkWeight AS BIGINT) AS num_of_client FROM edges",
    }


ORACLES.update(_configured("configured_{}_{}", S.EXPLORATION_TOP, S.ALS_TOP, S.GRAPH_D_TOP, S.GRAPH_X_TOP))
ORACLES.update(_configured("configured_{}_wide", 300, 300, 300, 300))
ORACLES["strongest_links_by_name"] = with_(*_graph_ctes("transac")) + """
SELECT regexp_replace(orig, '#[0-9]+$', '') AS name_orig, regexp_replace(dest, '#[0-9]+$', '') AS name_dest, CAST(sum(linkWeight) AS BIGINT) AS num_of_transac
FROM edges GROUP BY 1, 2"""
