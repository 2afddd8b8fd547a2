"""Exploration reports over a basket table (totals, product and client rankings).

Plan shape, chosen for large inputs:

* every report is one aggregation of the line table (partial aggregation
  map-side, one shuffle on the group key; distinct counts become a
  (key, value) pre-aggregation, so a hot key is spread over many tasks, and
  several of them share one pass as (column, value) rows: no Expand);
* client reports group by the raw ``client``, count its lines in the same
  pass, and index the result - one row per client, never all lines;
* shares of a total read the total as a scalar subquery (one value computed
  once, no driver round trip and no join), in a report on its own over the
  figures per key, so that it reads the line table once (``value_and_total``);
* every figure is rounded like the source (half-even) and ratios are taken
  from already rounded figures, in the same order as the source;
* ``all_reports`` aggregates the line table three times in all (totals, per
  product, per client), writes those small frames once and derives the
  twelve results from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens import schemas as S
from basketlens.functions.columns import ROUNDING_DECIMAL, money_sum, percent_of, ratio, round_half_even
from basketlens.functions.row_index import with_row_index
from basketlens.operators.indexing import frequency_order
from basketlens.session import materialize

CLIENT_INDEX = S.index_column(S.CLIENT)


def totals(lines: DataFrame) -> DataFrame:
    """One row of global figures, from one pass over the lines.

    The columns whose distinct values are counted become rows (column number,
    value); grouped by both, each value is one row of a task in the shuffle,
    however many lines hold it. The sums ride on the rows of the first column.
    A null is no value of its column, but its line's units and cost count.
    """
    counted = [S.CLIENT, S.PRODUCT, S.TRANSAC]
    units, cost = F.col(S.UNITS), F.col(S.COST).cast(ROUNDING_DECIMAL)
    rows = lines.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("column"), F.col(c).cast("string").alias("value"),
                 (units if k == 0 else F.lit(None)).alias("units"), (cost if k == 0 else F.lit(None)).alias("cost"))
        for k, c in enumerate(counted)])))
    values = rows.groupBy("column", "value").agg(F.sum("units").alias("units"), F.sum("cost").alias("cost"))
    different = [F.count(F.when(F.col("column") == k, F.col("value"))) for k in range(len(counted))]
    return values.agg(
        different[0].alias("total_clients"),
        different[1].alias("total_different_products"),
        round_half_even(F.sum("units"), 0).alias("total_products_sold"),
        round_half_even(F.sum("cost"), 2).alias("total_earnings"),
        different[2].alias("total_transactions"),
    )


def _total(tot: DataFrame, name: str):
    return tot.select(name).scalar()


def totals_by_product(lines: DataFrame) -> DataFrame:
    """R2: per product - unweighted mean unit price over lines, units, earnings, tickets."""
    return lines.groupBy(S.PRODUCT).agg(
        round_half_even(F.avg(ratio(S.COST, S.UNITS)), 2).alias("avgPrice"),
        round_half_even(F.sum(S.UNITS), 0).alias("udsSold"),
        round_half_even(money_sum(S.COST), 2).alias("earnings"),
        F.count_distinct(S.TRANSAC).alias("transacWithProd"),
    )


def _share_report(by_key: DataFrame, key: str, value: str, pct: str, tot: DataFrame, total_col: str) -> DataFrame:
    return (by_key.select(key, value, percent_of(value, _total(tot, total_col)).alias(pct))
            .orderBy(F.col(value).desc(), F.col(key).asc()))


#: The figure of each share report: what it adds up (an aggregate, digits) or counts distinct (a column).
_SUMS = {"udsSold": (S.UNITS, 0), "amountOfProds": (S.UNITS, 2), "earnings": (S.COST, 2), "spent": (S.COST, 2),
         "total_products_sold": (S.UNITS, 0), "total_earnings": (S.COST, 2)}
_DISTINCT = {"transacWithProd": S.TRANSAC, "transacOfClient": S.TRANSAC, "variety": S.PRODUCT}


def _sum_of(column: str):
    return money_sum(column) if column == S.COST else F.sum(column)


def value_and_total(lines: DataFrame, key: str, value: str, total: str, fit_index: bool = False):
    """``(key, value)`` per key and the total that its shares refer to, from one pass over ``lines``.

    Sums: the total is the sum of the keys' unrounded sums. Distinct counts do not
    add up over keys: the grand total is a grouping set beside the keys. Either
    way the lines are read once, and what is read twice has one row per key.
    ``fit_index``: keyed by the client's frequency index.
    """
    lined = F.count(F.lit(1)).alias("_lines")
    if value in _DISTINCT:
        both = materialize(lines.groupingSets([[key], []], key).agg(
            F.count_distinct(_DISTINCT[value]).alias(value), lined, F.grouping(key).alias("_all")), "value-and-total")
        by_key = both.where("_all = 0")
        grand = both.where("_all = 1").select(value).scalar()
    else:
        (column, digits), (whole, whole_digits) = _SUMS[value], _SUMS[total]
        both = materialize(lines.groupBy(key).agg(_sum_of(column).alias("_v"), _sum_of(whole).alias("_t"), lined), "value-and-total")
        by_key = both.withColumn(value, round_half_even("_v", digits))
        grand = both.agg(round_half_even(F.sum("_t"), whole_digits).alias("t")).scalar()
    if fit_index:
        index = S.index_column(key)
        return with_row_index(by_key.where(F.col(key).isNotNull()), frequency_order(key, "_lines"), index).select(F.col(index).cast("int").alias(index), value), grand
    return by_key.select(key, value), grand


def _one_pass_report(lines: DataFrame, key: str, value: str, pct: str, total: str, fit_index: bool = False) -> DataFrame:
    by_key, grand = value_and_total(lines, key, value, total, fit_index)
    out = by_key.columns[0]
    return by_key.select(out, value, percent_of(value, grand).alias(pct)).orderBy(F.col(value).desc(), F.col(out).asc())


def prods_most_sold(lines: DataFrame, by_product: DataFrame | None = None, tot: DataFrame | None = None) -> DataFrame:
    """Products by units sold, with share of all units."""
    if by_product is None and tot is None:
        return _one_pass_report(lines, S.PRODUCT, "udsSold", "percentUdsSold", "total_products_sold")
    by_product = by_product if by_product is not None else totals_by_product(lines)
    tot = tot if tot is not None else totals(lines)
    return _share_report(by_product, S.PRODUCT, "udsSold", "percentUdsSold", tot, "total_products_sold")


def prods_most_earns(lines: DataFrame, by_product: DataFrame | None = None, tot: DataFrame | None = None) -> DataFrame:
    """Products by earnings, with share of all earnings."""
    if by_product is None and tot is None:
        return _one_pass_report(lines, S.PRODUCT, "earnings", "percentEarning", "total_earnings")
    by_product = by_product if by_product is not None else totals_by_product(lines)
    tot = tot if tot is not None else totals(lines)
    return _share_report(by_product, S.PRODUCT, "earnings", "percentEarning", tot, "total_earnings")


def prods_most_popular(lines: DataFrame, by_product: DataFrame | None = None, tot: DataFrame | None = None) -> DataFrame:
    """Products by number of tickets, with share of all tickets."""
    if by_product is None and tot is None:
        return _one_pass_report(lines, S.PRODUCT, "transacWithProd", "percentTransacWithProd", "total_transactions")
    by_product = by_product if by_product is not None else totals_by_product(lines)
    tot = tot if tot is not None else totals(lines)
    return _share_report(by_product, S.PRODUCT, "transacWithProd", "percentTransacWithProd", tot,
                         "total_transactions")


def totals_by_client(lines: DataFrame, client_labels: DataFrame | None = None, fit_index: bool = False) -> DataFrame:
    """Per client - mean unit price, units, distinct products, spending, tickets.

    Keyed by ``clientIndex`` (the source's key) when the client label table is
    given, or with ``fit_index``: the index over ``lines`` themselves, from line
    counts that the same aggregation makes, so the lines are read once. Else
    keyed by ``client``.
    """
    by_client = lines.groupBy(S.CLIENT).agg(
        F.count(F.lit(1)).alias("_lines"),
        round_half_even(F.avg(ratio(S.COST, S.UNITS)), 2).alias("avgSpentPerProd"),
        round_half_even(F.sum(S.UNITS), 2).alias("amountOfProds"),
        F.count_distinct(S.PRODUCT).alias("variety"),
        round_half_even(money_sum(S.COST), 2).alias("spent"),
        F.count_distinct(S.TRANSAC).alias("transacOfClient"),
    )
    if fit_index:
        return with_row_index(by_client.where(F.col(S.CLIENT).isNotNull()), frequency_order(S.CLIENT, "_lines"), CLIENT_INDEX).select(
            F.col(CLIENT_INDEX).cast("int").alias(CLIENT_INDEX), *_CLIENT_FIGURES)
    if client_labels is None:
        return by_client.select(S.CLIENT, *_CLIENT_FIGURES)
    return (by_client.join(client_labels.select(S.CLIENT, CLIENT_INDEX), S.CLIENT)
            .select(CLIENT_INDEX, *_CLIENT_FIGURES))


_CLIENT_FIGURES = ("avgSpentPerProd", "amountOfProds", "variety", "spent", "transacOfClient")


def _client_key(by_client: DataFrame) -> str:
    return CLIENT_INDEX if CLIENT_INDEX in by_client.columns else S.CLIENT


def _client_inputs(lines, client_labels, by_client, tot):
    by_client = by_client if by_client is not None else totals_by_client(lines, client_labels)
    tot = tot if tot is not None else totals(lines)
    return by_client, tot


def clients_spent_more(lines: DataFrame, client_labels: DataFrame | None = None,
                       by_client: DataFrame | None = None, tot: DataFrame | None = None, fit_index: bool = False) -> DataFrame:
    """Clients by spending, with share of all earnings."""
    if fit_index:
        return _one_pass_report(lines, S.CLIENT, "spent", "percentSpent", "total_earnings", fit_index=True)
    by_client, tot = _client_inputs(lines, client_labels, by_client, tot)
    return _share_report(by_client, _client_key(by_client), "spent", "percentSpent", tot, "total_earnings")


def clients_buy_more(lines: DataFrame, client_labels: DataFrame | None = None,
                     by_client: DataFrame | None = None, tot: DataFrame | None = None,
                     denominator: str = "units", fit_index: bool = False) -> DataFrame:
    """Clients by units bought, with a share.

    ``denominator="units"`` divides by all units sold; ``"earnings"`` divides
    by total earnings, which is what the source application writes.
    """
    if fit_index:
        return _one_pass_report(lines, S.CLIENT, "amountOfProds", "percentAmountOfProds", {"units": "total_products_sold", "earnings": "total_earnings"}[denominator], fit_index=True)
    by_client, tot = _client_inputs(lines, client_labels, by_client, tot)
    total_col = {"units": "total_products_sold", "earnings": "total_earnings"}[denominator]
    return _share_report(by_client, _client_key(by_client), "amountOfProds", "percentAmountOfProds", tot, total_col)


def clients_most_transactions(lines: DataFrame, client_labels: DataFrame | None = None,
                              by_client: DataFrame | None = None, tot: DataFrame | None = None, fit_index: bool = False) -> DataFrame:
    """Clients by number of tickets, with share of all tickets."""
    if fit_index:
        return _one_pass_report(lines, S.CLIENT, "transacOfClient", "percentTransacOfClient", "total_transactions", fit_index=True)
    by_client, tot = _client_inputs(lines, client_labels, by_client, tot)
    return _share_report(by_client, _client_key(by_client), "transacOfClient", "percentTransacOfClient", tot,
                         "total_transactions")


def clients_spent_per_transaction(lines: DataFrame, client_labels: DataFrame | None = None,
                                  by_client: DataFrame | None = None) -> DataFrame:
    """Mean spending per ticket (from the rounded spending)."""
    by_client = by_client if by_client is not None else totals_by_client(lines, client_labels)
    key = _client_key(by_client)
    return (by_client.select(key, round_half_even(ratio("spent", "transacOfClient"), 2).alias("avgSpentPerTransac"))
            .orderBy(F.col("avgSpentPerTransac").desc(), F.col(key).asc()))


def clients_prods_per_transaction(lines: DataFrame, client_labels: DataFrame | None = None,
                                  by_client: DataFrame | None = None) -> DataFrame:
    """Mean units per ticket (from the rounded units)."""
    by_client = by_client if by_client is not None else totals_by_client(lines, client_labels)
    key = _client_key(by_client)
    return (by_client.select(key, round_half_even(ratio("amountOfProds", "transacOfClient"), 2)
                             .alias("avgProdsPerTransac"))
            .orderBy(F.col("avgProdsPerTransac").desc(), F.col(key).asc()))


def clients_variety(lines: DataFrame, client_labels: DataFrame | None = None,
                    by_client: DataFrame | None = None, tot: DataFrame | None = None, fit_index: bool = False) -> DataFrame:
    """Clients by distinct products bought, with share of all distinct products."""
    if fit_index:
        return _one_pass_report(lines, S.CLIENT, "variety", "percentVariety", "total_different_products", fit_index=True)
    by_client, tot = _client_inputs(lines, client_labels, by_client, tot)
    return _share_report(by_client, _client_key(by_client), "variety", "percentVariety", tot,
                         "total_different_products")


# The result names of the source application.
REPORTS = (
    "totals", "totalsByProd", "prodsMostSold", "prodsMostEarns", "prodsMostPopular", "totalsByClient",
    "clientsWhoSpentMore", "clientsWhoBuyMoreProds", "clientswithMostTransactions",
    "clientsSpentMorePerTransaction", "clientsMoreProdsPerTransaction", "clientswithMostProductVariety",
)


def all_reports(lines: DataFrame, client_labels: DataFrame | None = None,
                buy_more_denominator: str = "units") -> dict[str, DataFrame]:
    """The twelve exploration results by name.

    The three shared inputs - totals (one row), per-product and per-client
    figures (one row per key) - are aggregated once and written to the
    checkpoint folder; the twelve results are projections and sorts of them,
    so the line table is aggregated three times in all, not once per result.
    Product rankings carry the total that their shares refer to.
    """
    tot = materialize(totals(lines), "totals")
    by_product = materialize(totals_by_product(lines), "by-product")
    by_client = materialize(totals_by_client(lines, client_labels), "by-client")
    def with_total(report, column):
        return report.withColumn(column, _total(tot, column))

    return {
        "totals": tot,
        "totalsByProd": by_product,
        "prodsMostSold": with_total(prods_most_sold(lines, by_product, tot), "total_products_sold"),
        "prodsMostEarns": with_total(prods_most_earns(lines, by_product, tot), "total_earnings"),
        "prodsMostPopular": with_total(prods_most_popular(lines, by_product, tot), "total_transactions"),
        "totalsByClient": by_client,
        "clientsWhoSpentMore": clients_spent_more(lines, by_client=by_client, tot=tot),
        "clientsWhoBuyMoreProds": clients_buy_more(lines, by_client=by_client, tot=tot,
                                                   denominator=buy_more_denominator),
        "clientswithMostTransactions": clients_most_transactions(lines, by_client=by_client, tot=tot),
        "clientsSpentMorePerTransaction": clients_spent_per_transaction(lines, by_client=by_client),
        "clientsMoreProdsPerTransaction": clients_prods_per_transaction(lines, by_client=by_client),
        "clientswithMostProductVariety": clients_variety(lines, by_client=by_client, tot=tot),
    }
