"""Basket table from a star schema (lineitem, orders, part, customer, nation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens import schemas as S
from basketlens.session import size_scans, size_shuffles
from basketlens.sources.tickets import exclude_products


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def baskets_from_star(spark: SparkSession, sf_dir: str, with_mall: bool = True,
                      excluded=S.EXCLUDED_PRODUCTS, with_key: bool = False,
                      clients: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """Map the star schema onto the flat basket table.

    ``transac = l_orderkey``, ``client = o_custkey``, ``date = o_orderdate``,
    ``prodName = p_name#p_partkey`` (names alone are not unique),
    ``prodUds = l_quantity``, ``prodsCost = l_extendedprice``,
    ``mall = n_regionkey`` of the client's nation.

    Join order keeps the fact table's shuffles at two (by order key, then by
    part key); the client lookup for ``mall`` is done on ``orders`` (a
    quarter of the fact rows) and is a left join, so orders of unknown
    clients keep their lines with a null mall. Analyses that never read
    ``mall`` pass ``with_mall=False`` and skip that join entirely.
    ``with_key`` adds ``prodKey = p_partkey``, the product as a number.
    ``clients`` / ``products`` (frames with that column) keep only their lines: by
    semi-joins on ``orders`` and ``part``, below the joins with the fact table.
    The session's shuffles and scans are sized to the number of lines (kept in the files' footers).
    """
    rows = read_table(spark, sf_dir, "lineitem").count()
    size_shuffles(spark, rows)
    size_scans(spark, rows, table_path(sf_dir, "lineitem"))
    lineitem = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias(S.TRANSAC),
        F.col("l_partkey").alias("_partkey"),
        F.col("l_quantity").cast("double").alias(S.UNITS),
        F.col("l_extendedprice").cast("double").alias(S.COST),
    )
    orders = (read_table(spark, sf_dir, "orders")
              .where(F.col("o_custkey").isNotNull())
              .select(F.col("o_orderkey").alias(S.TRANSAC),
                      F.col("o_custkey").alias(S.CLIENT),
                      F.to_date("o_orderdate").alias(S.DATE)))
    if clients is not None:
        orders = orders.join(clients.select(S.CLIENT), S.CLIENT, "left_semi")
    if with_mall:
        nation = read_table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("_nationkey"), F.col("n_regionkey").cast("int").alias(S.MALL))
        client_mall = (read_table(spark, sf_dir, "customer")
                       .select(F.col("c_custkey").alias(S.CLIENT), F.col("c_nationkey").alias("_nationkey"))
                       .join(nation, "_nationkey", "left")
                       .select(S.CLIENT, S.MALL))
        orders = orders.join(client_mall, S.CLIENT, "left")
    else:
        orders = orders.withColumn(S.MALL, F.lit(None).cast("int"))
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("_partkey"),
        F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias(S.PRODUCT),
    )
    part = exclude_products(part, excluded)
    if products is not None:
        part = part.join(products.select(S.PRODUCT), S.PRODUCT, "left_semi")
    lines = lineitem.join(orders, S.TRANSAC).join(part, "_partkey")
    return lines.select(*S.BASKET_COLUMNS, *([F.col("_partkey").alias(S.PRODUCT_KEY)] if with_key else []))


def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(prodKey, prodName)`` of every product."""
    part = read_table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias(S.PRODUCT_KEY),
                       F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias(S.PRODUCT))
