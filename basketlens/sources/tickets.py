"""Ticket document scans and flattening to the basket table.

* ``read_tickets``      - JSON lines with the ticket schema, malformed lines dropped
* ``read_shell_export`` - the document-database shell dialect: documents one
  after another in any layout (pretty-printed, one per line, back to back, as
  an array), numbers wrapped as ``NumberInt(..)``, ``NumberLong(..)``, dates as
  ``ISODate("..")``. Parsed in parallel: the text source splits on the key
  ``"_id"`` that opens every document, so one file is cut into splits like any
  text file and no document passes through the driver.
* ``flatten_baskets``   - drop anonymous tickets, one row per item, rename,
  drop excluded products
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens import schemas as S

# The wrappers of the shell dialect. JSON strings are matched first
# and copied whole, so text inside product descriptions stays as it is; so is what
# lies between them and opens no wrapper, a run at a time.
SHELL_VALUES = (r'([^"NI]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")'
                r'|Number(?:Long|Int)\(\s*"?(-?[0-9]+)"?\s*\)'
                r'|NumberDecimal\(\s*"(-?[0-9.eE+-]+)"\s*\)'
                r'|ISODate\(\s*("[^"]*")\s*\)')
# The key that opens every document. As text of a string it could only be a
# whole string (quotes inside strings are escaped), which the reader refuses.
DOCUMENT_KEY = '"_id"'
# White space as a pattern's \\s has it.
SPACE = " \t\n\x0b\f\r"


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines ticket documents with an explicit schema; malformed lines are dropped."""
    return (spark.read.schema(S.TICKET)
            .option("mode", "DROPMALFORMED")
            .json(path))


def unwrap_shell_values(text: Column) -> Column:
    return F.regexp_replace(text, SHELL_VALUES, "$1$2$3$4")


def read_shell_export(spark: SparkSession, path: str) -> DataFrame:
    """Documents in the shell export dialect, parsed to the ticket schema.

    Any layout and line ends; documents must begin with ``_id``. A document that
    does not parse, or holds a value of the wrong kind, is dropped as by
    ``read_tickets``. Input that cannot be cut into documents fails: text before
    the first document, or a product whose whole name is ``_id``.
    """
    raw = spark.read.option("lineSep", DOCUMENT_KEY).text(path)
    piece = F.rtrim(F.ltrim("value", F.lit(SPACE + "﻿")), F.lit(SPACE + ",[]{"))
    # what stands before a file's first document is blank, or opens it: a document cut short, dropped as such
    body = raw.select(piece.alias("body"))
    checked = (F.when(F.col("body").startswith(":"), F.col("body"))
               .when(F.ltrim("body", F.lit("[{,")) == "", F.lit(""))
               .otherwise(F.raise_error(F.concat(F.lit("not a document after the key _id: "), F.substring("body", 1, 80)))))
    docs = body.select(F.concat(F.lit("{" + DOCUMENT_KEY), unwrap_shell_values(checked)).alias("json"))
    schema = T.StructType([*S.TICKET.fields, T.StructField("_corrupt", T.StringType())])
    # a generator: filters on the parsed columns cannot be moved below it, where each would parse the text again
    parsed = docs.select(F.inline(F.array(F.from_json("json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))))
    return parsed.where(F.col("_corrupt").isNull()).drop("_corrupt")


def exclude_products(df: DataFrame, excluded=S.EXCLUDED_PRODUCTS, column: str = S.PRODUCT) -> DataFrame:
    """Keep rows whose product is not excluded; like ``<>``, null names are dropped too."""
    cond = F.col(column).isNotNull()
    if excluded:
        cond = cond & ~F.col(column).isin(list(excluded))
    return df.where(cond)


def flatten_baskets(tickets: DataFrame, excluded=S.EXCLUDED_PRODUCTS) -> DataFrame:
    """Tickets -> basket lines: anonymous tickets and tickets without items vanish."""
    item = F.explode(F.col("items")).alias("item")
    lines = (tickets.where(F.col("client").isNotNull())
             .select(F.col("_id"), F.col("client"), F.col("date"), F.col("mall"), item)
             .select(F.col("_id").cast("long").alias(S.TRANSAC),
                     F.col("client").cast("long").alias(S.CLIENT),
                     F.col("date").alias(S.DATE),
                     F.col("item.desc").alias(S.PRODUCT),
                     F.col("item.n_unit").cast("double").alias(S.UNITS),
                     F.col("item.net_am").cast("double").alias(S.COST),
                     F.col("mall").cast("int").alias(S.MALL)))
    return exclude_products(lines, excluded)


# The writer's format: items of one ticket document (about).
ITEMS_PER_DOCUMENT = 10_000


def tickets_from_baskets(lines: DataFrame, max_items: int = ITEMS_PER_DOCUMENT) -> DataFrame:
    """Nest basket lines back into ticket documents.

    A ticket of n lines is written as ``ceil(n / max_items)`` documents with its
    id, of about ``max_items`` items each, so no document - and no task building
    one - grows with the largest ticket; flattening gives back the same lines.
    An item's document is a hash of its columns and of its number among equal
    items, so a repeated task places every item as before.
    """
    head = [S.TRANSAC, S.CLIENT, S.DATE, S.MALL]
    equal = lines.groupBy(*head, S.PRODUCT, S.UNITS, S.COST).agg(F.count(F.lit(1)).alias("_copies"))
    sizes = equal.groupBy(F.col(S.TRANSAC).alias("_t")).agg(F.sum("_copies").alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(max_items))
    keyed = (equal.join(sizes, F.col(S.TRANSAC).eqNullSafe(F.col("_t")))
             .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
             .withColumn("_part", F.pmod(F.xxhash64(S.PRODUCT, S.UNITS, S.COST, "_copy"), parts)))
    item = F.struct(F.col(S.PRODUCT).alias("desc"), F.col(S.UNITS).alias("n_unit"),
                    F.col(S.COST).alias("net_am"))
    return (keyed.groupBy(*head, "_part")
            .agg(F.collect_list(item).alias("items"))
            .select(F.col(S.TRANSAC).alias("_id"), F.col(S.CLIENT).alias("client"), F.col(S.DATE).alias("date"),
                    "items", F.col(S.MALL).alias("mall")))


def _json_string(text: Column) -> Column:
    """A string column rendered as a JSON string literal (quoted, escaped)."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))  # the quotes end the trimming


def shell_export_text(tickets: DataFrame) -> DataFrame:
    """Render tickets in the shell export dialect, one document per text row.

    Whole numbers are wrapped as the shell prints them; units that are not
    whole stay plain numbers.
    """
    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def wrapped(fn, column):
        return F.coalesce(text(fn + "(", column.cast("long").cast("string"), ")"), F.lit("null"))

    date_txt = F.coalesce(text('ISODate("', F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"), '")'), F.lit("null"))
    item_txt = F.transform(
        F.col("items"),
        lambda it: text(
            '{\n            "net_am" : ', F.coalesce(it["net_am"].cast("string"), F.lit("null")),
            ',\n            "n_unit" : ',
            F.when(F.abs(it["n_unit"]) % 1 > 0, it["n_unit"].cast("string")).otherwise(wrapped("NumberInt", it["n_unit"])),
            ',\n            "desc" : ', F.coalesce(_json_string(it["desc"]), F.lit("null")), "\n        }"))
    return tickets.select(text(
        '{\n    "_id" : ', wrapped("NumberInt", F.col("_id")), ',\n    "mall" : ', wrapped("NumberInt", F.col("mall")),
        ',\n    "date" : ', date_txt, ',\n    "items" : [\n        ',
        F.coalesce(F.array_join(item_txt, ",\n        "), F.lit("null")),
        '\n    ],\n    "client" : ', wrapped("NumberLong", F.col("client")), "\n}").alias("value"))
