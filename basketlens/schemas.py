"""Ticket and basket schemas, column names and fixed values."""

from pyspark.sql import types as T

# Results only agree with the source application when these
# are exactly as written here.
#   product descriptions removed from every basket (shopping bag line)
EXCLUDED_PRODUCTS = ("BOLSA CARREFOUR",)
#   rows kept per key by the recommender
RECOMMENDATIONS_PER_KEY = 10
#   ALS settings: one iteration, regularisation 0.01, library defaults otherwise
ALS_MAX_ITER = 1
ALS_REG_PARAM = 0.01
ALS_RANK = 10
#   train / test weights of the held-out split
ALS_SPLIT = (0.8, 0.2)
#   lazy-walk rank: share of the own rank kept per step, tolerance, step cap
LAZY_WALK_DAMPING = 0.15
LAZY_WALK_TOLERANCE = 0.01
LAZY_WALK_MAX_ITER = 10
#   PageRank: damping and tolerance (reset probability = 1 - damping)
PAGERANK_DAMPING = 0.85
PAGERANK_TOLERANCE = 0.01
#   rows printed by the console sink
PREVIEW_ROWS = 20
#   output modes of the result writer
OUTPUT_MODES = ("parallelWriteJSON", "oneJSON", "standarOutput")
#   analyses that a configuration can name, its keys, and the sizes of the shipped examples
APPS = ("DataExplorer", "RecommenderALS", "RecommenderGraphD", "RecommenderGraphX")
CONFIG_KEYS = ("appName", "outputMode", "numClients", "numProds", "usersCol", "itemsCol", "ratingsCol",
               "vertexCol", "edgeCol", "vertexPropertiesCol")
EXPLORATION_TOP, ALS_TOP, GRAPH_D_TOP, GRAPH_X_TOP = 10, 30, 10, 5

# Nested ticket document (one purchase).
TICKET_ITEM = T.StructType([
    T.StructField("desc", T.StringType()),
    T.StructField("n_unit", T.DoubleType()),
    T.StructField("net_am", T.DoubleType()),
])

TICKET = T.StructType([
    T.StructField("_id", T.LongType()),
    T.StructField("client", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("items", T.ArrayType(TICKET_ITEM)),
    T.StructField("mall", T.IntegerType()),
])

# Flat basket table: one row per ticket item.
TRANSAC = "transac"
CLIENT = "client"
DATE = "date"
PRODUCT = "prodName"
UNITS = "prodUds"
COST = "prodsCost"
MALL = "mall"
PRODUCT_KEY = "prodKey"
BASKET_COLUMNS = (TRANSAC, CLIENT, DATE, PRODUCT, UNITS, COST, MALL)

BASKET = T.StructType([
    T.StructField(TRANSAC, T.LongType()),
    T.StructField(CLIENT, T.LongType()),
    T.StructField(DATE, T.DateType()),
    T.StructField(PRODUCT, T.StringType()),
    T.StructField(UNITS, T.DoubleType()),
    T.StructField(COST, T.DoubleType()),
    T.StructField(MALL, T.IntegerType()),
])


def index_column(label_column: str) -> str:
    """Name of the frequency index of a label column (``client`` -> ``clientIndex``)."""
    return f"{label_column}Index"
