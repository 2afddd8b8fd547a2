"""Print the formatted physical plan of registered queries.

usage: python scripts/explain_query.py [sf_dir] name [name ...]

Queries that fit an index or run a rank loop execute those steps while the
frame is built (they write intermediate tables); the plan printed is the
one of the final frame.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketlens.plans.registry import QUERIES  # noqa: E402
from basketlens.session import get_spark  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in args or sorted(QUERIES):
        print(f"===== {name}")
        QUERIES[name](spark, sf_dir).explain(mode="formatted")


if __name__ == "__main__":
    main()
