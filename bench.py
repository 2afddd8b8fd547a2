"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully evaluated with the no-op sink (all rows computed, none
collected). Prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

BENCH_REPEAT (default 3) runs each query that many times and keeps the median.
Row counts are part of the output; "als_fit" is the ALS fit apart from scoring.
BENCH_QUERIES (comma list) restricts the set.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from basketlens.operators.als import fit_als  # noqa: E402
from basketlens.plans.registry import QUERIES, als_parts  # noqa: E402
from basketlens.session import clear_scratch, get_spark  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_spark(f"local[{cpus}]", app_name="basketlens-bench", shuffle_partitions=cpus * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JIT and parquet metadata, not timed
    QUERIES["totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        runs = []
        for _ in range(repeat):
            counted = Observation()
            t0 = time.perf_counter()
            fn(spark, sf_dir).observe(counted, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
            rows[name] = counted.get["rows"]
            clear_scratch(spark)
        times[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {times[name]:.3f}s", file=sys.stderr, flush=True)

    if not only or "als_fit" in only:
        parts = als_parts(spark, sf_dir)[0]
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fit_als(parts, "prodNameIndex", "clientIndex", "prodUds")
            runs.append(time.perf_counter() - t0)
        times["als_fit"] = round(statistics.median(runs), 3)
        clear_scratch(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
