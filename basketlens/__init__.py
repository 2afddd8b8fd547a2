"""basketlens: retail basket analytics on Spark DataFrames.

Layers:

* ``sources``   - ticket scans (JSON lines, shell export), star-schema mapping, sinks
* ``functions`` - column helpers (rounding, shares, distributed row index)
* ``operators`` - frequency index, reports, co-purchase graph, ranks, ALS
* ``plans``     - the four analyses as runnable units and the query registry
* ``streaming`` - incremental ticket ingest with Structured Streaming
"""

from basketlens.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
