"""Scalar column expressions: rounding, ratios, shares.

All stay JVM-side (built-in functions), so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every rounded figure goes through this exact decimal type before
# half-even rounding, so results do not depend on binary float noise.
ROUNDING_DECIMAL = "decimal(38,6)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int = 0) -> Column:
    """``bround`` on a fixed decimal, returned as double (half-even, deterministic)."""
    return F.bround(_col(c).cast(ROUNDING_DECIMAL), digits).cast("double")


def money_sum(c) -> Column:
    """Exact sum of a money column, unrounded (order of addition is irrelevant)."""
    return F.sum(_col(c).cast(ROUNDING_DECIMAL))


def ratio(num, den) -> Column:
    """``num / den`` as double; null instead of an error when ``den`` is 0."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def percent_of(value, total, digits: int = 2) -> Column:
    """Share of a total in percent, rounded half-even: ``bround(value*100/total, 2)``."""
    return round_half_even(ratio(_col(value).cast("double") * F.lit(100.0), total), digits)
