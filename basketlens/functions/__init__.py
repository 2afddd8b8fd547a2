"""Column helpers shared by the operators."""

from basketlens.functions.columns import (
    money_sum,
    percent_of,
    ratio,
    round_half_even,
)
from basketlens.functions.row_index import with_row_index

__all__ = ["money_sum", "percent_of", "ratio", "round_half_even", "with_row_index"]
