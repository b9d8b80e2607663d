"""Column helpers shared by the operators (all Spark built-ins, no UDFs)."""

from souk.functions.expr import (
    DAY_US, as_double, avg_of, count_rows, days_between, micros_between, round_dp,
    share_of_external_total, share_of_total, trunc_days,
)
from souk.functions.ntile import ntile_by_cuts

__all__ = [
    "DAY_US", "as_double", "avg_of", "count_rows", "days_between", "micros_between",
    "round_dp", "share_of_total", "share_of_external_total", "trunc_days", "ntile_by_cuts",
]
