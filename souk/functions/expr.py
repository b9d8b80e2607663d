"""Scalar and aggregate helpers that pin down numeric semantics.

* Money stays DECIMAL until the last step so sums are exact on any engine.
* ``round_dp`` rounds half-up through DECIMAL(38,10), so 0.285 -> 0.29 (a bare
  double round can give 0.28 on some engines).
* Elapsed time is integer microseconds; days are micros / 86,400,000,000, the
  same fractional days a julian-day difference gives.
* Ratios use ``try_divide``: a zero denominator yields NULL, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x) -> Column:
    return _c(x).cast("double")


def round_dp(x, n: int) -> Column:
    """Half-up rounding to ``n`` places, returned as DOUBLE."""
    return F.round(_c(x).cast("decimal(38,10)"), n).cast("double")


def count_rows() -> Column:
    """COUNT(*) as BIGINT."""
    return F.count(F.lit(1))


def avg_of(x) -> Column:
    """AVG as exact SUM / COUNT of non-NULL values, as DOUBLE."""
    return F.try_divide(F.sum(_c(x)).cast("double"), F.count(_c(x)))


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def days_between(start, end) -> Column:
    """Fractional days from ``start`` to ``end`` (DOUBLE)."""
    return micros_between(start, end) / F.lit(float(DAY_US))


def trunc_days(start, end) -> Column:
    """Whole elapsed days, truncated toward zero (INT cast of fractional days)."""
    return days_between(start, end).cast("long")


def avg_days(micros) -> Column:
    """Mean of a microsecond column in days: exact integer sum, one division."""
    m = _c(micros)
    return F.try_divide(F.sum(m.cast("decimal(38,0)")).cast("double"), F.count(m)) / F.lit(float(DAY_US))


def pct(part, whole, dp: int) -> Column:
    """ROUND(100.0 * part / whole, dp) with a NULL on a zero denominator."""
    return round_dp(F.try_divide(F.lit(100.0) * as_double(part), as_double(whole)), dp)


def share_of_total(df: DataFrame, num: str, out: str, dp: int) -> DataFrame:
    """Add ``out`` = ROUND(100 * num / SUM(num) OVER (), dp) to a grouped result.

    For small results only (one row per state, category, status, score ...):
    the total is a window over the grouped rows themselves, so the plan adds
    a single tiny exchange and never re-runs the aggregation below it. A
    following ``orderBy`` then needs no further exchange either.
    """
    total = F.sum(num).over(Window.partitionBy())
    return df.withColumn(out, pct(F.col(num), total, dp))


def share_of_external_total(df: DataFrame, num: str, out: str, dp: int,
                            total: DataFrame, total_col: str) -> DataFrame:
    """Like ``share_of_total`` with the denominator from a one-row frame.

    A single row is a proven broadcast bound; used when ``df`` holds only a
    few rows of a large population (for example a top-n list).
    """
    return (df.crossJoin(F.broadcast(total.select(F.col(total_col).alias("__share_total"))))
            .withColumn(out, pct(F.col(num), F.col("__share_total"), dp))
            .drop("__share_total"))
