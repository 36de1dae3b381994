"""Date helpers with the warehouse's semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_diff(start, end) -> Column:
    """Number of midnights crossed from ``start`` to ``end`` (INT).

    Same as a warehouse ``datediff('day', start, end)``: 23:59 -> 00:01 is 1.
    """
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start))).cast("int")


def month_start(c) -> Column:
    return F.trunc(F.to_date(_c(c)), "month")


def day_of_week_sunday0(c) -> Column:
    """0 = Sunday .. 6 = Saturday (Spark's dayofweek is 1 = Sunday)."""
    return (F.dayofweek(_c(c)) - 1).cast("int")
