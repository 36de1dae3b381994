"""Business classification expressions shared by the marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def customer_segment(total_orders, revenue) -> Column:
    """VIP / Premium / Regular / New; NULL inputs fall through to New.

    Fixed thresholds: VIP >= 10 orders and >= 5000, Premium >= 5 and >= 2000,
    Regular >= 2 and >= 500.
    """
    o, r = _c(total_orders), _c(revenue)
    return (F.when((o >= 10) & (r >= 5000), "VIP")
            .when((o >= 5) & (r >= 2000), "Premium")
            .when((o >= 2) & (r >= 500), "Regular")
            .otherwise("New"))


def sales_tier(units) -> Column:
    u = _c(units)
    return (F.when(u >= 100, "Top Seller").when(u >= 50, "Popular")
            .when(u >= 10, "Moderate").otherwise("Low Volume"))


def quality_tier(rating) -> Column:
    r = _c(rating)
    return (F.when(r >= 4.5, "Excellent").when(r >= 4.0, "Good")
            .when(r >= 3.0, "Average").otherwise("Below Average"))
