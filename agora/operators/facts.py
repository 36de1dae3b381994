"""Facts (E1-E4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day_diff, surrogate_key
from ..plans.strategy import bounded_broadcasts, joins_known


def fact_order_items(items: DataFrame, customers: DataFrame | None, sellers: DataFrame | None,
                     products: DataFrame | None, seen: DataFrame | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Enriched items that have all three dimensions (inner joins).

    ``customers=None`` means the customer join was already applied on the
    order side (``orders_with_customer``): the same inner join, but it shuffles
    the orders instead of the four-times larger items. ``sellers`` and ``products``
    may be None as well, when the items met them before (``items_with_dimensions``).
    ``more`` names columns of the items to keep beside the fact's.
    """
    return keyed_order_items(known_order_items(items, customers, sellers, products, seen), more)


def known_order_items(items: DataFrame, customers: DataFrame | None, sellers: DataFrame | None,
                      products: DataFrame | None, seen: DataFrame | None = None) -> DataFrame:
    """The joins of E1: its rows with ids in place of keys, a third as wide. Sellers and
    products are broadcast when their checked size allows; else, with ``seen`` (a table
    that holds all the ids of the items), the items still stay where they are (``join_known``)."""
    j = items
    if customers is not None:
        j = j.join(customers.select("customer_id"), "customer_id")
    known = [d for d in (sellers, products) if d is not None]
    names = [c for c, d in (("seller_id", sellers), ("product_id", products)) if d is not None]
    return joins_known(j, [d.select(c) for c, d in zip(names, known)], names, seen)


def keyed_order_items(known: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """E1's columns from ``known_order_items``."""
    number = [surrogate_key("order_id", "order_item_id").alias("order_item_key"), F.col("order_id"), F.col("order_item_id")]
    return known.select(
        *number,
        surrogate_key("customer_id").alias("customer_key"),
        surrogate_key("seller_id").alias("seller_key"),
        surrogate_key("product_id").alias("product_key"),
        F.to_date("purchase_date").alias("purchase_date"),
        F.to_date("delivered_date").alias("delivered_date"),
        "price", "freight_value", "total_item_value", *more,
    )


def items_with_dimensions(items: DataFrame, *dimensions: tuple[str, DataFrame]) -> DataFrame:
    """Items joined (inner, fan-out kept) to tables by an id of theirs, before they meet their orders.

    An item is then shuffled once per id whose table is too large to broadcast, with no
    column of its order, and for good by order."""
    sides = bounded_broadcasts(*[d for _, d in dimensions])
    for (key, _), side in zip(dimensions, sides):
        items = items.join(side, key)
    return items


def fact_orders_accumulating(lifecycle: DataFrame, processed_at=None) -> DataFrame:
    """One row per order with milestone lags and the on-time flag."""
    ts = F.current_timestamp() if processed_at is None else F.lit(processed_at).cast("timestamp_ntz")
    return lifecycle.select(
        "order_id", "customer_id", "order_status", "purchase_date", "approved_date", "carrier_date",
        "delivered_date", "estimated_date",
        day_diff("purchase_date", "approved_date").alias("purchase_to_approve_days"),
        day_diff("approved_date", "carrier_date").alias("approve_to_ship_days"),
        day_diff("carrier_date", "delivered_date").alias("ship_to_deliver_days"),
        F.when(F.col("delivered_date") <= F.col("estimated_date"), 1).otherwise(0).alias("on_time_flag"),
        ts.alias("processed_at"),
    )


def fact_payments(stg_payments: DataFrame) -> DataFrame:
    return stg_payments.select(
        "order_id", "payment_sequential", surrogate_key("payment_type").alias("payment_type_key"),
        "payment_value", "payment_installments", "installment_value")


def fact_reviews(int_reviews: DataFrame) -> DataFrame:
    return int_reviews.select(
        "review_key", "review_id", "order_id", "review_score", "review_sentiment",
        "review_creation_date", "review_answer_timestamp", "has_comment")


def orders_with_customer(lifecycle: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders whose customer exists (inner join, fan-out kept): the customer
    part of E1's joins, applied to the orders before they meet the items."""
    return lifecycle.join(customers.select("customer_id"), "customer_id")
