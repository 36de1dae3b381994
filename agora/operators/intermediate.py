"""Intermediate models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day_diff, surrogate_key
from ..plans.strategy import bounded_broadcast


def geo_by_zip(stg_geo: DataFrame, city: str = "geo_city", state: str = "geo_state") -> DataFrame:
    """One row per zip prefix; ``min`` is the deterministic pick for any_value.

    Partial aggregation runs map-side, so only one row per zip and task is
    shuffled even when one zip holds a third of all rows.
    """
    return stg_geo.groupBy("geolocation_zip_code_prefix").agg(
        F.min("geolocation_city").alias(city), F.min("geolocation_state").alias(state))


def int_customers_geocoded(stg_customers: DataFrame, stg_geo: DataFrame) -> DataFrame:
    c = stg_customers.groupBy("customer_id", "customer_unique_id", "customer_zip_code_prefix").agg(
        F.min("customer_city").alias("customer_city"), F.min("customer_state").alias("customer_state"))
    g = bounded_broadcast(geo_by_zip(stg_geo))
    j = c.join(g, c.customer_zip_code_prefix == g.geolocation_zip_code_prefix, "left")
    return j.select("customer_id", "customer_unique_id", "customer_zip_code_prefix",
                    "customer_city", "customer_state", "geo_city", "geo_state")


def int_sellers_geocoded(stg_sellers: DataFrame, stg_geo: DataFrame) -> DataFrame:
    g = bounded_broadcast(geo_by_zip(stg_geo))
    j = stg_sellers.join(g, stg_sellers.seller_zip_code_prefix == g.geolocation_zip_code_prefix, "left")
    return j.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state",
                    "geo_city", "geo_state")


def int_orders_lifecycle(stg_orders: DataFrame) -> DataFrame:
    ntz = "timestamp_ntz"
    return stg_orders.select(
        "order_id", "customer_id", "order_status",
        F.col("order_purchase_timestamp").cast(ntz).alias("purchase_date"),
        F.col("order_approved_at").cast(ntz).alias("approved_date"),
        F.col("order_delivered_carrier_date").cast(ntz).alias("carrier_date"),
        F.col("order_delivered_customer_date").cast(ntz).alias("delivered_date"),
        F.col("order_estimated_delivery_date").cast(ntz).alias("estimated_date"),
        "delivery_days", "delivery_vs_estimate_days", "delivery_performance",
    )


def int_order_items_enriched(stg_items: DataFrame, lifecycle: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """C4; ``more`` names columns of the items to keep beside."""
    o = lifecycle.select("order_id", "customer_id", "purchase_date", "approved_date",
                         "delivered_date", "estimated_date")
    j = stg_items.join(o, "order_id")
    return j.select(
        "order_id", "order_item_id", "product_id", "seller_id", "customer_id", "purchase_date",
        "approved_date", "delivered_date", "estimated_date", "price", "freight_value",
        "total_item_value", day_diff("purchase_date", "delivered_date").alias("days_to_deliver"), *more,
    )


def int_products_cleaned(stg_products: DataFrame, stg_translation: DataFrame) -> DataFrame:
    t = bounded_broadcast(stg_translation.select(F.col("product_category_name").alias("_cat"),
                                                 "product_category_name_english"))
    j = stg_products.join(t, stg_products.product_category_name == t._cat, "left")
    return j.select(
        "product_id", "product_name_length", "product_description_length", "product_photos_qty",
        "product_volume_cm3", "product_weight_kg", "photo_category",
        F.coalesce("product_category_name_english", "product_category_name").alias("product_category_name"),
    )


def int_reviews_cleaned(stg_reviews: DataFrame) -> DataFrame:
    # Argument order (order_id, review_id) differs from stg id on purpose.
    return stg_reviews.select(
        surrogate_key("order_id", "review_id").alias("review_key"),
        "review_id", "order_id", "review_score", "review_sentiment", "review_creation_date",
        "review_answer_timestamp", "has_comment",
    )
