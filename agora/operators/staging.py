"""Staging models (B1-B9): one raw table in, projection plus derived columns.

``loaded_at`` (A19) is optional so that results stay deterministic in tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day_diff, surrogate_key


def _stamp(df: DataFrame, loaded_at) -> DataFrame:
    return df if loaded_at is None else with_loaded_at(df, loaded_at)


def with_loaded_at(df: DataFrame, ts=None) -> DataFrame:
    """``_loaded_at`` on every row (``current_timestamp`` unless given)."""
    value = F.current_timestamp() if ts is None else F.lit(ts).cast("timestamp_ntz")
    return df.withColumn("_loaded_at", value)


def stg_customers(raw: DataFrame, loaded_at=None) -> DataFrame:
    return _stamp(raw.select("customer_id", "customer_unique_id", "customer_zip_code_prefix",
                             "customer_city", "customer_state"), loaded_at)


def stg_geolocation(raw: DataFrame, loaded_at=None) -> DataFrame:
    return _stamp(raw.select("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
                             "geolocation_city", "geolocation_state"), loaded_at)


def stg_orders(raw: DataFrame, loaded_at=None) -> DataFrame:
    delivered = F.col("order_delivered_customer_date")
    estimate = F.col("order_estimated_delivery_date")
    return _stamp(raw.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
        "order_estimated_delivery_date",
        F.when(delivered.isNotNull(), day_diff("order_purchase_timestamp", delivered)).alias("delivery_days"),
        F.when(delivered.isNotNull() & estimate.isNotNull(), day_diff(delivered, estimate))
        .alias("delivery_vs_estimate_days"),
        F.when(delivered <= estimate, "on_time").when(delivered > estimate, "late")
        .otherwise("unknown").alias("delivery_performance"),
    ), loaded_at)


def stg_order_items(raw: DataFrame, loaded_at=None) -> DataFrame:
    return _stamp(raw.select(
        "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
        "price", "freight_value",
        (F.col("price") + F.col("freight_value")).alias("total_item_value"),
    ), loaded_at)


def stg_order_payments(raw: DataFrame, loaded_at=None) -> DataFrame:
    n = F.col("payment_installments")
    value = F.col("payment_value").cast("double")
    return _stamp(raw.select(
        "order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value",
        F.when(n > 1, F.round(value / n, 6)).otherwise(value).alias("installment_value"),
    ), loaded_at)


def stg_order_reviews(raw: DataFrame, loaded_at=None) -> DataFrame:
    s = F.col("review_score")
    return _stamp(raw.select(
        surrogate_key("review_id", "order_id").alias("id"),
        "review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
        "review_creation_date", "review_answer_timestamp",
        F.when(s >= 4, "positive").when(s == 3, "neutral").otherwise("negative").alias("review_sentiment"),
        F.col("review_comment_message").isNotNull().alias("has_comment"),
    ), loaded_at)


def stg_products(raw: DataFrame, loaded_at=None) -> DataFrame:
    g = F.col("product_weight_g")
    photos = F.col("product_photos_qty")
    return _stamp(raw.select(
        "product_id", "product_category_name", "product_name_length", "product_description_length",
        "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm",
        "product_width_cm",
        (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm"))
        .alias("product_volume_cm3"),
        F.when(g.isNotNull() & (g > 0), g.cast("double") / 1000.0).alias("product_weight_kg"),
        F.when(photos == 0, "no_photos").when(photos.between(1, 3), "few_photos")
        .when(photos.between(4, 6), "moderate_photos").otherwise("many_photos").alias("photo_category"),
    ), loaded_at)


def stg_sellers(raw: DataFrame, loaded_at=None) -> DataFrame:
    return _stamp(raw.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"), loaded_at)


def stg_category_translation(raw: DataFrame, loaded_at=None) -> DataFrame:
    return _stamp(raw.select("product_category_name", "product_category_name_english"), loaded_at)
