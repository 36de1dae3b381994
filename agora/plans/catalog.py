"""Query registry: SURVEY section-2 ID -> (Spark builder, DuckDB oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole given tables, encoded with ``export`` for the cross-engine compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .export import export
from .models import Warehouse
from .oracle import enc, with_ctes
from .strategy import decision_scope

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(key: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with decision_scope():
                return export(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[key] = (run, sql)
        return fn
    return deco


def model_query(key: str, node: str, spec: str):
    """Register a warehouse node as a query with an oracle selecting ``spec``."""
    sql = with_ctes(f"SELECT {enc(spec)} FROM {node}")

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Warehouse(spark, sf_dir), node)

    build.__name__ = node
    register(key, sql)(build)


# ---- B: staging ----
model_query("B1_stg_customers", "stg_customers",
            "customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state")
model_query("B2_stg_geolocation", "stg_geolocation",
            "geolocation_zip_code_prefix, m:geolocation_lat, m:geolocation_lng, geolocation_city, geolocation_state")
model_query("B3_stg_orders", "stg_orders",
            "order_id, customer_id, order_status, t:order_purchase_timestamp, t:order_approved_at, "
            "t:order_delivered_carrier_date, t:order_delivered_customer_date, t:order_estimated_delivery_date, "
            "delivery_days, delivery_vs_estimate_days, delivery_performance")
model_query("B4_stg_order_items", "stg_order_items",
            "order_id, order_item_id, product_id, seller_id, t:shipping_limit_date, m:price, m:freight_value, "
            "m:total_item_value")
model_query("B5_stg_order_payments", "stg_order_payments",
            "order_id, payment_sequential, payment_type, payment_installments, m:payment_value, installment_value")
model_query("B6_stg_order_reviews", "stg_order_reviews",
            "id, review_id, order_id, review_score, review_comment_title, review_comment_message, "
            "review_creation_date, review_answer_timestamp, review_sentiment, has_comment")
model_query("B7_stg_products", "stg_products",
            "product_id, product_category_name, product_name_length, product_description_length, "
            "product_photos_qty, product_weight_g, product_length_cm, product_height_cm, product_width_cm, "
            "product_volume_cm3, product_weight_kg, photo_category")
model_query("B8_stg_sellers", "stg_sellers", "seller_id, seller_zip_code_prefix, seller_city, seller_state")
model_query("B9_stg_category_translation", "stg_category_translation",
            "product_category_name, product_category_name_english")

# ---- C: intermediate ----
model_query("C1_int_customers_geocoded", "int_customers_geocoded",
            "customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state, "
            "geo_city, geo_state")
model_query("C2_int_sellers_geocoded", "int_sellers_geocoded",
            "seller_id, seller_zip_code_prefix, seller_city, seller_state, geo_city, geo_state")
model_query("C3_int_orders_lifecycle", "int_orders_lifecycle",
            "order_id, customer_id, order_status, t:purchase_date, t:approved_date, t:carrier_date, "
            "t:delivered_date, t:estimated_date, delivery_days, delivery_vs_estimate_days, delivery_performance")
model_query("C4_int_order_items_enriched", "int_order_items_enriched",
            "order_id, order_item_id, product_id, seller_id, customer_id, t:purchase_date, t:approved_date, "
            "t:delivered_date, t:estimated_date, m:price, m:freight_value, m:total_item_value, days_to_deliver")
model_query("C5_int_products_cleaned", "int_products_cleaned",
            "product_id, product_name_length, product_description_length, product_photos_qty, "
            "product_volume_cm3, product_weight_kg, photo_category, product_category_name")
model_query("C6_int_reviews_cleaned", "int_reviews_cleaned",
            "review_key, review_id, order_id, review_score, review_sentiment, review_creation_date, "
            "review_answer_timestamp, has_comment")

# ---- D: dimensions ----
model_query("D1_dim_customer", "dim_customer",
            "customer_key, customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, "
            "customer_state, geo_city, geo_state")
model_query("D2_dim_seller", "dim_seller",
            "seller_key, seller_id, seller_zip_code_prefix, seller_city, seller_state, geo_city, geo_state")
model_query("D3_dim_product", "dim_product",
            "product_key, product_id, product_category_name, product_name_length, product_description_length, "
            "product_photos_qty, product_volume_cm3, product_weight_kg, photo_category")
model_query("D4_dim_geography", "dim_geography", "geo_key, geolocation_zip_code_prefix, city, state")
model_query("D5_dim_payment_type", "dim_payment_type", "payment_type_key, payment_type")

# ---- E: facts ----
model_query("E1_fact_order_items", "fact_order_items",
            "order_item_key, order_id, order_item_id, customer_key, seller_key, product_key, d:purchase_date, "
            "d:delivered_date, m:price, m:freight_value, m:total_item_value")
model_query("E2_fact_orders_accumulating", "fact_orders_accumulating",
            "order_id, customer_id, order_status, t:purchase_date, t:approved_date, t:carrier_date, "
            "t:delivered_date, t:estimated_date, purchase_to_approve_days, approve_to_ship_days, "
            "ship_to_deliver_days, on_time_flag, t:processed_at")
model_query("E3_fact_payments", "fact_payments",
            "order_id, payment_sequential, payment_type_key, m:payment_value, payment_installments, installment_value")
model_query("E4_fact_reviews", "fact_reviews",
            "review_key, review_id, order_id, review_score, review_sentiment, review_creation_date, "
            "review_answer_timestamp, has_comment")


def queries() -> dict[str, Builder]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load_all() -> None:
    # Importing these modules registers their queries.
    from . import (catalog_adhoc, catalog_history, catalog_ingest, catalog_live, catalog_marts,  # noqa: F401
                   catalog_quality, catalog_retrieval, catalog_streaming, declared_tests)
