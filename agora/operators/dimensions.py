"""Dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import surrogate_key
from ..functions.dates import day_of_week_sunday0
from .intermediate import geo_by_zip


def dim_customer(int_customers: DataFrame) -> DataFrame:
    return int_customers.select(
        surrogate_key("customer_id").alias("customer_key"), "customer_id", "customer_unique_id",
        "customer_zip_code_prefix", "customer_city", "customer_state", "geo_city", "geo_state")


def dim_seller(int_sellers: DataFrame) -> DataFrame:
    return int_sellers.select(
        surrogate_key("seller_id").alias("seller_key"), "seller_id", "seller_zip_code_prefix",
        "seller_city", "seller_state", "geo_city", "geo_state")


def dim_product(int_products: DataFrame) -> DataFrame:
    return int_products.select(
        surrogate_key("product_id").alias("product_key"), "product_id", "product_category_name",
        "product_name_length", "product_description_length", "product_photos_qty",
        "product_volume_cm3", "product_weight_kg", "photo_category")


def dim_geography(stg_geo: DataFrame) -> DataFrame:
    g = geo_by_zip(stg_geo, "city", "state")
    return g.select(surrogate_key("geolocation_zip_code_prefix").alias("geo_key"),
                    "geolocation_zip_code_prefix", "city", "state")


def dim_payment_type(stg_payments: DataFrame) -> DataFrame:
    t = stg_payments.select("payment_type").distinct()
    return t.select(surrogate_key("payment_type").alias("payment_type_key"), "payment_type")


def _spine_columns(d: Column) -> list[Column]:
    dow = day_of_week_sunday0(d)
    return [
        d.alias("date_day"),
        F.date_trunc("week", d).cast("date").alias("week_start"),
        F.trunc(d, "month").alias("month_start"),
        F.date_trunc("quarter", d).cast("date").alias("quarter_start"),
        F.trunc(d, "year").alias("year_start"),
        F.year(d).alias("year_number"),
        F.quarter(d).alias("quarter_number"),
        F.month(d).alias("month_number"),
        F.dayofmonth(d).alias("day_of_month"),
        dow.alias("day_of_week"),
        F.dayofyear(d).alias("day_of_year"),
        dow.isin(0, 6).alias("is_weekend"),
    ]


def date_spine(bounds: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """One row per day in [start, end) for every row of ``bounds``.

    ``bounds`` carries the range as data (e.g. derived from the fact table), so
    the spine is produced by a generator on the executors, not the driver.
    """
    days = bounds.select(F.explode(F.sequence(
        F.col(start).cast("date"), F.date_sub(F.col(end).cast("date"), 1))).alias("d"))
    return days.select(*_spine_columns(F.col("d")))


def dim_date(spark_or_bounds, start_date: str = "2016-01-01", end_date: str = "2020-12-31") -> DataFrame:
    """Calendar with an exclusive end: the default variables 2016-01-01 and
    2020-12-31 give 1,826 days, the last one 2020-12-30."""
    if isinstance(spark_or_bounds, DataFrame):
        return date_spine(spark_or_bounds)
    bounds = spark_or_bounds.range(1).select(
        F.lit(start_date).cast("date").alias("start_date"), F.lit(end_date).cast("date").alias("end_date"))
    return date_spine(bounds)
