"""Registered queries: data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as H
from .catalog import register
from .models import Warehouse
from .oracle import enc, with_ctes

# Fixed accepted order statuses of the staging tests.
STATUSES = ["delivered", "shipped", "canceled", "processing", "invoiced", "created", "approved", "unavailable"]
STATUS_SQL = ", ".join(f"'{s}'" for s in STATUSES)


@register("H1_dq_unique", with_ctes(
    """SELECT review_id, count(*) AS n_records FROM stg_order_reviews WHERE review_id IS NOT NULL
       GROUP BY review_id HAVING count(*) > 1"""))
def q_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id values seen more than once (the fixture repeats some)."""
    return H.dq_unique(Warehouse(spark, sf_dir).stg_order_reviews, "review_id")


@register("H2_dq_not_null", with_ctes(
    """SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state
       FROM stg_customers WHERE customer_zip_code_prefix IS NULL"""))
def q_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.dq_not_null(Warehouse(spark, sf_dir).stg_customers, "customer_zip_code_prefix")


@register("H3_dq_accepted_values", with_ctes(
    """SELECT product_id, product_category_name FROM raw_products
       WHERE product_category_name IS NOT NULL
         AND product_category_name NOT IN ('standard', 'medium', 'large', 'small', 'economy')"""))
def q_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw category names outside the translated list (the untranslated ones)."""
    p = Warehouse(spark, sf_dir).stg_products.select("product_id", "product_category_name")
    return H.dq_accepted_values(p, "product_category_name", ["standard", "medium", "large", "small", "economy"])


@register("H3_dq_accepted_values_order_status", with_ctes(
    f"""SELECT order_id, order_status FROM stg_orders
        WHERE order_status IS NOT NULL AND order_status NOT IN ({STATUS_SQL})"""))
def q_accepted_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared order-status list (passes: no rows)."""
    o = Warehouse(spark, sf_dir).stg_orders.select("order_id", "order_status")
    return H.dq_accepted_values(o, "order_status", STATUSES)


@register("H4_dq_relationships", with_ctes(
    """SELECT c.customer_id, c.customer_zip_code_prefix FROM stg_customers c
       WHERE c.customer_zip_code_prefix IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM dim_geography g
                         WHERE g.geolocation_zip_code_prefix = c.customer_zip_code_prefix)"""))
def q_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose zip prefix has no geography row."""
    w = Warehouse(spark, sf_dir)
    c = w.stg_customers.select("customer_id", "customer_zip_code_prefix")
    return H.dq_relationships(c, "customer_zip_code_prefix", w.dim_geography, "geolocation_zip_code_prefix")


@register("H5_dq_accepted_range", with_ctes(
    f"""SELECT {enc('order_id, t:carrier_date, t:delivered_date, ship_to_deliver_days')}
        FROM fact_orders_accumulating WHERE ship_to_deliver_days IS NOT NULL AND ship_to_deliver_days < 0"""))
def q_accepted_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose carrier-to-delivery lag is negative (min 0)."""
    f = Warehouse(spark, sf_dir).fact_orders_accumulating.select(
        "order_id", "carrier_date", "delivered_date", "ship_to_deliver_days")
    return H.dq_accepted_range(f, "ship_to_deliver_days", min_value=0)


@register("H6_dq_valid_order_dates", with_ctes(
    f"""SELECT {enc('order_id, t:purchase_date, t:delivered_date')} FROM fact_orders_accumulating
        WHERE delivered_date < purchase_date"""))
def q_valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.dq_valid_order_dates(Warehouse(spark, sf_dir).fact_orders_accumulating)


@register("H7_dq_positive_revenue", with_ctes(
    """SELECT fp.order_id, CAST(sum(fp.payment_value) AS DOUBLE) AS total_revenue
       FROM fact_payments fp JOIN fact_orders_accumulating fo ON fp.order_id = fo.order_id
       WHERE fo.order_status = 'delivered' GROUP BY fp.order_id HAVING sum(fp.payment_value) <= 0"""))
def q_positive_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return H.dq_positive_revenue(w.fact_orders_accumulating, w.fact_payments)


@register("H8_dq_pk_check", with_ctes(
    """SELECT total_rows, distinct_keys, null_keys, total_rows - distinct_keys AS duplicate_rows,
         CASE WHEN total_rows > 0 THEN round((total_rows - null_keys) / total_rows, 6) ELSE 1.0 END AS not_null_ratio,
         total_rows = distinct_keys AS unique_ok,
         (CASE WHEN total_rows > 0 THEN round((total_rows - null_keys) / total_rows, 6) ELSE 1.0 END) >= 1.0
           AS not_null_ok
       FROM (SELECT count(*) AS total_rows, count(DISTINCT (review_id, order_id)) AS distinct_keys,
               count(*) FILTER (WHERE review_id IS NULL OR order_id IS NULL) AS null_keys FROM stg_order_reviews)"""))
def q_pk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary key (review_id, order_id) of the reviews."""
    return H.dq_pk_check(Warehouse(spark, sf_dir).stg_order_reviews, ["review_id", "order_id"])


@register("H9_dq_rowcount_drop", with_ctes(
    """SELECT cur AS current_rows, prev AS previous_rows,
         CASE WHEN prev > 0 THEN round(cur / prev, 6) END AS ratio,
         coalesce(CASE WHEN prev > 0 THEN round(cur / prev, 6) END, 1.0) >= 0.95 AS passed
       FROM (SELECT (SELECT count(*) FROM raw_orders WHERE order_status <> 'processing') AS cur,
                    (SELECT count(*) FROM raw_orders) AS prev)"""))
def q_rowcount_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that lost the processing orders against the full previous load."""
    o = Warehouse(spark, sf_dir).raw.orders
    return H.dq_rowcount_drop(o.filter(F.col("order_status") != "processing"), o)


@register("H10_dq_quality_score", with_ctes(
    """SELECT total_records, null_records, duplicate_records,
         total_records - null_records - duplicate_records AS valid_records,
         CASE WHEN total_records > 0
              THEN round((total_records - null_records - duplicate_records) * 100.0 / total_records, 2)
              ELSE 0.0 END AS quality_score,
         CASE WHEN total_records > 0
              THEN round((total_records - null_records - duplicate_records) * 100.0 / total_records, 2)
              ELSE 0.0 END < 95 AS quality_issue
       FROM (SELECT count(*) AS total_records,
               count(*) FILTER (WHERE review_id IS NULL OR order_id IS NULL OR review_comment_message IS NULL)
                 AS null_records,
               count(*) - count(DISTINCT review_id) AS duplicate_records FROM raw_reviews)"""))
def q_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Warehouse(spark, sf_dir).raw.order_reviews
    return H.dq_quality_score(r, ["review_id"], ["review_id", "order_id", "review_comment_message"])


# Fixed event type enumeration checked on the event stream.
ENUM_EVENT_TYPES = ["signup", "click", "view", "purchase"]


@register("H11_dq_check_enum", f"""
    SELECT 'event_type' AS check_column, event_type AS bad_value, event_id, user_id, event_type
    FROM events WHERE event_type IS NOT NULL AND event_type NOT IN ('signup', 'click', 'view', 'purchase')""")
def q_check_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CHECK-style enumeration of the event stream's type."""
    from ..sources.tables import read_table
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return H.dq_check_enum(e, {"event_type": ENUM_EVENT_TYPES})


def _suite_sql() -> str:
    parts = [
        "SELECT 'not_null_freight_value' AS test_name, count(*) FILTER (WHERE freight_value IS NULL) AS failures FROM fact_order_items",
        "SELECT 'not_null_total_item_value', count(*) FILTER (WHERE total_item_value IS NULL) FROM fact_order_items",
        "SELECT 'not_null_price', count(*) FILTER (WHERE price IS NULL) FROM fact_order_items",
        "SELECT 'not_null_order_item_key', count(*) FILTER (WHERE order_item_key IS NULL) FROM fact_order_items",
        "SELECT 'accepted_range_freight_value', count(*) FILTER (WHERE freight_value < 0) FROM fact_order_items",
        "SELECT 'accepted_range_total_item_value', count(*) FILTER (WHERE total_item_value < 0) FROM fact_order_items",
        "SELECT 'accepted_range_price', count(*) FILTER (WHERE price < 0) FROM fact_order_items",
        "SELECT 'unique_order_item_key', count(*) FROM (SELECT order_item_key FROM fact_order_items "
        "WHERE order_item_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
    ]
    for col, dim in (("customer_key", "dim_customer"), ("seller_key", "dim_seller"), ("product_key", "dim_product")):
        parts.append(f"SELECT 'relationships_{col}', count(*) FROM fact_order_items f WHERE f.{col} IS NOT NULL "
                     f"AND NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{col} = f.{col})")
    body = " UNION ALL ".join(parts)
    return with_ctes(f"""SELECT 'fact_order_items' AS model, test_name, CAST(failures AS BIGINT) AS failures,
        CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({body})""")


@register("H12_dq_suite", _suite_sql())
def q_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declared tests of fact_order_items in one result table."""
    w = Warehouse(spark, sf_dir)
    w.store_items()
    T = H.Test
    tests = [T("not_null", "freight_value"), T("not_null", "total_item_value"), T("not_null", "price"),
             T("not_null", "order_item_key"),
             T("accepted_range", "freight_value", min_value=0), T("accepted_range", "total_item_value", min_value=0),
             T("accepted_range", "price", min_value=0), T("unique", "order_item_key"),
             T("relationships", "customer_key", parent=w.dim_customer, parent_key="customer_key"),
             T("relationships", "seller_key", parent=w.dim_seller, parent_key="seller_key"),
             T("relationships", "product_key", parent=w.dim_product, parent_key="product_key")]
    # Each test reads only the columns it needs of the rows that are written here.
    return H.dq_suite("fact_order_items", w.fact_order_items, tests)
