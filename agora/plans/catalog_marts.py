"""Registered queries: calendars (D6, D7), marts (F1-F3), segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import customer_segment
from ..operators import dimensions as D
from ..sources.tables import read_table
from .catalog import register
from .models import Warehouse
from .oracle import avg6, enc, ratio6, sk, with_ctes

SPINE_SQL_COLS = """d AS date_day, CAST(date_trunc('week', d) AS DATE) AS week_start,
  CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(date_trunc('quarter', d) AS DATE) AS quarter_start,
  CAST(date_trunc('year', d) AS DATE) AS year_start, CAST(year(d) AS INT) AS year_number,
  CAST(quarter(d) AS INT) AS quarter_number, CAST(month(d) AS INT) AS month_number,
  CAST(day(d) AS INT) AS day_of_month, CAST(dayofweek(d) AS INT) AS day_of_week,
  CAST(dayofyear(d) AS INT) AS day_of_year, dayofweek(d) IN (0, 6) AS is_weekend"""
SPINE_SPEC = ("d:date_day, d:week_start, d:month_start, d:quarter_start, d:year_start, year_number, "
              "quarter_number, month_number, day_of_month, day_of_week, day_of_year, is_weekend")


def _spine_sql(bounds: str) -> str:
    return f"""WITH b AS ({bounds}),
  days AS (SELECT CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d
           FROM b),
  spine AS (SELECT {SPINE_SQL_COLS} FROM days)
  SELECT {enc(SPINE_SPEC)} FROM spine"""


@register("D6_dim_date", _spine_sql(
    """SELECT CAST(date_trunc('year', min(o_orderdate)) AS DATE) AS start_date,
              CAST(date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR AS DATE) AS end_date FROM orders"""))
def q_dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar over whole years covering the order dates (end exclusive)."""
    o = read_table(spark, sf_dir, "orders")
    bounds = o.agg(F.trunc(F.min("o_orderdate"), "year").alias("start_date"),
                   F.add_months(F.trunc(F.max("o_orderdate"), "year"), 12).alias("end_date"))
    return D.dim_date(bounds)


@register("D7_date_spine", _spine_sql(
    """SELECT CAST(min(o_orderdate) AS DATE) AS start_date,
              CAST(CAST(max(o_orderdate) AS DATE) + INTERVAL 60 DAY AS DATE) AS end_date FROM orders"""))
def q_date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day spine from the first order day to 60 days after the last one."""
    o = read_table(spark, sf_dir, "orders")
    bounds = o.agg(F.to_date(F.min("o_orderdate")).alias("start_date"),
                   F.date_add(F.to_date(F.max("o_orderdate")), 60).alias("end_date"))
    return D.date_spine(bounds)


F1_BODY = f"""SELECT dc.customer_state, ds.seller_state, dp.product_category_name,
  CAST(date_trunc('month', fi.purchase_date) AS DATE) AS order_month,
  count(DISTINCT o.order_id) AS total_orders, count(DISTINCT fi.customer_key) AS unique_customers,
  count(DISTINCT fi.seller_key) AS unique_sellers, count(*) AS total_items_sold,
  sum(fi.price) AS gross_merchandise_value, sum(fi.freight_value) AS total_freight_revenue,
  sum(fi.total_item_value) AS total_revenue,
  {avg6('fi.price')} AS avg_item_price, {avg6('fi.total_item_value')} AS avg_order_value,
  {avg6('o.purchase_to_approve_days')} AS avg_approval_time_days,
  {avg6('o.ship_to_deliver_days')} AS avg_delivery_time_days,
  {ratio6('sum(o.on_time_flag)', 'count(o.order_id)')} AS on_time_delivery_rate,
  {avg6('r.review_score')} AS avg_review_score,
  {ratio6('count(CASE WHEN r.review_score >= 4 THEN 1 END)', 'count(r.review_score)')} AS positive_review_rate
  FROM fact_order_items fi
  JOIN dim_customer dc ON fi.customer_key = dc.customer_key
  JOIN dim_seller ds ON fi.seller_key = ds.seller_key
  JOIN dim_product dp ON fi.product_key = dp.product_key
  JOIN fact_orders_accumulating o ON {{cond}}
  LEFT JOIN fact_reviews r ON o.order_id = r.order_id
  GROUP BY 1, 2, 3, 4"""
F1_SPEC = ("customer_state, seller_state, product_category_name, d:order_month, total_orders, unique_customers, "
           "unique_sellers, total_items_sold, m:gross_merchandise_value, m:total_freight_revenue, m:total_revenue, "
           "avg_item_price, avg_order_value, avg_approval_time_days, avg_delivery_time_days, "
           "on_time_delivery_rate, avg_review_score, positive_review_rate")


def _f1_sql(cond: str) -> str:
    return with_ctes(f"SELECT {enc(F1_SPEC)} FROM ({F1_BODY.replace('{cond}', cond)})")


@register("F1_mart_sales_metrics", _f1_sql("fi.order_id = o.order_id"))
def q_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales metrics with items joined to their own order."""
    return Warehouse(spark, sf_dir).mart_sales_metrics()


@register("F1_mart_sales_metrics_as_written",
          _f1_sql(f"fi.customer_key = {sk('o.customer_id')} AND fi.purchase_date = o.purchase_date"))
def q_sales_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original customer-key + DATE = TIMESTAMP join (midnight orders only)."""
    return Warehouse(spark, sf_dir).mart_sales_metrics(as_written=True)


F1_DEDUPE = F1_BODY.replace("{cond}", "fi.order_id = o.order_id").replace("LEFT JOIN fact_reviews r ON", """LEFT JOIN (SELECT order_id,
    sum(review_score) AS s_sum, count(review_score) AS s_n, count(CASE WHEN review_score >= 4 THEN 1 END) AS s_pos
    FROM fact_reviews GROUP BY 1) r ON""").replace(avg6("r.review_score"), ratio6("sum(r.s_sum)", "sum(r.s_n)")).replace(
    ratio6("count(CASE WHEN r.review_score >= 4 THEN 1 END)", "count(r.review_score)"), ratio6("sum(r.s_pos)", "sum(r.s_n)"))


@register("F1_mart_sales_metrics_dedupe", with_ctes(f"SELECT {enc(F1_SPEC)} FROM ({F1_DEDUPE})"))
def q_sales_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales metrics in which several reviews of an order don't multiply its items."""
    return Warehouse(spark, sf_dir).mart_sales_metrics(dedupe_reviews=True)


SEGMENT_SQL = """CASE WHEN {o} >= 10 AND {r} >= 5000 THEN 'VIP' WHEN {o} >= 5 AND {r} >= 2000 THEN 'Premium'
  WHEN {o} >= 2 AND {r} >= 500 THEN 'Regular' ELSE 'New' END"""

F2_SQL = with_ctes(f"""SELECT {enc('customer_key, customer_id, customer_state, customer_city, d:first_order_date, '
  'd:last_order_date, customer_tenure_days, total_orders, total_items_purchased, m:customer_lifetime_value, '
  'avg_order_value, revenue_per_order, total_reviews, avg_review_score, customer_segment, recency_days, '
  'frequency_score, m:monetary_value')} FROM (
  SELECT cd.customer_key, cd.customer_id, cd.customer_state, cd.customer_city, co.first_order_date,
    co.last_order_date, CAST(date_diff('day', co.first_order_date, co.last_order_date) AS INT) AS customer_tenure_days,
    co.total_orders, co.total_items_purchased, co.lifetime_value AS customer_lifetime_value, co.avg_order_value,
    {ratio6('co.lifetime_value', 'co.total_orders')} AS revenue_per_order,
    cr.total_reviews, cr.avg_review_score,
    {SEGMENT_SQL.format(o='co.total_orders', r='co.lifetime_value')} AS customer_segment,
    CAST(date_diff('day', co.last_order_date, DATE '2002-01-01') AS INT) AS recency_days,
    co.total_orders AS frequency_score, co.lifetime_value AS monetary_value
  FROM dim_customer cd
  JOIN (SELECT customer_key, min(purchase_date) AS first_order_date, max(purchase_date) AS last_order_date,
          count(DISTINCT order_id) AS total_orders, count(*) AS total_items_purchased,
          sum(total_item_value) AS lifetime_value, {avg6('total_item_value')} AS avg_order_value
        FROM fact_order_items GROUP BY 1) co ON cd.customer_key = co.customer_key
  LEFT JOIN (SELECT {sk('o.customer_id')} AS customer_key, {avg6('r.review_score')} AS avg_review_score,
          count(r.order_id) AS total_reviews
        FROM fact_reviews r JOIN fact_orders_accumulating o ON r.order_id = o.order_id GROUP BY 1) cr
    ON cd.customer_key = cr.customer_key)""")


@register("F2_mart_customer_metrics", F2_SQL)
def q_customer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Warehouse(spark, sf_dir).mart_customer_metrics


F3_SQL = with_ctes(f"""SELECT {enc('product_key, product_id, product_category_name, product_weight_kg, '
  'product_volume_cm3, product_photos_qty, orders_containing_product, total_units_sold, m:total_sales_revenue, '
  'avg_selling_price, m:total_freight_charged, d:first_sale_date, d:last_sale_date, avg_product_rating, '
  'total_reviews, positive_reviews, product_lifespan_days, days_since_last_sale, positive_review_rate, '
  'sales_tier, quality_tier')} FROM (
  SELECT pd.product_key, pd.product_id, pd.product_category_name, pd.product_weight_kg, pd.product_volume_cm3,
    pd.product_photos_qty, ps.orders_containing_product, ps.total_units_sold, ps.total_sales_revenue,
    ps.avg_selling_price, ps.total_freight_charged, ps.first_sale_date, ps.last_sale_date,
    pr.avg_product_rating, pr.total_reviews, pr.positive_reviews,
    CAST(date_diff('day', ps.first_sale_date, ps.last_sale_date) AS INT) AS product_lifespan_days,
    CAST(date_diff('day', ps.last_sale_date, DATE '2002-01-01') AS INT) AS days_since_last_sale,
    {ratio6('pr.positive_reviews', 'pr.total_reviews')} AS positive_review_rate,
    CASE WHEN ps.total_units_sold >= 100 THEN 'Top Seller' WHEN ps.total_units_sold >= 50 THEN 'Popular'
         WHEN ps.total_units_sold >= 10 THEN 'Moderate' ELSE 'Low Volume' END AS sales_tier,
    CASE WHEN pr.avg_product_rating >= 4.5 THEN 'Excellent' WHEN pr.avg_product_rating >= 4.0 THEN 'Good'
         WHEN pr.avg_product_rating >= 3.0 THEN 'Average' ELSE 'Below Average' END AS quality_tier
  FROM dim_product pd
  JOIN (SELECT product_key, count(DISTINCT order_id) AS orders_containing_product, count(*) AS total_units_sold,
          sum(price) AS total_sales_revenue, sum(freight_value) AS total_freight_charged,
          {avg6('price')} AS avg_selling_price, min(purchase_date) AS first_sale_date,
          max(purchase_date) AS last_sale_date
        FROM fact_order_items GROUP BY 1) ps ON pd.product_key = ps.product_key
  LEFT JOIN (SELECT fi.product_key, {avg6('r.review_score')} AS avg_product_rating,
          count(r.order_id) AS total_reviews, count(CASE WHEN r.review_score >= 4 THEN 1 END) AS positive_reviews
        FROM fact_order_items fi JOIN fact_reviews r ON fi.order_id = r.order_id GROUP BY 1) pr
    ON pd.product_key = pr.product_key)""")


@register("F3_mart_product_metrics", F3_SQL)
def q_product_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Warehouse(spark, sf_dir).mart_product_metrics


F4_SQL = with_ctes(f"""SELECT customer_key, total_orders, CAST(revenue AS DOUBLE) AS revenue,
  {SEGMENT_SQL.format(o='total_orders', r='revenue')} AS customer_segment
  FROM (SELECT customer_key, count(DISTINCT order_id) AS total_orders, sum(total_item_value) AS revenue
        FROM fact_order_items GROUP BY 1)""")


@register("F4_customer_segment", F4_SQL)
def q_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment expression applied to per-customer order count and revenue."""
    fi = Warehouse(spark, sf_dir).fact_order_items
    per = fi.groupBy("customer_key").agg(F.count_distinct("order_id").alias("total_orders"),
                                         F.sum("total_item_value").alias("revenue"))
    return per.select("customer_key", "total_orders", "revenue",
                      customer_segment("total_orders", "revenue").alias("customer_segment"))
