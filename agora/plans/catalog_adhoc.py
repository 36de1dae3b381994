"""Registered queries: ad-hoc questions (Q1-Q9, Q11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adhoc as Q
from ..operators import dimensions as D
from ..sources.tables import read_table
from .catalog import register
from .models import Warehouse
from .oracle import avg6, enc, ratio6, with_ctes


@register("Q1_top_categories_by_revenue", with_ctes(f"""SELECT product_category_name,
    CAST(total_revenue AS DOUBLE) AS total_revenue, order_count, avg_price FROM (
    SELECT p.product_category_name, sum(f.total_item_value) AS total_revenue,
      count(DISTINCT f.order_id) AS order_count, {avg6('f.price')} AS avg_price
    FROM fact_order_items f JOIN dim_product p ON f.product_key = p.product_key
    GROUP BY 1 ORDER BY total_revenue DESC, product_category_name NULLS LAST LIMIT 10)"""))
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return Q.top_categories_by_revenue(w.fact_order_items, w.dim_product)


@register("Q2_delivery_time_by_state", with_ctes(f"""SELECT c.customer_state,
    {avg6("CAST(date_diff('day', CAST(o.purchase_date AS DATE), CAST(o.delivered_date AS DATE)) AS INT)")}
      AS avg_delivery_days, count(*) AS order_count
    FROM fact_orders_accumulating o JOIN dim_customer c ON o.customer_id = c.customer_id
    WHERE o.order_status = 'delivered' GROUP BY 1"""))
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return Q.delivery_time_by_state(w.fact_orders_accumulating, w.dim_customer)


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    bounds = o.agg(F.trunc(F.min("o_orderdate"), "year").alias("start_date"),
                   F.add_months(F.trunc(F.max("o_orderdate"), "year"), 12).alias("end_date"))
    return D.dim_date(bounds)


@register("Q3_monthly_revenue_trend", with_ctes("""SELECT CAST(year(f.purchase_date) AS INT) AS year,
    CAST(month(f.purchase_date) AS INT) AS month, monthname(f.purchase_date) AS month_name,
    CAST(sum(f.total_item_value) AS DOUBLE) AS monthly_revenue, count(DISTINCT f.order_id) AS order_count
    FROM fact_order_items f GROUP BY 1, 2, 3"""))
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return Q.monthly_revenue_trend(w.fact_order_items, _calendar(spark, sf_dir))


@register("Q4_payment_distribution", with_ctes(f"""SELECT pt.payment_type, count(*) AS payment_count,
    CAST(sum(fp.payment_value) AS DOUBLE) AS total_value, {avg6('fp.payment_installments')} AS avg_installments
    FROM fact_payments fp JOIN dim_payment_type pt ON fp.payment_type_key = pt.payment_type_key GROUP BY 1"""))
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return Q.payment_distribution(w.fact_payments, w.dim_payment_type)


@register("Q5_payment_share", with_ctes(f"""SELECT payment_type, payment_count, CAST(total_value AS DOUBLE) AS total_value,
    CAST(value_in_installments AS DOUBLE) AS value_in_installments,
    CAST(value_single_payment AS DOUBLE) AS value_single_payment,
    {ratio6('payment_count', 'sum(payment_count) OVER ()')} AS payment_share FROM (
    SELECT pt.payment_type, count(*) AS payment_count, sum(fp.payment_value) AS total_value,
      sum(CASE WHEN fp.payment_installments > 1 THEN fp.payment_value END) AS value_in_installments,
      sum(CASE WHEN NOT (fp.payment_installments > 1) THEN fp.payment_value END) AS value_single_payment
    FROM fact_payments fp JOIN dim_payment_type pt ON fp.payment_type_key = pt.payment_type_key GROUP BY 1)"""))
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return Q.payment_share(w.fact_payments, w.dim_payment_type)


@register("Q6_seller_revenue_rank", with_ctes("""SELECT t.seller_key, CAST(t.total_revenue AS DOUBLE) AS total_revenue,
    t.order_count, s.seller_id, s.seller_state FROM (
      SELECT seller_key, sum(total_item_value) AS total_revenue, count(DISTINCT order_id) AS order_count
      FROM fact_order_items GROUP BY 1 ORDER BY total_revenue DESC, seller_key LIMIT 10) t
    JOIN dim_seller s ON t.seller_key = s.seller_key"""))
def q6a(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return Q.seller_revenue_rank(w.fact_order_items, w.dim_seller)


@register("Q6_lowest_rated_sellers", with_ctes(f"""SELECT t.seller_key, t.avg_review_score, t.review_count,
    s.seller_id, s.seller_state FROM (
      SELECT f.seller_key, {avg6('r.review_score')} AS avg_review_score, count(*) AS review_count
      FROM fact_order_items f JOIN fact_reviews r ON f.order_id = r.order_id
      GROUP BY 1 ORDER BY avg_review_score, seller_key LIMIT 10) t
    JOIN dim_seller s ON t.seller_key = s.seller_key"""))
def q6b(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return Q.lowest_rated_sellers(w.fact_order_items, w.fact_reviews, w.dim_seller)


@register("Q7_review_by_category", with_ctes(f"""SELECT p.product_category_name,
    {avg6('r.review_score')} AS avg_review_score, count(*) AS review_count
    FROM fact_order_items f JOIN fact_reviews r ON f.order_id = r.order_id
    JOIN dim_product p ON f.product_key = p.product_key GROUP BY 1"""))
def q7a(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return Q.review_by_category(w.fact_order_items, w.fact_reviews, w.dim_product)


@register("Q7_score_by_delivery_delay", with_ctes(f"""SELECT CASE WHEN d IS NULL THEN 'not_delivered'
      WHEN d < 0 THEN 'early' WHEN d = 0 THEN 'on_time' WHEN d <= 7 THEN 'late_1_7_days'
      ELSE 'late_8_plus_days' END AS delay_bucket,
    {avg6('review_score')} AS avg_review_score, count(*) AS review_count
    FROM (SELECT r.review_score,
            CAST(date_diff('day', CAST(o.estimated_date AS DATE), CAST(o.delivered_date AS DATE)) AS INT) AS d
          FROM fact_reviews r JOIN fact_orders_accumulating o ON r.order_id = o.order_id) GROUP BY 1"""))
def q7b(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    return Q.score_by_delivery_delay(w.fact_orders_accumulating, w.fact_reviews)


@register("Q8_delayed_orders", with_ctes(f"""SELECT *, {ratio6('delayed_orders', 'delivered_orders')} AS delayed_share,
    {ratio6('approved_orders', 'total_orders')} AS approval_rate FROM (
    SELECT count(*) AS total_orders, count(*) FILTER (WHERE delivered_date IS NOT NULL) AS delivered_orders,
      count(*) FILTER (WHERE delivered_date IS NOT NULL AND delivered_date > estimated_date) AS delayed_orders,
      count(*) FILTER (WHERE approved_date IS NOT NULL) AS approved_orders
    FROM fact_orders_accumulating)"""))
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.delayed_orders(Warehouse(spark, sf_dir).fact_orders_accumulating)


@register("Q9_latest_rows", f"""SELECT event_id, {enc('t:ts')}, user_id, event_type, value
    FROM events ORDER BY ts DESC, event_id DESC LIMIT 10""")
def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 10 events of the stream table."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return Q.latest_rows(e, "ts", 10, tie="event_id")


@register("Q11_bounded_sql", """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analyst's SQL over the orders table with a 100-row cap."""
    read_table(spark, sf_dir, "orders").createOrReplaceTempView("agora_orders")
    return Q.bounded_sql(spark, """SELECT o_orderkey, o_totalprice FROM agora_orders
        WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey""", max_rows=100)
