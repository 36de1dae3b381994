"""Ad-hoc analytic questions over the star schema (Q1-Q11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import day_diff
from ..plans.strategy import bounded_broadcast
from .marts import avg6, ratio6


def top_categories_by_revenue(fact_items: DataFrame, dim_product: DataFrame, k: int = 10) -> DataFrame:
    """Q1: revenue, orders and average price per category, top ``k`` by revenue.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps
    its own top ``k`` and only those rows reach the final merge.
    """
    j = fact_items.join(bounded_broadcast(dim_product.select("product_key", "product_category_name")), "product_key")
    g = j.groupBy("product_category_name").agg(
        F.sum("total_item_value").alias("total_revenue"),
        F.count_distinct("order_id").alias("order_count"),
        avg6("price").alias("avg_price"))
    return g.orderBy(F.desc("total_revenue"), F.asc_nulls_last("product_category_name")).limit(k)


def delivery_time_by_state(fact_orders: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Q2: average purchase-to-delivery days and delivered orders per customer state."""
    o = (fact_orders.filter(F.col("order_status") == "delivered")
         .select("customer_id", day_diff("purchase_date", "delivered_date").alias("days_to_deliver")))
    j = o.join(dim_customer.select("customer_id", "customer_state"), "customer_id")
    return (j.groupBy("customer_state")
            .agg(avg6("days_to_deliver").alias("avg_delivery_days"), F.count(F.lit(1)).alias("order_count"))
            .orderBy(F.desc("avg_delivery_days")))


def monthly_revenue_trend(fact_items: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Q3: revenue and orders per calendar month through the date dimension."""
    d = dim_date.select(F.col("date_day").alias("purchase_date"), F.col("year_number").alias("year"),
                        F.col("month_number").alias("month"),
                        F.date_format("date_day", "MMMM").alias("month_name"))
    # One row per calendar day: broadcast after the size check.
    j = fact_items.join(bounded_broadcast(d), "purchase_date")
    return (j.groupBy("year", "month", "month_name")
            .agg(F.sum("total_item_value").alias("monthly_revenue"),
                 F.count_distinct("order_id").alias("order_count"))
            .orderBy("year", "month"))


def by_payment_type(fact_payments: DataFrame, dim_payment_type: DataFrame, **sums: Column) -> DataFrame:
    """Sums per payment type: payments are added up per key first, so that only a row per key
    and task, and not every payment, goes to one of five places."""
    keyed = fact_payments.groupBy("payment_type_key").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return (keyed.join(dim_payment_type, "payment_type_key").groupBy("payment_type")
            .agg(*[F.sum(n).alias(n) for n in sums]))


def payment_distribution(fact_payments: DataFrame, dim_payment_type: DataFrame) -> DataFrame:
    """Q4: count, value and average installments per payment type."""
    n = F.col("payment_installments")
    g = by_payment_type(fact_payments, dim_payment_type, payment_count=F.lit(1), total_value=F.col("payment_value"),
                        _sum=n, _n=n.isNotNull().cast("long"))
    return (g.select("payment_type", "payment_count", "total_value", ratio6(F.col("_sum"), F.col("_n")).alias("avg_installments"))
            .orderBy(F.desc("total_value")))


def payment_share(fact_payments: DataFrame, dim_payment_type: DataFrame) -> DataFrame:
    """Q5: share of payments per type and value paid in installments vs at once.

    The grand total is a window over the (few) per-type rows, not the facts.
    """
    inst, value = F.col("payment_installments") > 1, F.col("payment_value")
    g = by_payment_type(fact_payments, dim_payment_type, payment_count=F.lit(1), total_value=value,
                        value_in_installments=F.when(inst, value), value_single_payment=F.when(~inst, value))
    total = F.sum("payment_count").over(Window.partitionBy())
    return g.withColumn("payment_share", ratio6(F.col("payment_count"), total))


def seller_revenue_rank(fact_items: DataFrame, dim_seller: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` sellers by revenue."""
    g = fact_items.groupBy("seller_key").agg(F.sum("total_item_value").alias("total_revenue"),
                                             F.count_distinct("order_id").alias("order_count"))
    top = g.orderBy(F.desc("total_revenue"), "seller_key").limit(k)
    return top.join(dim_seller.select("seller_key", "seller_id", "seller_state"), "seller_key")


def lowest_rated_sellers(fact_items: DataFrame, fact_reviews: DataFrame, dim_seller: DataFrame,
                         k: int = 10) -> DataFrame:
    """``k`` sellers with the lowest average review score of their order lines."""
    j = fact_items.select("seller_key", "order_id").join(fact_reviews.select("order_id", "review_score"),
                                                         "order_id")
    g = j.groupBy("seller_key").agg(avg6("review_score").alias("avg_review_score"),
                                    F.count(F.lit(1)).alias("review_count"))
    low = g.orderBy("avg_review_score", "seller_key").limit(k)
    return low.join(dim_seller.select("seller_key", "seller_id", "seller_state"), "seller_key")


def review_by_category(fact_items: DataFrame, fact_reviews: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Average review score per product category (per order line)."""
    j = (fact_items.select("product_key", "order_id")
         .join(fact_reviews.select("order_id", "review_score"), "order_id")
         .join(bounded_broadcast(dim_product.select("product_key", "product_category_name")), "product_key"))
    return j.groupBy("product_category_name").agg(avg6("review_score").alias("avg_review_score"),
                                                  F.count(F.lit(1)).alias("review_count"))


def delay_bucket(delay_days) -> F.Column:
    d = F.col(delay_days) if isinstance(delay_days, str) else delay_days
    return (F.when(d.isNull(), "not_delivered").when(d < 0, "early").when(d == 0, "on_time")
            .when(d <= 7, "late_1_7_days").otherwise("late_8_plus_days"))


def score_by_delivery_delay(fact_orders: DataFrame, fact_reviews: DataFrame) -> DataFrame:
    """Average review score by delivery delay bucket (days after estimate)."""
    o = fact_orders.select("order_id", day_diff("estimated_date", "delivered_date").alias("delay_days"))
    j = fact_reviews.select("order_id", "review_score").join(o, "order_id")
    return j.groupBy(delay_bucket("delay_days").alias("delay_bucket")).agg(
        avg6("review_score").alias("avg_review_score"), F.count(F.lit(1)).alias("review_count"))


def delayed_orders(fact_orders: DataFrame) -> DataFrame:
    """Q8: delivered, delayed (after estimate) and approved shares in one pass."""
    delivered = F.col("delivered_date").isNotNull()
    late = delivered & (F.col("delivered_date") > F.col("estimated_date"))
    g = fact_orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(delivered).alias("delivered_orders"),
        F.count_if(late).alias("delayed_orders"),
        F.count_if(F.col("approved_date").isNotNull()).alias("approved_orders"))
    return g.select("*", ratio6(F.col("delayed_orders"), F.col("delivered_orders")).alias("delayed_share"),
                    ratio6(F.col("approved_orders"), F.col("total_orders")).alias("approval_rate"))


def latest_rows(df: DataFrame, ts_col: str, k: int = 10, tie: str | None = None) -> DataFrame:
    """Q9: newest ``k`` rows (top-k, no global sort)."""
    order = [F.desc(ts_col)] + ([F.desc(tie)] if tie else [])
    return df.orderBy(*order).limit(k)


def catalog_listing(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Q10: (table_name, column_name, data_type, ordinal) of a layer's tables, ordered."""
    rows = [(t, f.name, f.dataType.simpleString(), i + 1)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    out = spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int")
    return out.orderBy("table_name", "ordinal")


def bounded_sql(spark: SparkSession, sql: str, max_rows: int = 1000) -> DataFrame:
    """Q11: run SQL with an unconditional row cap (the cap is the feature)."""
    return spark.sql(sql).limit(max_rows)
