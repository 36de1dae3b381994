"""Metric marts (F1-F3) and the segment expression (F4 lives in functions).

Money is summed as decimal (exact, order independent); averages and ratios
are doubles rounded to 6 places so every engine agrees on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import customer_segment, day_diff, surrogate_key
from ..functions.classify import quality_tier, sales_tier
from ..plans.strategy import bounded_broadcasts


def avg6(c) -> Column:
    """Average as double rounded to 6; decimals are summed exactly first."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.try_divide(F.sum(c).cast("double"), F.count(c)), 6)


def ratio6(num: Column, den: Column) -> Column:
    """num / den as double rounded to 6; NULL when den is 0 (no error)."""
    return F.round(F.try_divide(num.cast("double"), den), 6)


def sum_type(df: DataFrame, c: str):
    """The type of a plain sum, which a sum of sums keeps."""
    return df.select(F.sum(c)).schema[0].dataType


def mart_sales_metrics(fact_items: DataFrame, dim_customer: DataFrame, dim_seller: DataFrame,
                       dim_product: DataFrame, fact_orders: DataFrame, fact_reviews: DataFrame,
                       as_written: bool = False, dedupe_reviews: bool = False) -> DataFrame:
    """sales by customer state, seller state, category and month.

    Default joins items to their order by ``order_id``. ``as_written=True``
    reproduces the original join on customer key and a DATE = TIMESTAMP
    equality, which only matches orders placed at midnight.
    Reviews are left-joined per order, so several reviews of one order
    multiply that order's item rows (documented behaviour). ``dedupe_reviews=True``
    folds the reviews of an order into one row first, so that every item counts
    once; scores stay averages over all (item, review) pairs.

    ``fact_items`` may hold seller_state and product_category_name (joined before the
    items met their orders) and the ids behind their keys, which are narrower.

    Items, orders and reviews meet by order, so an order is complete in its task and is
    counted there. Distinct customers and sellers are counted over one row per group and
    id; all sums stay in one row per group and task.
    """
    oi = fact_items
    todo = [(key, dim.select(key, name)) for key, dim, name in (("seller_key", dim_seller, "seller_state"),
                                                               ("product_key", dim_product, "product_category_name"))
            if name not in oi.columns]
    for (key, _), side in zip(todo, bounded_broadcasts(*[d for _, d in todo])):
        oi = oi.join(side, key)
    customer, seller = (f"{c}_id" if f"{c}_id" in oi.columns else f"{c}_key" for c in ("customer", "seller"))
    o = fact_orders.select(F.col("order_id").alias("o_order_id"), F.col("customer_id").alias("o_customer_id"),
                           F.col("purchase_date").alias("o_purchase_date"), "on_time_flag",
                           "purchase_to_approve_days", "ship_to_deliver_days")
    score = F.col("review_score")
    r = fact_reviews.select(F.col("order_id").alias("r_order_id"), score.alias("s_sum"), score.isNotNull().cast("long").alias("s_n"),
                            F.coalesce(score >= 4, F.lit(False)).cast("long").alias("s_pos"))
    if dedupe_reviews:
        r = r.groupBy("r_order_id").agg(*[F.sum(c).alias(c) for c in ("s_sum", "s_n", "s_pos")])
    # An item's customer_key is made of its own order's customer (E1), so joining the
    # customer dimension through the (four times smaller) orders yields the same rows
    # as joining it on the item's key.
    cust = dim_customer.select(F.col("customer_key").alias("o_customer_key"), "customer_state")
    if as_written:
        day = F.col("o_purchase_date").cast("date")
        o = o.filter(day.cast("timestamp_ntz") == F.col("o_purchase_date")).withColumn("o_day", day)
    oc = o.join(cust, surrogate_key("o_customer_id") == F.col("o_customer_key"))
    if as_written:
        j = oi.join(oc, (oi.customer_key == oc.o_customer_key) & (oi.purchase_date == oc.o_day))
    else:
        j = oi.join(oc, oi.order_id == oc.o_order_id)
    j = j.join(r, F.col("o_order_id") == r.r_order_id, "left")
    group = ["customer_state", "seller_state", "product_category_name", "order_month"]
    summed = {"price": "price", "freight_value": "freight_value", "total_item_value": "total_item_value",
              "approve": "purchase_to_approve_days", "deliver": "ship_to_deliver_days", "on_time": "on_time_flag",
              "s_sum": "s_sum", "s_n": "s_n", "s_pos": "s_pos"}
    counted = {"price_n": "price", "value_n": "total_item_value", "approve_n": "purchase_to_approve_days",
               "deliver_n": "ship_to_deliver_days"}
    rows = j.groupBy(*group[:3], F.trunc("purchase_date", "month").alias("order_month"), "o_order_id",
                     oi[customer].cast("string").alias("customer"), oi[seller].cast("string").alias("seller")).agg(
        *[F.sum(c).alias(k) for k, c in summed.items()], *[F.count(c).alias(k) for k, c in counted.items()],
        F.count(F.lit(1)).alias("items"))
    first = F.row_number().over(Window.partitionBy("o_order_id", *group).orderBy("seller", "customer")) == 1
    entry = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("id"))
    entries = F.array(entry("sums", F.lit(None).cast("string")), entry("customer", F.col("customer")), entry("seller", F.col("seller")))
    sums = [*summed, *counted, "items", "orders"]
    spread = rows.withColumn("orders", first.cast("long")).withColumn("e", F.explode(entries)).select(
        *group, "e.kind", "e.id", *[F.when(F.col("e.kind") == "sums", F.col(c)).alias(c) for c in sums])
    add = [F.sum(c).alias(c) for c in sums]
    g = spread.groupBy(*group, "kind", "id").agg(*add).groupBy(*group).agg(
        *add, F.count_if(F.col("kind") == "customer").alias("customers"), F.count_if(F.col("kind") == "seller").alias("sellers"))
    avg = lambda c, n: ratio6(F.col(c), F.col(n))
    return g.select(
        *group, F.col("orders").alias("total_orders"), F.col("customers").alias("unique_customers"),
        F.col("sellers").alias("unique_sellers"), F.col("items").alias("total_items_sold"),
        F.col("price").alias("gross_merchandise_value"), F.col("freight_value").alias("total_freight_revenue"),
        F.col("total_item_value").alias("total_revenue"), avg("price", "price_n").alias("avg_item_price"),
        avg("total_item_value", "value_n").alias("avg_order_value"), avg("approve", "approve_n").alias("avg_approval_time_days"),
        avg("deliver", "deliver_n").alias("avg_delivery_time_days"), avg("on_time", "items").alias("on_time_delivery_rate"),
        avg("s_sum", "s_n").alias("avg_review_score"), avg("s_pos", "s_n").alias("positive_review_rate"))


def mart_customer_metrics(fact_items: DataFrame, fact_reviews: DataFrame, fact_orders: DataFrame,
                          dim_customer: DataFrame, as_of) -> DataFrame:
    """lifetime value, RFM and segment per customer who bought."""
    key = "customer_id" if "customer_id" in fact_items.columns else "customer_key"
    value = "total_item_value"
    # Items come by order: an order is one row before it leaves its task.
    orders = fact_items.groupBy(F.col(key).alias("_who"), "order_id").agg(
        F.min("purchase_date").alias("first"), F.max("purchase_date").alias("last"), F.count(F.lit(1)).alias("items"),
        F.sum(value).alias("value"), F.count(value).alias("n"))
    total = F.sum("value").cast(sum_type(fact_items, value))
    co = orders.groupBy("_who").agg(
        F.min("first").alias("first_order_date"),
        F.max("last").alias("last_order_date"),
        F.count("order_id").alias("total_orders"),
        F.sum("items").alias("total_items_purchased"),
        total.alias("lifetime_value"),
        ratio6(total, F.sum("n")).alias("avg_order_value"),
    ).withColumn("customer_key", F.col("_who") if key == "customer_key" else surrogate_key("_who")).drop("_who")
    o = fact_orders.select("order_id", "customer_id")
    cr = (fact_reviews.select("order_id", "review_score").join(o, "order_id")
          .groupBy(surrogate_key("customer_id").alias("customer_key"))
          .agg(avg6("review_score").alias("avg_review_score"),
               F.count("order_id").alias("total_reviews")))
    cd = dim_customer.select("customer_key", "customer_id", "customer_state", "customer_city")
    j = cd.join(co, "customer_key").join(cr, "customer_key", "left")
    return j.select(
        "customer_key", "customer_id", "customer_state", "customer_city",
        "first_order_date", "last_order_date",
        day_diff("first_order_date", "last_order_date").alias("customer_tenure_days"),
        "total_orders", "total_items_purchased",
        F.col("lifetime_value").alias("customer_lifetime_value"), "avg_order_value",
        ratio6(F.col("lifetime_value"), F.nullif(F.col("total_orders"), F.lit(0))).alias("revenue_per_order"),
        "total_reviews", "avg_review_score",
        customer_segment("total_orders", "lifetime_value").alias("customer_segment"),
        day_diff("last_order_date", F.lit(as_of).cast("date")).alias("recency_days"),
        F.col("total_orders").alias("frequency_score"),
        F.col("lifetime_value").alias("monetary_value"),
    )


def mart_product_metrics(fact_items: DataFrame, fact_reviews: DataFrame, dim_product: DataFrame,
                         as_of) -> DataFrame:
    """sales, lifecycle and rating per product that sold."""
    key = "product_id" if "product_id" in fact_items.columns else "product_key"
    score = F.col("review_score")
    reviews = fact_reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("r"), F.sum(score).alias("r_sum"), F.count(score).alias("r_n"),
        F.count(F.when(score >= 4, 1)).alias("r_pos"))
    # Items and reviews meet by order, and an order's items of one product are one row
    # before they leave their task. A product without reviews has nulls.
    orders = fact_items.join(reviews, "order_id", "left").groupBy(F.col(key).alias("_what"), "order_id").agg(
        F.count(F.lit(1)).alias("units"), F.sum("price").alias("price"), F.count("price").alias("price_n"),
        F.sum("freight_value").alias("freight"), F.min("purchase_date").alias("first"), F.max("purchase_date").alias("last"),
        *[F.sum(c).alias(c) for c in ("r", "r_sum", "r_n", "r_pos")])
    price = F.sum("price").cast(sum_type(fact_items, "price"))
    ps = orders.groupBy("_what").agg(
        F.count("order_id").alias("orders_containing_product"),
        F.sum("units").alias("total_units_sold"),
        price.alias("total_sales_revenue"),
        F.sum("freight").cast(sum_type(fact_items, "freight_value")).alias("total_freight_charged"),
        ratio6(price, F.sum("price_n")).alias("avg_selling_price"),
        F.min("first").alias("first_sale_date"),
        F.max("last").alias("last_sale_date"),
        ratio6(F.sum("r_sum"), F.sum("r_n")).alias("avg_product_rating"),
        F.sum("r").alias("total_reviews"),
        F.sum("r_pos").alias("positive_reviews"),
    ).withColumn("product_key", F.col("_what") if key == "product_key" else surrogate_key("_what")).drop("_what")
    pd_ = dim_product.select("product_key", "product_id", "product_category_name", "product_weight_kg",
                             "product_volume_cm3", "product_photos_qty")
    j = pd_.join(ps, "product_key")
    return j.select(
        "product_key", "product_id", "product_category_name", "product_weight_kg",
        "product_volume_cm3", "product_photos_qty", "orders_containing_product", "total_units_sold",
        "total_sales_revenue", "avg_selling_price", "total_freight_charged", "first_sale_date",
        "last_sale_date", "avg_product_rating", "total_reviews", "positive_reviews",
        day_diff("first_sale_date", "last_sale_date").alias("product_lifespan_days"),
        day_diff("last_sale_date", F.lit(as_of).cast("date")).alias("days_since_last_sale"),
        ratio6(F.col("positive_reviews"), F.nullif(F.col("total_reviews"), F.lit(0))).alias("positive_review_rate"),
        sales_tier("total_units_sold").alias("sales_tier"),
        quality_tier("avg_product_rating").alias("quality_tier"),
    )
