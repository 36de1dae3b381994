"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL reads the given tables (pre-registered views ``orders``, ``lineitem``
...) and re-derives the commerce tables and models with plain SQL, so a Spark
result can be checked against a second engine.  CTE names never shadow the
given table names.  Final SELECTs use the same result encoding as
``agora.plans.export`` (decimal -> double, dates and timestamps -> text).
"""

from __future__ import annotations

NULL_TOKEN = "_dbt_utils_surrogate_key_null_"


def sk(*cols: str) -> str:
    parts = [f"coalesce(CAST({c} AS VARCHAR), '{NULL_TOKEN}')" for c in cols]
    return f"md5({parts[0]})" if len(parts) == 1 else f"md5(concat_ws('-', {', '.join(parts)}))"


def dd(a: str, b: str) -> str:
    """Midnights from a to b as INT."""
    return f"CAST(date_diff('day', CAST({a} AS DATE), CAST({b} AS DATE)) AS INT)"


def avg6(x: str) -> str:
    return f"round(CAST(sum({x}) AS DOUBLE) / NULLIF(count({x}), 0), 6)"


def ratio6(n: str, d: str) -> str:
    return f"round(CAST({n} AS DOUBLE) / NULLIF({d}, 0), 6)"


def enc(spec: str) -> str:
    """Column list with encoding prefixes: m: money->double, d: date, t: timestamp."""
    out = []
    for item in [s.strip() for s in spec.split(",") if s.strip()]:
        if ":" in item:
            kind, name = item.split(":", 1)
            if kind == "m":
                out.append(f"CAST({name} AS DOUBLE) AS {name}")
            elif kind == "d":
                out.append(f"strftime({name}, '%Y-%m-%d') AS {name}")
            elif kind == "t":
                out.append(f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}")
            else:
                raise ValueError(item)
        else:
            out.append(item)
    return ", ".join(out)


# --------------------------------------------------------------------------
# Fixture mapping (fixed rules) and the warehouse models, as named CTEs.
# --------------------------------------------------------------------------
CTES: dict[str, str] = {}

CTES["nr"] = """SELECT n.n_nationkey, n.n_name, r.r_name
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"""

CTES["raw_customers"] = """SELECT 'C' || c.c_custkey AS customer_id,
  'U' || (c.c_custkey % 1000) AS customer_unique_id,
  CASE WHEN c.c_custkey % 53 <> 0 THEN lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') END AS customer_zip_code_prefix,
  lower(nr.n_name) AS customer_city, substr(nr.r_name, 1, 2) AS customer_state
  FROM customer c JOIN nr ON c.c_nationkey = nr.n_nationkey"""

CTES["raw_geolocation"] = """SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
  CAST(n_nationkey AS DECIMAL(10,8)) AS geolocation_lat,
  CAST(-n_nationkey AS DECIMAL(11,8)) AS geolocation_lng,
  lower(n_name) || CASE WHEN k = 0 THEN '' ELSE '_alt' END AS geolocation_city,
  substr(r_name, 1, 2) AS geolocation_state
  FROM (SELECT *, unnest([0, 1]) AS k FROM nr WHERE n_nationkey <> 24)"""

CTES["raw_sellers"] = """SELECT 'S' || s.s_suppkey AS seller_id,
  lpad(CAST(s.s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
  lower(nr.n_name) AS seller_city, substr(nr.r_name, 1, 2) AS seller_state
  FROM supplier s JOIN nr ON s.s_nationkey = nr.n_nationkey"""

CTES["raw_products"] = """SELECT 'P' || p_partkey AS product_id,
  CASE WHEN p_partkey % 41 <> 0 THEN lower(p_type) END AS product_category_name,
  CAST(length(p_name) AS INT) AS product_name_length,
  CAST(10 * length(p_name) AS INT) AS product_description_length,
  CAST(CASE WHEN p_partkey % 37 <> 0 THEN p_size % 9 END AS INT) AS product_photos_qty,
  CAST(CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE 100 * p_size END AS INT) AS product_weight_g,
  CAST(p_size AS INT) AS product_length_cm,
  CAST(p_size % 10 + 1 AS INT) AS product_height_cm,
  CAST(p_size % 7 + 1 AS INT) AS product_width_cm
  FROM part"""

CTES["raw_translation"] = """SELECT DISTINCT lower(p_type) AS product_category_name,
  upper(p_type) || '_EN' AS product_category_name_english
  FROM part WHERE NOT starts_with(p_type, 'PROMO')"""

CTES["raw_orders"] = """SELECT 'O' || o_orderkey AS order_id, 'C' || o_custkey AS customer_id,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
  purchase AS order_purchase_timestamp,
  CASE WHEN o_orderkey % 31 <> 0 THEN purchase + to_days(CAST(o_orderkey % 5 AS INT)) END AS order_approved_at,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN purchase + to_days(CAST(2 + o_orderkey % 6 AS INT)) END
    AS order_delivered_carrier_date,
  CASE WHEN o_orderstatus = 'F' THEN
    CASE WHEN o_orderkey % 101 = 0 THEN purchase - to_days(1)
         ELSE purchase + to_days(CAST(3 + o_orderkey % 30 AS INT)) END END AS order_delivered_customer_date,
  CAST(o_orderdate AS TIMESTAMP) + to_days(20) AS order_estimated_delivery_date
  FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INT)) AS purchase FROM orders)"""

CTES["raw_order_items"] = """SELECT 'O' || l_orderkey AS order_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
       l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS order_item_id,
  'P' || l_partkey AS product_id, 'S' || l_suppkey AS seller_id,
  CAST(l_shipdate AS TIMESTAMP) AS shipping_limit_date,
  CAST(l_extendedprice AS DECIMAL(10,2)) AS price, CAST(l_quantity AS DECIMAL(10,2)) AS freight_value
  FROM lineitem"""

CTES["raw_payments"] = """SELECT 'O' || o_orderkey AS order_id, CAST(seq AS INT) AS payment_sequential,
  CASE WHEN seq = 2 THEN 'voucher' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card'
    WHEN '2-HIGH' THEN 'boleto' WHEN '3-MEDIUM' THEN 'debit_card' WHEN '5-LOW' THEN 'voucher'
    ELSE 'not_defined' END END AS payment_type,
  CAST(CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 1 + o_orderkey % 12 END AS INT) AS payment_installments,
  CASE WHEN o_orderkey % 211 = 0 THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST(o_totalprice AS DECIMAL(10,2)) END
    AS payment_value
  FROM (SELECT *, unnest(CASE WHEN o_orderkey % 7 = 0 THEN [1, 2] ELSE [1] END) AS seq FROM orders)"""

CTES["raw_reviews"] = """SELECT 'R' || (o_orderkey // 2) AS review_id, 'O' || o_orderkey AS order_id,
  CAST(1 + o_orderkey % 5 AS INT) AS review_score, CAST(NULL AS VARCHAR) AS review_comment_title,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'ok' END AS review_comment_message,
  strftime(CAST(o_orderdate AS TIMESTAMP) + to_days(10), '%Y-%m-%d %H:%M:%S') AS review_creation_date,
  strftime(CAST(o_orderdate AS TIMESTAMP) + to_days(12), '%Y-%m-%d %H:%M:%S') AS review_answer_timestamp
  FROM orders WHERE o_orderkey % 3 <> 0"""

# ---- staging ----
CTES["stg_customers"] = "SELECT * FROM raw_customers"
CTES["stg_geolocation"] = "SELECT * FROM raw_geolocation"
CTES["stg_sellers"] = "SELECT * FROM raw_sellers"
CTES["stg_category_translation"] = "SELECT * FROM raw_translation"
CTES["stg_orders"] = f"""SELECT *,
  CASE WHEN order_delivered_customer_date IS NOT NULL
       THEN {dd('order_purchase_timestamp', 'order_delivered_customer_date')} END AS delivery_days,
  CASE WHEN order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL
       THEN {dd('order_delivered_customer_date', 'order_estimated_delivery_date')} END AS delivery_vs_estimate_days,
  CASE WHEN order_delivered_customer_date <= order_estimated_delivery_date THEN 'on_time'
       WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 'late'
       ELSE 'unknown' END AS delivery_performance
  FROM raw_orders"""
CTES["stg_order_items"] = "SELECT *, price + freight_value AS total_item_value FROM raw_order_items"
CTES["stg_order_payments"] = """SELECT *,
  CASE WHEN payment_installments > 1 THEN round(CAST(payment_value AS DOUBLE) / payment_installments, 6)
       ELSE CAST(payment_value AS DOUBLE) END AS installment_value
  FROM raw_payments"""
CTES["stg_order_reviews"] = f"""SELECT {sk('review_id', 'order_id')} AS id, *,
  CASE WHEN review_score >= 4 THEN 'positive' WHEN review_score = 3 THEN 'neutral' ELSE 'negative' END
    AS review_sentiment,
  review_comment_message IS NOT NULL AS has_comment
  FROM raw_reviews"""
CTES["stg_products"] = """SELECT *,
  product_length_cm * product_height_cm * product_width_cm AS product_volume_cm3,
  CASE WHEN product_weight_g IS NOT NULL AND product_weight_g > 0
       THEN CAST(product_weight_g AS DOUBLE) / 1000.0 END AS product_weight_kg,
  CASE WHEN product_photos_qty = 0 THEN 'no_photos'
       WHEN product_photos_qty BETWEEN 1 AND 3 THEN 'few_photos'
       WHEN product_photos_qty BETWEEN 4 AND 6 THEN 'moderate_photos'
       ELSE 'many_photos' END AS photo_category
  FROM raw_products"""

# ---- intermediate ----
CTES["geo_zip"] = """SELECT geolocation_zip_code_prefix, min(geolocation_city) AS geo_city,
  min(geolocation_state) AS geo_state FROM stg_geolocation GROUP BY geolocation_zip_code_prefix"""
CTES["int_customers_geocoded"] = """SELECT c.customer_id, c.customer_unique_id, c.customer_zip_code_prefix,
  c.customer_city, c.customer_state, g.geo_city, g.geo_state
  FROM (SELECT customer_id, customer_unique_id, customer_zip_code_prefix,
               min(customer_city) AS customer_city, min(customer_state) AS customer_state
        FROM stg_customers GROUP BY customer_id, customer_unique_id, customer_zip_code_prefix) c
  LEFT JOIN geo_zip g ON c.customer_zip_code_prefix = g.geolocation_zip_code_prefix"""
CTES["int_sellers_geocoded"] = """SELECT s.seller_id, s.seller_zip_code_prefix, s.seller_city, s.seller_state,
  g.geo_city, g.geo_state
  FROM stg_sellers s LEFT JOIN geo_zip g ON s.seller_zip_code_prefix = g.geolocation_zip_code_prefix"""
CTES["int_orders_lifecycle"] = """SELECT order_id, customer_id, order_status,
  order_purchase_timestamp AS purchase_date, order_approved_at AS approved_date,
  order_delivered_carrier_date AS carrier_date, order_delivered_customer_date AS delivered_date,
  order_estimated_delivery_date AS estimated_date, delivery_days, delivery_vs_estimate_days,
  delivery_performance FROM stg_orders"""
CTES["int_order_items_enriched"] = f"""SELECT oi.order_id, oi.order_item_id, oi.product_id, oi.seller_id,
  o.customer_id, o.purchase_date, o.approved_date, o.delivered_date, o.estimated_date,
  oi.price, oi.freight_value, oi.total_item_value,
  {dd('o.purchase_date', 'o.delivered_date')} AS days_to_deliver
  FROM stg_order_items oi JOIN int_orders_lifecycle o ON oi.order_id = o.order_id"""
CTES["int_products_cleaned"] = """SELECT p.product_id, p.product_name_length, p.product_description_length,
  p.product_photos_qty, p.product_volume_cm3, p.product_weight_kg, p.photo_category,
  coalesce(t.product_category_name_english, p.product_category_name) AS product_category_name
  FROM stg_products p LEFT JOIN stg_category_translation t ON p.product_category_name = t.product_category_name"""
CTES["int_reviews_cleaned"] = f"""SELECT {sk('order_id', 'review_id')} AS review_key, review_id, order_id,
  review_score, review_sentiment, review_creation_date, review_answer_timestamp, has_comment
  FROM stg_order_reviews"""

# ---- dimensions ----
CTES["dim_customer"] = f"""SELECT {sk('customer_id')} AS customer_key, customer_id, customer_unique_id,
  customer_zip_code_prefix, customer_city, customer_state, geo_city, geo_state FROM int_customers_geocoded"""
CTES["dim_seller"] = f"""SELECT {sk('seller_id')} AS seller_key, seller_id, seller_zip_code_prefix,
  seller_city, seller_state, geo_city, geo_state FROM int_sellers_geocoded"""
CTES["dim_product"] = f"""SELECT {sk('product_id')} AS product_key, product_id, product_category_name,
  product_name_length, product_description_length, product_photos_qty, product_volume_cm3,
  product_weight_kg, photo_category FROM int_products_cleaned"""
CTES["dim_geography"] = f"""SELECT {sk('geolocation_zip_code_prefix')} AS geo_key, geolocation_zip_code_prefix,
  geo_city AS city, geo_state AS state FROM geo_zip"""
CTES["dim_payment_type"] = f"""SELECT {sk('payment_type')} AS payment_type_key, payment_type
  FROM stg_order_payments GROUP BY payment_type"""

# ---- facts ----
CTES["fact_order_items"] = f"""SELECT {sk('oi.order_id', 'oi.order_item_id')} AS order_item_key,
  oi.order_id, oi.order_item_id, {sk('c.customer_id')} AS customer_key, {sk('s.seller_id')} AS seller_key,
  {sk('p.product_id')} AS product_key, CAST(oi.purchase_date AS DATE) AS purchase_date,
  CAST(oi.delivered_date AS DATE) AS delivered_date, oi.price, oi.freight_value, oi.total_item_value
  FROM int_order_items_enriched oi
  JOIN int_customers_geocoded c ON oi.customer_id = c.customer_id
  JOIN int_sellers_geocoded s ON oi.seller_id = s.seller_id
  JOIN int_products_cleaned p ON oi.product_id = p.product_id"""
CTES["fact_orders_accumulating"] = f"""SELECT order_id, customer_id, order_status, purchase_date,
  approved_date, carrier_date, delivered_date, estimated_date,
  {dd('purchase_date', 'approved_date')} AS purchase_to_approve_days,
  {dd('approved_date', 'carrier_date')} AS approve_to_ship_days,
  {dd('carrier_date', 'delivered_date')} AS ship_to_deliver_days,
  CASE WHEN delivered_date <= estimated_date THEN 1 ELSE 0 END AS on_time_flag,
  TIMESTAMP '2002-01-01 00:00:00' AS processed_at
  FROM int_orders_lifecycle"""
CTES["fact_payments"] = f"""SELECT order_id, payment_sequential, {sk('payment_type')} AS payment_type_key,
  payment_value, payment_installments, installment_value FROM stg_order_payments"""
CTES["fact_reviews"] = """SELECT review_key, review_id, order_id, review_score, review_sentiment,
  review_creation_date, review_answer_timestamp, has_comment FROM int_reviews_cleaned"""


def with_ctes(body: str) -> str:
    """Prefix the whole CTE chain; DuckDB inlines only what ``body`` uses."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items()) + "\n" + body
