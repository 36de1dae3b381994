"""Registered queries: incremental merges (I1-I5) and SCD2 snapshots.

Each query replays loads derived from the given tables: an earlier load
(cut at a date, or without some members) followed by a later one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as I
from ..operators import scd2 as G
from ..session import checkpoint_dir
from ..sources.tables import read_table
from .catalog import register
from .models import Warehouse
from .oracle import enc, sk, with_ctes
from .strategy import written_table

CUT = "1998-06-01"          # boundary of the earlier load
AS_OF_MERGE = "2001-08-01"  # 'today' of the later load
T1, T2, T3 = "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"

FOI = ("order_item_key, order_id, order_item_id, customer_key, seller_key, product_key, d:purchase_date, "
       "d:delivered_date, m:price, m:freight_value, m:total_item_value")


@register("I1_merge_order_items", with_ctes(f"""SELECT {enc(FOI)} FROM (
  WITH t AS (SELECT * FROM fact_order_items WHERE purchase_date < DATE '{CUT}'),
    s AS (SELECT * REPLACE (freight_value + 1 AS freight_value) FROM fact_order_items),
    hi AS (SELECT coalesce(max(purchase_date), DATE '1900-01-01') AS m FROM t),
    sl AS (SELECT s.* FROM s WHERE s.purchase_date >= (SELECT m FROM hi))
  SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.order_item_key = t.order_item_key)
  UNION ALL SELECT * FROM sl)"""))
def q_merge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier load up to CUT, then a restated full source (freight + 1)."""
    w = Warehouse(spark, sf_dir)
    w.store_items()
    f = w.fact_order_items
    target = written_table(f.filter(F.col("purchase_date") < F.lit(CUT).cast("date")), "fact_order_items", "zstd")
    source = f.withColumn("freight_value", F.col("freight_value") + 1)
    return I.merge_order_items(target, source)


@register("I1_merge_order_items_partitioned", with_ctes(f"""SELECT {enc(FOI)}, purchase_month FROM (
  WITH t AS (SELECT * FROM fact_order_items WHERE purchase_date < DATE '{CUT}'),
    s AS (SELECT * REPLACE (freight_value + 1 AS freight_value) FROM fact_order_items),
    hi AS (SELECT coalesce(max(purchase_date), DATE '1900-01-01') AS m FROM t),
    sl AS (SELECT s.* FROM s WHERE s.purchase_date >= (SELECT m FROM hi)),
    m AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.order_item_key = t.order_item_key)
          UNION ALL SELECT * FROM sl)
  SELECT *, strftime(purchase_date, '%Y-%m') AS purchase_month FROM m)"""))
def q_merge_items_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 on a table partitioned by purchase month: only the months in the
    incremental slice are rewritten (dynamic partition overwrite)."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/agora/partitioned/{uuid.uuid4().hex}"
    w = Warehouse(spark, sf_dir)
    w.store_items("date_format(purchase_date, 'yyyy-MM')")
    f = w.fact_order_items.withColumn("purchase_month", F.date_format("purchase_date", "yyyy-MM"))
    I.merge_into_partitions(f.filter(F.col("purchase_date") < F.lit(CUT).cast("date")), f"{base}/table", ["order_item_key"],
                            ["purchase_month"], f"{base}/first", dealt=True, compression="zstd")
    target = spark.read.parquet(f"{base}/table")
    hi = target.select(F.coalesce(F.max("purchase_date"), F.lit("1900-01-01").cast("date"))).scalar()
    slice_ = f.withColumn("freight_value", F.col("freight_value") + 1).filter(F.col("purchase_date") >= hi)
    I.merge_into_partitions(slice_, f"{base}/table", ["order_item_key"], ["purchase_month"], f"{base}/stage",
                            dealt=True, compression="zstd")
    out = spark.read.parquet(f"{base}/table")
    return out.select(*[c for c in f.columns if c != "purchase_month"],
                      F.col("purchase_month").cast("string").alias("purchase_month"))


FOA = ("order_id, customer_id, order_status, t:purchase_date, t:approved_date, t:carrier_date, t:delivered_date, "
       "t:estimated_date, purchase_to_approve_days, approve_to_ship_days, ship_to_deliver_days, on_time_flag, "
       "t:processed_at")


@register("I2_merge_orders", with_ctes(f"""SELECT {enc(FOA)} FROM (
  WITH t AS (SELECT * FROM fact_orders_accumulating WHERE purchase_date < TIMESTAMP '{CUT} 00:00:00'),
    s AS (SELECT * REPLACE (TIMESTAMP '{AS_OF_MERGE} 00:00:00' AS processed_at) FROM fact_orders_accumulating),
    sl AS (SELECT * FROM s WHERE purchase_date > (SELECT max(purchase_date) FROM t)
           OR order_id IN (SELECT order_id FROM int_orders_lifecycle
                           WHERE purchase_date >= DATE '{AS_OF_MERGE}' - INTERVAL 7 DAY))
  SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.order_id = t.order_id)
  UNION ALL SELECT * FROM sl)"""))
def q_merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse(spark, sf_dir)
    f = w.fact_orders_accumulating
    target = written_table(f.filter(F.col("purchase_date") < F.lit(CUT).cast("timestamp_ntz")), "fact_orders")
    source = f.withColumn("processed_at", F.lit(AS_OF_MERGE).cast("timestamp_ntz"))
    return I.merge_orders(target, source, w.int_orders_lifecycle, AS_OF_MERGE)


@register("I2_merge_orders_empty_target", with_ctes(f"""SELECT {enc(FOA)} FROM fact_orders_accumulating
  WHERE order_id IN (SELECT order_id FROM int_orders_lifecycle
                     WHERE purchase_date >= DATE '{AS_OF_MERGE}' - INTERVAL 7 DAY)"""))
def q_merge_orders_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First incremental run on an empty table: only the 7-day arm selects."""
    w = Warehouse(spark, sf_dir)
    return I.merge_orders(None, w.fact_orders_accumulating, w.int_orders_lifecycle, AS_OF_MERGE)


FR = ("review_key, review_id, order_id, review_score, review_sentiment, review_creation_date, "
      "review_answer_timestamp, has_comment")


def _reviews_sql(key: str) -> str:
    return with_ctes(f"""SELECT {FR} FROM (
  WITH t AS (SELECT * FROM fact_reviews WHERE review_creation_date < '{CUT} 00:00:00'),
    sl0 AS (SELECT * FROM fact_reviews WHERE review_creation_date > (SELECT max(review_creation_date) FROM t)),
    sl AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key}
             ORDER BY review_creation_date DESC, review_key) AS rn FROM sl0) WHERE rn = 1)
  SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.{key} = t.{key})
  UNION ALL SELECT * FROM sl)""")


@register("I3_merge_reviews", _reviews_sql("review_key"))
def q_merge_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Warehouse(spark, sf_dir).fact_reviews
    target = written_table(f.filter(F.col("review_creation_date") < f"{CUT} 00:00:00"), "fact_reviews")
    return I.merge_reviews(target, f)


@register("I3_merge_reviews_as_written", _reviews_sql("review_id"))
def q_merge_reviews_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged on review_id as written (duplicate ids reduced to the newest)."""
    f = Warehouse(spark, sf_dir).fact_reviews
    target = written_table(f.filter(F.col("review_creation_date") < f"{CUT} 00:00:00"), "fact_reviews")
    return I.merge_reviews(target, f, key="review_id")


@register("I4_upsert_by_key", with_ctes(f"""SELECT {enc('order_id, payment_sequential, payment_type_key, '
  'm:payment_value, payment_installments, installment_value')} FROM (
  WITH s AS (SELECT p.order_id, p.payment_sequential, 'changed' AS payment_type_key, p.payment_value * 2 AS payment_value,
               p.payment_installments, p.installment_value
             FROM fact_payments p JOIN int_orders_lifecycle o ON p.order_id = o.order_id
             WHERE o.purchase_date >= TIMESTAMP '2001-01-01 00:00:00')
  SELECT t.order_id, t.payment_sequential, t.payment_type_key,
    CASE WHEN s.order_id IS NOT NULL THEN s.payment_value ELSE t.payment_value END AS payment_value,
    t.payment_installments, t.installment_value
  FROM fact_payments t LEFT JOIN s ON t.order_id = s.order_id AND t.payment_sequential = s.payment_sequential)"""))
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of 2001 orders restated (value x2); only payment_value is updated."""
    w = Warehouse(spark, sf_dir)
    recent = w.int_orders_lifecycle.filter(F.col("purchase_date") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    src = (w.fact_payments.join(recent.select("order_id"), "order_id", "left_semi")
           .withColumn("payment_value", F.col("payment_value") * 2)
           .withColumn("payment_type_key", F.lit("changed")))
    return I.upsert_by_key(w.fact_payments, src, ["order_id", "payment_sequential"], update_cols=["payment_value"])


@register("I5_sync_all_columns", with_ctes("""SELECT review_key, review_id, order_id, review_score,
  review_sentiment, review_creation_date, review_answer_timestamp, CAST(NULL AS BOOLEAN) AS has_comment
  FROM fact_reviews"""))
def q_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without has_comment and with a legacy column, aligned to the model."""
    f = Warehouse(spark, sf_dir).fact_reviews
    old = f.drop("has_comment").withColumn("legacy_flag", F.lit("x"))
    return I.sync_all_columns(old, f.schema)


# ---------------------------------------------------------------------------
# SCD2
# ---------------------------------------------------------------------------
META_ENC = "dbt_scd_id, t:dbt_updated_at, t:dbt_valid_from, t:dbt_valid_to"


def scd_step_sql(h: str, src: str, key: str, cols: list[str], check: list[str], ts: str) -> str:
    """DuckDB text of one check-strategy run (history CTE h, source CTE src)."""
    changed = " OR ".join(f"o.{c} IS DISTINCT FROM s.{c}" for c in check)
    oc = ", ".join(f"o.{c}" for c in cols)
    sc = ", ".join(f"s.{c}" for c in cols)
    t = f"TIMESTAMP '{ts}'"
    return f"""SELECT * FROM {h} WHERE dbt_valid_to IS NOT NULL
  UNION ALL
  SELECT {oc}, o.dbt_scd_id, o.dbt_updated_at, o.dbt_valid_from,
    CASE WHEN s.{key} IS NULL OR ({changed}) THEN {t} END AS dbt_valid_to
  FROM (SELECT * FROM {h} WHERE dbt_valid_to IS NULL) o LEFT JOIN {src} s ON o.{key} = s.{key}
  UNION ALL
  SELECT {sc}, {sk('s.' + key, t)}, {t}, {t}, CAST(NULL AS TIMESTAMP)
  FROM {src} s LEFT JOIN (SELECT * FROM {h} WHERE dbt_valid_to IS NULL) o ON o.{key} = s.{key}
  WHERE o.{key} IS NULL OR ({changed})"""


def scd_first_sql(src: str, key: str, cols: list[str], ts: str) -> str:
    t = f"TIMESTAMP '{ts}'"
    return (f"SELECT {', '.join(cols)}, {sk(key, t)} AS dbt_scd_id, {t} AS dbt_updated_at, "
            f"{t} AS dbt_valid_from, CAST(NULL AS TIMESTAMP) AS dbt_valid_to FROM {src}")


CUST_COLS = ["customer_key", "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
             "customer_state", "geo_city", "geo_state"]
PROD_COLS = ["product_key", "product_id", "product_category_name", "product_name_length",
             "product_description_length", "product_photos_qty", "product_volume_cm3", "product_weight_kg",
             "photo_category"]
SELL_COLS = ["seller_key", "seller_id", "seller_zip_code_prefix", "seller_city", "seller_state", "geo_city",
             "geo_state"]


def _snap_sql(runs: list[tuple[str, str]], key: str, cols: list[str], check: list[str]) -> str:
    """runs: [(source SQL, ts)] -> final history SQL."""
    parts = [f"src1 AS ({runs[0][0]})", f"h1 AS ({scd_first_sql('src1', key, cols, runs[0][1])})"]
    for i, (sql, ts) in enumerate(runs[1:], start=2):
        parts.append(f"src{i} AS ({sql})")
        parts.append(f"h{i} AS ({scd_step_sql(f'h{i - 1}', f'src{i}', key, cols, check, ts)})")
    n = len(runs)
    return with_ctes(f"SELECT {enc(', '.join(cols) + ', ' + META_ENC)} FROM (WITH {', '.join(parts)} "
                     f"SELECT * FROM h{n})")


def _cust_src_sql(where: str, city: str = "customer_city") -> str:
    return (f"SELECT {sk('c.customer_id')} AS customer_key, c.customer_id, c.customer_unique_id, "
            f"c.customer_zip_code_prefix, {city} AS customer_city, c.customer_state, c.geo_city, c.geo_state "
            f"FROM int_customers_geocoded c JOIN customer k ON c.customer_id = 'C' || k.c_custkey WHERE {where}")


def _runs(spark: SparkSession, run, days: list) -> DataFrame:
    """The stored history after each day's run."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/agora/history/{uuid.uuid4().hex}"
    for source, at in days:
        run(path, source, at)
    return G.stored_history(spark, path)


@register("G1_snap_dim_customer", _snap_sql([
    (_cust_src_sql("k.c_acctbal < 9000"), T1),
    (_cust_src_sql("k.c_mktsegment <> 'HOUSEHOLD'",
                   "CASE WHEN k.c_mktsegment = 'BUILDING' THEN upper(c.customer_city) ELSE c.customer_city END"), T2),
], "customer_id", CUST_COLS, G.CUSTOMER_CHECK))
def q_snap_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day 1: customers with balance < 9000; day 2: all but HOUSEHOLD, BUILDING
    customers with a changed city."""
    w = Warehouse(spark, sf_dir)
    k = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer_id"), "c_acctbal", "c_mktsegment")
    c = w.int_customers_geocoded.join(k, "customer_id")
    day1 = c.filter(F.col("c_acctbal") < 9000).drop("c_acctbal", "c_mktsegment")
    day2 = (c.filter(F.col("c_mktsegment") != "HOUSEHOLD")
            .withColumn("customer_city", F.when(F.col("c_mktsegment") == "BUILDING", F.upper("customer_city"))
                        .otherwise(F.col("customer_city")))
            .drop("c_acctbal", "c_mktsegment"))
    return _runs(spark, G.snap_dim_customer, [(day1, T1), (day2, T2)])


def _prod_src_sql(where: str, weight: str = "p.product_weight_kg") -> str:
    return (f"SELECT {sk('p.product_id')} AS product_key, p.product_id, p.product_category_name, "
            f"p.product_name_length, p.product_description_length, p.product_photos_qty, p.product_volume_cm3, "
            f"{weight} AS product_weight_kg, p.photo_category "
            f"FROM int_products_cleaned p JOIN part k ON p.product_id = 'P' || k.p_partkey WHERE {where}")


@register("G2_snap_dim_product", _snap_sql([
    (_prod_src_sql("k.p_size <= 40"), T1),
    (_prod_src_sql("k.p_retailprice > 905",
                   "CASE WHEN k.p_brand = 'Brand#11' THEN p.product_weight_kg + 1 ELSE p.product_weight_kg END"), T2),
], "product_id", PROD_COLS, G.PRODUCT_CHECK))
def q_snap_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day 1: parts up to size 40; day 2: parts above a price, Brand#11 heavier."""
    w = Warehouse(spark, sf_dir)
    k = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"), "p_size", "p_retailprice",
        "p_brand")
    p = w.int_products_cleaned.join(k, "product_id")
    day1 = p.filter(F.col("p_size") <= 40).drop("p_size", "p_retailprice", "p_brand")
    day2 = (p.filter(F.col("p_retailprice") > 905)
            .withColumn("product_weight_kg", F.when(F.col("p_brand") == "Brand#11", F.col("product_weight_kg") + 1)
                        .otherwise(F.col("product_weight_kg")))
            .drop("p_size", "p_retailprice", "p_brand"))
    return _runs(spark, G.snap_dim_product, [(day1, T1), (day2, T2)])


def _sell_src_sql(where: str, geo_state: str = "s.geo_state") -> str:
    return (f"SELECT {sk('s.seller_id')} AS seller_key, s.seller_id, s.seller_zip_code_prefix, s.seller_city, "
            f"s.seller_state, s.geo_city, {geo_state} AS geo_state "
            f"FROM int_sellers_geocoded s JOIN supplier k ON s.seller_id = 'S' || k.s_suppkey WHERE {where}")


def _seller_days(spark: SparkSession, sf_dir: str):
    w = Warehouse(spark, sf_dir)
    k = read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("seller_id"), "s_acctbal", "s_nationkey")
    s = w.int_sellers_geocoded.join(k, "seller_id")
    extra = ["s_acctbal", "s_nationkey"]
    day1 = s.filter(F.col("s_acctbal") > 0).drop(*extra)
    day2 = (s.filter(F.col("s_acctbal") < 8000)
            .withColumn("geo_state", F.when(F.col("s_nationkey") < 5, F.lit(None).cast("string"))
                        .otherwise(F.col("geo_state")))
            .drop(*extra))
    day3 = s.drop(*extra)
    return day1, day2, day3


SELLER_RUNS = [
    (_sell_src_sql("k.s_acctbal > 0"), T1),
    (_sell_src_sql("k.s_acctbal < 8000", "CASE WHEN k.s_nationkey < 5 THEN NULL ELSE s.geo_state END"), T2),
]


@register("G3_snap_dim_seller", _snap_sql(SELLER_RUNS, "seller_id", SELL_COLS, G.SELLER_CHECK))
def q_snap_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day 1: sellers with positive balance; day 2: balance < 8000, geo_state
    of five nations turned NULL (a NULL-safe change)."""
    d1, d2, _ = _seller_days(spark, sf_dir)
    return _runs(spark, G.snap_dim_seller, [(d1, T1), (d2, T2)])


@register("G4_scd2_check", _snap_sql(SELLER_RUNS + [(_sell_src_sql("TRUE"), T3), (_sell_src_sql("TRUE"), T3)],
                                     "seller_id", SELL_COLS, G.SELLER_CHECK))
def q_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seller runs (deleted keys come back, NULL -> value) and a rerun
    of day 3, which must change nothing."""
    d1, d2, d3 = _seller_days(spark, sf_dir)
    return _runs(spark, G.snap_dim_seller, [(d1, T1), (d2, T2), (d3, T3), (d3, T3)])
