"""Registered queries: ingest, load and state jobs.

Jobs that write (loads, lake, CSV stages) write under the shared
``spark.checkpoint.dir`` in a fresh folder per call and return what they
wrote, read back, so the compare checks the stored result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as A
from ..operators import staging as B
from ..session import checkpoint_dir
from ..sources import files
from ..sources.contracts import CONTRACTS, Contract
from ..sources.tables import read_table
from .catalog import register
from .models import Warehouse
from .oracle import enc, with_ctes


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/agora/{name}/{uuid.uuid4().hex}"


LINEITEM = Contract("lineitem", (("l_orderkey", "bigint", False), ("l_linenumber", "int", True),
                                 ("l_partkey", "bigint", True), ("l_suppkey", "bigint", True),
                                 ("l_extendedprice", "decimal(12,2)", True), ("l_shipdate", "timestamp", True)))


@register("A1_contract_scan", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS l_extendedprice, {enc('t:l_shipdate')} FROM lineitem""")
def q_contract_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem read through a six-column contract (pruned scan, contract types)."""
    return files.contract_scan(spark, f"{sf_dir}/lineitem.parquet", LINEITEM)


def _review_csv(spark: SparkSession, sf_dir: str) -> str:
    """Reviews as a CRLF CSV with quotes, doubled quotes, blanks and line breaks."""
    r = Warehouse(spark, sf_dir).raw.order_reviews
    s = F.col("review_score")
    msg = (F.when(s == 5, F.concat(F.col("review_comment_message"), F.lit("\nthanks")))
           .when(s == 4, F.concat(F.lit('"great", '), F.col("review_comment_message")))
           .when(s == 2, F.lit("   ")).otherwise(F.col("review_comment_message")))
    path = _scratch(spark, "reviews_csv")
    (r.withColumn("review_comment_message", msg).write.option("header", True).option("quote", '"')
     .option("escape", '"').option("lineSep", "\r\n").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@register("A2_csv_import", with_ctes("""SELECT review_id, order_id, review_score, review_comment_title,
    CASE WHEN review_score = 5 THEN review_comment_message || ' thanks'
         WHEN review_score = 4 THEN '"great", ' || review_comment_message
         WHEN review_score = 2 THEN '   ' ELSE review_comment_message END AS review_comment_message,
    review_creation_date, review_answer_timestamp FROM raw_reviews"""))
def q_csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of the reviews through a messy CSV file."""
    path = _review_csv(spark, sf_dir)
    # Reviews: NULLIF(x, '') without trimming, newlines in the message become spaces.
    return files.csv_import(spark, path, CONTRACTS["order_reviews"], trim_blanks=False,
                            newline_columns=["review_comment_message"])


@register("A3_orphan_prune", with_ctes("""SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id
    FROM raw_order_items i WHERE i.order_id IN (
      SELECT o.order_id FROM raw_orders o JOIN customer c ON o.customer_id = 'C' || c.c_custkey
      WHERE c.c_mktsegment <> 'HOUSEHOLD')"""))
def q_orphan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment are missing: their orders go, then those orders' items."""
    w = Warehouse(spark, sf_dir)
    seg = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer_id"), "c_mktsegment")
    customers = w.raw.customers.join(seg, "customer_id").filter(F.col("c_mktsegment") != "HOUSEHOLD")
    t = A.orphan_prune({"customers": customers, "orders": w.raw.orders, "order_items": w.raw.order_items,
                        "products": w.raw.products, "sellers": w.raw.sellers,
                        "order_payments": w.raw.order_payments, "order_reviews": w.raw.order_reviews})
    return t["order_items"].select("order_id", "order_item_id", "product_id", "seller_id")


ORD = ("order_id, customer_id, order_status, t:order_purchase_timestamp, t:order_approved_at, "
       "t:order_delivered_carrier_date, t:order_delivered_customer_date, t:order_estimated_delivery_date")


@register("A4_load_full", with_ctes(f"SELECT {enc(ORD)} FROM raw_orders WHERE order_status = 'delivered'"))
def q_load_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two full loads into one folder; the second (delivered only) replaces the first."""
    o = Warehouse(spark, sf_dir).raw.orders
    path = _scratch(spark, "load_full")
    files.load_full(o, path)
    files.load_full(o.filter(F.col("order_status") == "delivered"), path)
    return spark.read.parquet(path)


def _wm_sql(cond: str) -> str:
    return with_ctes(f"SELECT {enc(ORD)} FROM raw_orders WHERE {cond}")


@register("A5_load_incremental", _wm_sql(
    "order_purchase_timestamp > TIMESTAMP '1998-01-01' AND order_purchase_timestamp <= TIMESTAMP '1999-01-01'"))
def q_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run with load_from = 1998-01-01 and load_at = 1999-01-01."""
    o = Warehouse(spark, sf_dir).raw.orders
    return A.watermark_slice(o, "order_purchase_timestamp", "1998-01-01", "1999-01-01")


@register("A5_load_incremental_first_run", _wm_sql("order_purchase_timestamp <= TIMESTAMP '1996-01-01'"))
def q_incremental_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Warehouse(spark, sf_dir).raw.orders
    return A.watermark_slice(o, "order_purchase_timestamp", None, "1996-01-01")


@register("A5_load_incremental_as_written", _wm_sql("order_purchase_timestamp > TIMESTAMP '1998-01-01'"))
def q_incremental_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No upper bound, as the original extraction."""
    o = Warehouse(spark, sf_dir).raw.orders
    return A.watermark_slice(o, "order_purchase_timestamp", "1998-01-01", "1999-01-01", as_written=True)


INCREMENTAL = [("order_items", "shipping_limit_date"), ("order_reviews", "review_creation_date"),
               ("orders", "order_purchase_timestamp")]


@register("A6_watermark_state", with_ctes(f"""SELECT {enc('table_name, watermark_column, strategy, t:load_from, t:load_at')}
  FROM (
  SELECT 'order_items' AS table_name, 'shipping_limit_date' AS watermark_column,
    'incremental_by_watermark' AS strategy,
    (SELECT max(shipping_limit_date) FROM raw_order_items WHERE shipping_limit_date < TIMESTAMP '1998-01-01') AS load_from,
    (SELECT max(shipping_limit_date) FROM raw_order_items) AS load_at
  UNION ALL
  SELECT 'order_reviews', 'review_creation_date', 'incremental_by_watermark',
    (SELECT CAST(max(review_creation_date) AS TIMESTAMP) FROM raw_reviews WHERE CAST(review_creation_date AS TIMESTAMP) < TIMESTAMP '1998-01-01'),
    (SELECT CAST(max(review_creation_date) AS TIMESTAMP) FROM raw_reviews)
  UNION ALL
  SELECT 'orders', 'order_purchase_timestamp', 'incremental_by_watermark',
    (SELECT max(order_purchase_timestamp) FROM raw_orders WHERE order_purchase_timestamp < TIMESTAMP '1998-01-01'),
    (SELECT max(order_purchase_timestamp) FROM raw_orders))"""))
def q_watermark_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after two runs whose run times are the newest watermark before
    1998 and the newest overall, per incremental table."""
    w = Warehouse(spark, sf_dir)
    raw = {"order_items": w.raw.order_items, "order_reviews": w.raw.order_reviews, "orders": w.raw.orders}
    tables = None
    runs1 = runs2 = None
    for name, col in INCREMENTAL:
        c = F.col(col).cast("timestamp_ntz")
        df = raw[name].select(c.alias("wm"))
        meta = df.agg(F.lit(name).alias("table_name"), F.lit(col).alias("watermark_column"),
                      F.lit("incremental_by_watermark").alias("strategy"))
        r1 = A.max_watermark(df.filter(F.col("wm") < F.lit("1998-01-01").cast("timestamp_ntz")), "wm")
        r2 = A.max_watermark(df, "wm")
        r1 = r1.select(F.lit(name).alias("table_name"), F.col("max_watermark").alias("run_at"),
                       F.lit("incremental_by_watermark").alias("strategy"),
                       F.lit(None).cast("string").alias("original_strategy"))
        r2 = r2.select(F.lit(name).alias("table_name"), F.col("max_watermark").alias("run_at"),
                       F.lit("incremental_by_watermark").alias("strategy"),
                       F.lit(None).cast("string").alias("original_strategy"))
        tables = meta if tables is None else tables.unionByName(meta)
        runs1 = r1 if runs1 is None else runs1.unionByName(r1)
        runs2 = r2 if runs2 is None else runs2.unionByName(r2)
    empty = spark.createDataFrame([], A.STATE_SCHEMA)
    state = A.state_init(empty, tables)
    state = A.state_advance(state, runs1)
    return A.state_advance(state, runs2)


@register("A8_lake_write", with_ctes("""SELECT order_id, payment_sequential, payment_type, payment_installments,
    CAST(payment_value AS DOUBLE) AS payment_value FROM raw_payments"""))
def q_lake_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments written as one snappy Parquet run folder and read back."""
    p = Warehouse(spark, sf_dir).raw.order_payments
    path, _ = files.lake_write(p, _scratch(spark, "lake"), "order_payments", "20240101T000000")
    return spark.read.parquet(path)


@register("A9_copy_by_name", """SELECT l_orderkey, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE)
    AS l_extendedprice, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate, NULL AS l_comment
    FROM lineitem WHERE l_returnflag <> 'R'""")
def q_copy_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged upper-case columns with a text price ('n/a' for returned lines)
    copied into a typed target; uncastable rows are skipped."""
    from pyspark.sql import types as T
    li = read_table(spark, sf_dir, "lineitem")
    staged = li.select(F.col("l_orderkey").alias("L_ORDERKEY"), F.col("l_partkey").alias("L_PartKey"),
                       F.when(F.col("l_returnflag") == "R", F.lit("n/a"))
                       .otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("L_EXTENDEDPRICE"),
                       F.col("l_shipdate").cast("string").alias("L_SHIPDATE"), F.lit(1).alias("EXTRA"))
    target = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
                           T.StructField("l_extendedprice", T.DecimalType(12, 2)),
                           T.StructField("l_shipdate", T.TimestampNTZType()),
                           T.StructField("l_comment", T.StringType())])
    loaded, _ = files.copy_by_name(staged, target)
    return loaded


@register("A10_ingestion_stamp", f"""SELECT 'O' || o_orderkey AS order_id,
    strftime(CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE TIMESTAMP '2024-02-01' END,
             '%Y-%m-%d %H:%M:%S.%f') AS ingestion_date FROM orders""")
def q_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders carry an ingestion date; the rest are stamped."""
    o = read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ingestion_date"))
    return A.ingestion_stamp(o, "2024-02-01 00:00:00")


CUST_CONTRACT = Contract("customer_stage", (("c_custkey", "bigint", False), ("c_name", "string", True),
                                            ("c_acctbal", "decimal(12,2)", True), ("c_mktsegment", "string", True)))


@register("A11_csv_stage_load", """SELECT c_custkey, c_name,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) END AS c_acctbal,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL ELSE c_mktsegment END AS c_mktsegment
    FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def q_csv_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers staged as CSV: 'NULL' text for negative balances, '' for one
    segment, a text balance for MACHINERY rows (rejected)."""
    c = read_table(spark, sf_dir, "customer")
    staged = c.select(
        F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("abc"))
        .when(F.col("c_acctbal") < 0, F.lit("NULL"))
        .otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("c_acctbal"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    path = _scratch(spark, "stage_csv")
    staged.write.option("header", True).option("emptyValue", "").csv(path)
    loaded, _ = files.csv_stage_load(spark, path, CUST_CONTRACT)
    return loaded


@register("A12_mask_hash", with_ctes("""SELECT customer_id, customer_unique_id, customer_zip_code_prefix,
    sha256(lower(trim(customer_city))) AS customer_city, sha256(lower(trim(customer_state))) AS customer_state
    FROM raw_customers"""))
def q_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.apply_masks(Warehouse(spark, sf_dir).raw.customers, CONTRACTS["customers"])


RAW_NAMES = ["customers", "geolocation", "order_items", "order_payments", "order_reviews", "orders", "products",
             "sellers", "category_translation"]
RAW_CTE = {"customers": "raw_customers", "geolocation": "raw_geolocation", "order_items": "raw_order_items",
           "order_payments": "raw_payments", "order_reviews": "raw_reviews", "orders": "raw_orders",
           "products": "raw_products", "sellers": "raw_sellers", "category_translation": "raw_translation"}


@register("A13_rowcount_nonzero", with_ctes(" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count, count(*) > 0 AS ok FROM {RAW_CTE[n]}" for n in RAW_NAMES)))
def q_rowcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = Warehouse(spark, sf_dir).raw
    attr = {"category_translation": "category_translation"}
    return A.rowcount_nonzero({n: getattr(raw, attr.get(n, n)) for n in RAW_NAMES})


@register("A14_null_normalise", """SELECT event_id,
    CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type END AS note,
    CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events""")
def q_null_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with 'NaN' / '' notes and NaN values before a relational sink."""
    e = read_table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit("NaN")).when(F.col("event_type") == "view", F.lit(""))
        .otherwise(F.col("event_type")).alias("note"),
        F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return A.null_normalise(e)


CHUNKED_SQL = """c AS (SELECT *, (row_number() OVER (ORDER BY order_id, payment_sequential) - 1) // 100 AS chunk FROM raw_payments),
  f AS (SELECT *, max(CASE WHEN payment_value <= 0 THEN 'payment_value must be positive' END) OVER (PARTITION BY chunk) AS error FROM c)"""
PAYMENTS = "order_id, payment_sequential, payment_type, payment_installments, m:payment_value"


def _appended(spark: SparkSession, sf_dir: str) -> str:
    """Payments appended in chunks of 100; a payment of nothing breaks its chunk. Run twice: the second run replaces the first."""
    p = Warehouse(spark, sf_dir).raw.order_payments
    path = _scratch(spark, "append")
    for _ in range(2):
        files.append_chunks(p, path, "load-1", ["order_id", "payment_sequential"],
                            {"payment_value must be positive": F.col("payment_value") <= 0}, 100)
    return path


@register("A15_jdbc_append", with_ctes(f"SELECT {enc(PAYMENTS)}, chunk FROM (WITH {CHUNKED_SQL} SELECT * FROM f WHERE error IS NULL)"))
def q_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the chunks that went in."""
    return files.appended(spark, _appended(spark, sf_dir)).drop("append_id")


@register("A15_rejected_rows", with_ctes(f"SELECT {enc(PAYMENTS)}, chunk, error FROM (WITH {CHUNKED_SQL} SELECT * FROM f WHERE error IS NOT NULL)"))
def q_chunked_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of failed chunks, with why."""
    return files.appended(spark, _appended(spark, sf_dir), "rejected").drop("append_id")


@register("A16_max_watermark", with_ctes(f"SELECT {enc('t:max_watermark')} FROM (SELECT max(order_purchase_timestamp) AS max_watermark FROM raw_orders)"))
def q_max_wm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.max_watermark(Warehouse(spark, sf_dir).raw.orders, "order_purchase_timestamp")


@register("A18_load_partition", with_ctes(f"""SELECT order_id, customer_id,
    CASE WHEN strftime(order_purchase_timestamp, '%Y-%m') = '1998-06' THEN 'reloaded' ELSE order_status END AS order_status,
    {enc('t:order_purchase_timestamp')}, strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month FROM raw_orders"""))
def q_load_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by purchase month; month 1998-06 is reloaded with a new status."""
    o = Warehouse(spark, sf_dir).raw.orders.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        F.date_format("order_purchase_timestamp", "yyyy-MM").alias("purchase_month"))
    path = _scratch(spark, "partitioned")
    files.load_partition(o, path, "purchase_month")
    files.load_partition(o.filter(F.col("purchase_month") == "1998-06")
                         .withColumn("order_status", F.lit("reloaded")), path, "purchase_month")
    return spark.read.parquet(path).select("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                                           F.col("purchase_month").cast("string"))


@register("A19_loaded_at_columns", with_ctes(f"""SELECT order_id, order_status,
    '2024-02-01 00:00:00.000000' AS _loaded_at FROM stg_orders"""))
def q_loaded_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.stg_orders(Warehouse(spark, sf_dir).raw.orders, loaded_at="2024-02-01 00:00:00")
    return s.select("order_id", "order_status", "_loaded_at")
