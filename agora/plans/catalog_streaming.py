"""Registered queries: CDC and alert jobs in batch form (S2-S15); the streams are in ``catalog_live``.

The envelopes are derived from the ``events`` table (see
``envelopes_from_events``); the same functions run on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.changes import envelopes_from_events
from ..sources.tables import read_table
from ..streaming import alerts as S
from ..streaming import cdc, sinks
from .catalog import register
from .oracle import enc
from .strategy import written_table

TOPIC = "cdc.streaming.transactions"


def _env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes_from_events(read_table(spark, sf_dir, "events"))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.cdc_flatten(_env(spark, sf_dir))


# DuckDB twin of the envelope mapping (fixed rules).
ENV_SQL = """env AS (SELECT event_id AS "offset",
    CASE WHEN event_id % 50 = 0 THEN 'd' WHEN event_type = 'view' THEN 'u' ELSE 'c' END AS op,
    epoch_us(ts) // 1000 AS ts_ms, 'T' || event_id AS transaction_id, 'u' || user_id AS user_id,
    CAST(CAST(CASE WHEN event_type = 'error' THEN -value ELSE value END AS DECIMAL(10,2)) AS VARCHAR) AS amount,
    'USD' AS currency, epoch_us(ts) AS "timestamp" FROM events),
  flat AS (SELECT transaction_id, user_id, amount, currency, "timestamp", op, "offset" FROM env
    WHERE op IN ('c', 'u', 'r') AND user_id <> '' AND amount <> ''
      AND "timestamp" <> 0)"""

FLAT_COLS = 'transaction_id, user_id, amount, currency, "timestamp", op, "offset"'


@register("S2_cdc_flatten", f"WITH {ENV_SQL} SELECT {FLAT_COLS} FROM flat")
def q_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir)


@register("S3_cdc_to_json", f"""WITH {ENV_SQL}
  SELECT user_id AS "key", to_json({{'user_id': user_id, 'amount': amount, 'timestamp_micros': "timestamp",
     'currency': currency, 'op': op}})::VARCHAR AS "value", "offset" FROM flat""")
def q_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.cdc_to_json(_flat(spark, sf_dir))


@register("S3_cdc_rejects", f"""WITH {ENV_SQL}
  SELECT CASE WHEN op NOT IN ('c', 'u', 'r') THEN 'operation' WHEN op = 'd' THEN 'no_after'
              ELSE 'missing_field' END AS reject_reason, count(*) AS rejected
  FROM env WHERE "offset" NOT IN (SELECT "offset" FROM flat) GROUP BY 1""")
def q_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected envelopes counted per reason (the quarantine side output)."""
    return cdc.cdc_rejects(_env(spark, sf_dir)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rejected"))


@register("S4_json_parse", f"""WITH {ENV_SQL}
  SELECT user_id, amount, "timestamp" // 1000 AS event_time_ms, "offset" FROM flat""")
def q_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.json_parse(cdc.cdc_to_json(_flat(spark, sf_dir)))


@register("S5_event_day", f"""WITH {ENV_SQL}
  SELECT CAST(("timestamp" // 1000) // 86400000 AS INT) AS day, count(*) AS transactions,
    CAST(sum(abs(CAST(amount AS DECIMAL(12,2)))) AS DOUBLE) AS volume FROM flat GROUP BY 1""")
def q_event_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions and volume per UTC day number."""
    p = cdc.json_parse(cdc.cdc_to_json(_flat(spark, sf_dir)))
    return p.groupBy(cdc.event_day().alias("day")).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(F.abs(F.col("amount").cast("decimal(12,2)"))).alias("volume"))


def _alert_sql(window_days: int, threshold: str, where: str = "true") -> str:
    """Window totals, then one step per event of a user: the last alerted total is carried along."""
    return f"""WITH RECURSIVE {ENV_SQL},
  tx AS (SELECT user_id, abs(CAST(amount AS DECIMAL(12,2))) AS amount, "timestamp" // 1000 AS ms,
           "offset" AS tie, ("timestamp" // 1000) // 86400000 AS day FROM flat WHERE {where}),
  dayc AS (SELECT user_id, day, count(*) OVER (PARTITION BY user_id ORDER BY day
             RANGE BETWEEN {window_days} PRECEDING AND 1 PRECEDING) AS prev_days
           FROM (SELECT DISTINCT user_id, day FROM tx)),
  w AS (SELECT tx.*, d.prev_days,
      CAST(coalesce(sum(amount) OVER (PARTITION BY tx.user_id ORDER BY tx.day
               RANGE BETWEEN {window_days} PRECEDING AND 1 PRECEDING), 0)
        + sum(amount) OVER (PARTITION BY tx.user_id, tx.day ORDER BY ms, tie ROWS UNBOUNDED PRECEDING)
        AS DECIMAL(12,2)) AS total,
      coalesce(count(*) OVER (PARTITION BY tx.user_id ORDER BY tx.day
               RANGE BETWEEN {window_days} PRECEDING AND 1 PRECEDING), 0)
        + row_number() OVER (PARTITION BY tx.user_id, tx.day ORDER BY ms, tie) AS n,
      row_number() OVER (PARTITION BY tx.user_id ORDER BY ms, tie) AS i
      FROM tx JOIN dayc d ON tx.user_id = d.user_id AND tx.day = d.day),
  step AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS DECIMAL(12,2)) AS last, false AS alert
           FROM (SELECT DISTINCT user_id FROM w)
    UNION ALL SELECT w.user_id, w.i,
      CASE WHEN w.total < {threshold} THEN NULL WHEN s.last IS NULL OR abs(w.total - s.last) > 0.01 THEN w.total
           ELSE s.last END,
      w.total >= {threshold} AND (s.last IS NULL OR abs(w.total - s.last) > 0.01)
    FROM step s JOIN w ON w.user_id = s.user_id AND w.i = s.i + 1)
  SELECT w.user_id, CAST(total AS DOUBLE) AS total_amount,
    CAST(prev_days + 1 AS INT) AS bucket_count, CAST(n AS INT) AS transaction_count,
    'HIGH_VALUE_USER' AS alert_type,
    'User spent $' || CAST(total AS VARCHAR) || ' in last {window_days} days' AS message,
    'HIGH' AS severity, strftime(epoch_ms(ms), '%Y-%m-%d %H:%M:%S.%f') AS detected_at,
    {window_days} AS window_days, CAST({threshold} AS DOUBLE) AS threshold_amount
  FROM w JOIN step ON w.user_id = step.user_id AND w.i = step.i AND alert"""


@register("S7_rolling_alert", _alert_sql(30, "3000.00"))
def q_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-day (31 day buckets) spending alert at 3000."""
    return S.rolling_alert(S.transactions(_env(spark, sf_dir)))


@register("S7_rolling_alert_w7_t900", _alert_sql(7, "900.00"))
def q_rolling7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7-day window at 900, so that old buckets are evicted within the data."""
    return S.rolling_alert(S.transactions(_env(spark, sf_dir)), window_days=7, threshold=900)


@register("S8_cumulative_alert", f"""WITH {ENV_SQL},
  tx AS (SELECT user_id, abs(TRY_CAST(amount AS DECIMAL(12,2))) AS amount, "timestamp" // 1000 AS ms,
           "offset" AS tie FROM env
         WHERE op IN ('c', 'u', 'r') AND user_id IS NOT NULL AND TRY_CAST(amount AS DECIMAL(12,2)) IS NOT NULL),
  r AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY ms, tie ROWS UNBOUNDED PRECEDING) AS total,
          row_number() OVER (PARTITION BY user_id ORDER BY ms, tie) AS n FROM tx)
  SELECT user_id, CAST(total AS DOUBLE) AS total_amount, CAST(n AS INT) AS transaction_count,
    'HIGH_VALUE_USER' AS alert_type,
    'User ' || user_id || ' spent $' || CAST(CAST(total AS DECIMAL(12,2)) AS VARCHAR) || ' total' AS message,
    'HIGH' AS severity, strftime(epoch_ms(ms), '%Y-%m-%d %H:%M:%S.%f') AS detected_at, 30 AS window_days,
    CAST(3000.00 AS DOUBLE) AS threshold_amount,
    strftime(epoch_ms(ms), '%Y-%m-%d %H:%M:%S.%f') AS created_at,
    strftime(epoch_ms(ms), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
  FROM r WHERE total >= 3000.00""")
def q_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cumulative_alert(S.transactions(_env(spark, sf_dir), strict_truthiness=False))


@register("S9_alert_upsert", f"""WITH a AS ({_alert_sql(30, "3000.00")})
  SELECT user_id, arg_max(total_amount, detected_at) AS total_amount,
    arg_max(bucket_count, detected_at) AS bucket_count, arg_max(transaction_count, detected_at) AS transaction_count,
    'HIGH_VALUE_USER' AS alert_type, arg_max(message, detected_at) AS message, 'HIGH' AS severity,
    max(detected_at) AS detected_at, 30 AS window_days, CAST(3000.00 AS DOUBLE) AS threshold_amount,
    min(detected_at) AS created_at, max(detected_at) AS updated_at
  FROM a GROUP BY user_id""")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final alert table after upserting every rolling alert (newest wins)."""
    return S.alert_upsert(S.rolling_alert(S.transactions(_env(spark, sf_dir))))


@register("S9_alert_upsert_into_target", f"""WITH a AS ({_alert_sql(7, "900.00")}),
  cut AS (SELECT strftime(min(ts) + (max(ts) - min(ts)) / 2, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events),
  old AS (SELECT user_id, min(detected_at) AS created_at FROM a, cut WHERE detected_at < cut.at GROUP BY user_id),
  new AS (SELECT user_id, min(detected_at) AS created_at FROM a, cut WHERE detected_at >= cut.at GROUP BY user_id),
  last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY detected_at DESC, total_amount DESC) AS rn FROM a)
  SELECT user_id, total_amount, bucket_count, transaction_count, alert_type, message, severity, detected_at, window_days,
    threshold_amount, coalesce(old.created_at, new.created_at) AS created_at, detected_at AS updated_at
  FROM last LEFT JOIN old USING (user_id) LEFT JOIN new USING (user_id) WHERE rn = 1""")
def q_upsert_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the second half of the time put into the table of the first half's: users
    without a new alert stay, others keep when they were created."""
    events = read_table(spark, sf_dir, "events")
    cut = events.select((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("at")).scalar()
    # Written once: the table, its untouched rows and the merged ones would each find all alerts anew.
    found = written_table(S.rolling_alert(S.transactions(_env(spark, sf_dir)), window_days=7, threshold=900), "found_alerts")
    before = F.col("detected_at") < F.lit(cut).cast("timestamp_ntz")
    table = written_table(S.alert_upsert(found.filter(before)), "user_alerts")
    return S.alert_upsert(found.filter(~before), table)


LAKE_SQL = f"""WITH {ENV_SQL},
  rec AS (SELECT '{TOPIC}' AS source_topic, 0 AS "partition", "offset",
    strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp",
    CAST(year(epoch_ms(ts_ms)) AS INT) AS year, lpad(CAST(month(epoch_ms(ts_ms)) AS VARCHAR), 2, '0') AS month,
    lpad(CAST(day(epoch_ms(ts_ms)) AS VARCHAR), 2, '0') AS day,
    CASE WHEN op = 'd' THEN CAST("offset" AS VARCHAR) ELSE transaction_id END AS object_id, op FROM env)"""
LAKE_COLS = 'source_topic, "partition", "offset", "timestamp", year, month, day, object_id, op'


@register("S10_cdc_lake_sink", f"{LAKE_SQL} SELECT {LAKE_COLS} FROM rec")
def q_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lake records keyed by (topic, partition, offset): every change kept."""
    r = sinks.lake_dedupe(sinks.lake_records(_env(spark, sf_dir), TOPIC))
    return r.drop("payload")


@register("S10_cdc_lake_sink_as_written", f"""{LAKE_SQL}
  SELECT {LAKE_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY source_topic, year, month, day, object_id, op
    ORDER BY "partition", "offset") AS rn FROM rec WHERE op <> 'd') WHERE rn = 1""")
def q_lake_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First write per (topic, day, id, op); deletes skipped."""
    r = sinks.lake_dedupe(sinks.lake_records(_env(spark, sf_dir), TOPIC), as_written=True)
    return r.drop("payload")


def _invoice_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice JSON messages derived from lineitem x orders (fixed rules:
    every 97th order sends a text price, every 89th omits the timestamp)."""
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    k = F.col("l_orderkey")
    pay = (F.when(F.col("o_orderpriority") == "1-URGENT", "credit_card")
           .when(F.col("o_orderpriority") == "2-HIGH", "boleto")
           .when(F.col("o_orderpriority") == "3-MEDIUM", "debit_card")
           .when(F.col("o_orderpriority") == "5-LOW", "voucher").otherwise("not_defined"))
    status = (F.when(F.col("o_orderstatus") == "F", "delivered")
              .when(F.col("o_orderstatus") == "O", "shipped").otherwise("processing"))
    fields = [
        F.concat(F.lit("I"), k.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("invoice_id"),
        F.concat(F.lit("O"), k.cast("string")).alias("order_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("seller_id"),
        F.concat(F.lit("part_"), (F.col("l_partkey") % 50).cast("string")).alias("product_category"),
    ]
    price_ok = F.col("l_extendedprice").alias("item_price")
    rest = [
        F.col("l_quantity").alias("freight_value"),
        F.round(F.col("l_extendedprice") + F.col("l_quantity"), 2).alias("total_amount"),
        pay.alias("payment_type"), (k % 12 + 1).alias("payment_installments"), status.alias("order_status"),
        F.concat(F.lit("city_"), (F.col("o_custkey") % 25).cast("string")).alias("customer_city"),
        F.concat(F.lit("st_"), (F.col("o_custkey") % 5).cast("string")).alias("customer_state"),
        F.concat(F.lit("city_"), (F.col("l_suppkey") % 25).cast("string")).alias("seller_city"),
        F.concat(F.lit("st_"), (F.col("l_suppkey") % 5).cast("string")).alias("seller_state"),
        F.when(k % 89 != 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.lit("pos").alias("source_system"), (F.col("l_linenumber") * 10).cast("long").alias("processing_time_ms"),
    ]
    good = F.to_json(F.struct(*fields, price_ok, *rest))
    bad = F.to_json(F.struct(*fields, F.lit("abc").alias("item_price"), *rest))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return j.select(F.when(k % 97 == 0, bad).otherwise(good).alias("value"), "l_orderkey", *order[1:])


def _wrong_types(messages: DataFrame) -> DataFrame:
    """Every 83rd order sends a numeric id, every 79th an object as city, every 73rd a fraction of
    instalments, every 71st a number as text of a text field's neighbour; every 67th a whole price (which is right)."""
    k, v = F.col("l_orderkey"), F.col("value")
    return messages.withColumn("value", F.when(k % 83 == 0, F.regexp_replace(v, '"invoice_id":"I([0-9]+)-([0-9]+)"', '"invoice_id":$1$2'))
                               .when(k % 79 == 0, F.regexp_replace(v, '"customer_city":"([^"]*)"', '"customer_city":{"name":"$1"}'))
                               .when(k % 73 == 0, F.regexp_replace(v, '"payment_installments":([0-9]+)', '"payment_installments":$1.5'))
                               .when(k % 71 == 0, F.regexp_replace(v, '"freight_value":([0-9.]+)', '"freight_value":"$1"'))
                               .when(k % 67 == 0, F.regexp_replace(v, '"item_price":([0-9]+)[.][0-9]+', '"item_price":$1')).otherwise(v))


INVOICE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus"]


@register("S11_invoice_landing", f"""SELECT invoice_id, order_id, customer_id, seller_id, product_category,
    item_price, freight_value, total_amount, payment_type, payment_installments, order_status, customer_city,
    customer_state, seller_city, seller_state, "timestamp" FROM (
  SELECT 'I' || l_orderkey || '-' || l_linenumber AS invoice_id, 'O' || l_orderkey AS order_id,
    'C' || o_custkey AS customer_id, 'S' || l_suppkey AS seller_id, 'part_' || (l_partkey % 50) AS product_category,
    l_extendedprice AS item_price, l_quantity AS freight_value, round(l_extendedprice + l_quantity, 2) AS total_amount,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'boleto' WHEN '3-MEDIUM'
      THEN 'debit_card' WHEN '5-LOW' THEN 'voucher' ELSE 'not_defined' END AS payment_type,
    l_orderkey % 12 + 1 AS payment_installments,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
    'city_' || (o_custkey % 25) AS customer_city, 'st_' || (o_custkey % 5) AS customer_state,
    'city_' || (l_suppkey % 25) AS seller_city, 'st_' || (l_suppkey % 5) AS seller_state,
    strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS "timestamp",
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(INVOICE_ORDER)}) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 97 <> 0 AND l_orderkey % 89 <> 0)
  WHERE rn = 1""")
def q_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly typed invoices landed once per invoice id."""
    m = _invoice_messages(spark, sf_dir)
    out = sinks.invoice_landing(m, None, order=INVOICE_ORDER)
    return out.select(*sinks.INVOICE_STORED)


@register("S11_invoice_landing_strict", f"""SELECT invoice_id, order_id, customer_id, seller_id, product_category,
    item_price, freight_value, total_amount, payment_type, payment_installments, order_status, customer_city,
    customer_state, seller_city, seller_state, "timestamp" FROM (
  SELECT 'I' || l_orderkey || '-' || l_linenumber AS invoice_id, 'O' || l_orderkey AS order_id,
    'C' || o_custkey AS customer_id, 'S' || l_suppkey AS seller_id, 'part_' || (l_partkey % 50) AS product_category,
    CASE WHEN l_orderkey % 67 = 0 THEN floor(l_extendedprice) ELSE l_extendedprice END AS item_price, l_quantity AS freight_value, round(l_extendedprice + l_quantity, 2) AS total_amount,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'boleto' WHEN '3-MEDIUM'
      THEN 'debit_card' WHEN '5-LOW' THEN 'voucher' ELSE 'not_defined' END AS payment_type,
    l_orderkey % 12 + 1 AS payment_installments,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
    'city_' || (o_custkey % 25) AS customer_city, 'st_' || (o_custkey % 5) AS customer_state,
    'city_' || (l_suppkey % 25) AS seller_city, 'st_' || (l_suppkey % 5) AS seller_state,
    strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS "timestamp",
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(INVOICE_ORDER)}) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 97 <> 0 AND l_orderkey % 89 <> 0
    AND l_orderkey % 83 <> 0 AND l_orderkey % 79 <> 0 AND l_orderkey % 73 <> 0 AND l_orderkey % 71 <> 0)
  WHERE rn = 1""")
def q_invoice_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, with fields of wrong JSON types: those invoices don't land."""
    m = _wrong_types(_invoice_messages(spark, sf_dir))
    return sinks.invoice_landing(m, None, order=INVOICE_ORDER).select(*sinks.INVOICE_STORED)


@register("S12_insert_if_absent", f"""WITH {ENV_SQL},
  t AS (SELECT *, ("timestamp" // 1000) // 86400000 AS day FROM flat)
  SELECT transaction_id, user_id, amount, day FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY "timestamp", "offset") AS rn FROM t) b
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM t x WHERE x.user_id = b.user_id AND x.day = b.day
                                 AND x.day < (SELECT min(day) + 10 FROM t))""")
def q_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First transaction per (user, day) not already in a table holding the first 10 days."""
    f = _flat(spark, sf_dir).withColumn("day", F.floor(F.col("timestamp") / 1000 / 86_400_000).cast("long"))
    d0 = f.select(F.min("day")).scalar()
    target = f.filter(F.col("day") < d0 + 10)
    ins = sinks.insert_if_absent(target, f, ["user_id", "day"], ["timestamp", "offset"])
    return ins.select("transaction_id", "user_id", "amount", "day")


@register("S13_snapshot_then_stream", f"""WITH {ENV_SQL},
  b AS (SELECT min(ts_ms) + 15 * 86400000 AS cut FROM env)
  SELECT 'r' AS op, transaction_id, user_id, amount, "timestamp" FROM flat, b WHERE "timestamp" // 1000 < b.cut
  UNION ALL
  SELECT op, CASE WHEN op <> 'd' THEN transaction_id END, CASE WHEN op <> 'd' THEN user_id END,
    CASE WHEN op <> 'd' THEN amount END, CASE WHEN op <> 'd' THEN "timestamp" END
  FROM env, b WHERE ts_ms >= b.cut""")
def q_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table state before day 15 as a snapshot (op r) followed by later changes."""
    env = _env(spark, sf_dir)
    cut = env.select(F.min("ts_ms") + 15 * 86_400_000).scalar()
    flat = cdc.cdc_flatten(env)
    snap = flat.filter(F.floor(F.col("timestamp") / 1000) < cut)
    changes = env.filter(F.col("ts_ms") >= cut)
    u = cdc.snapshot_then_stream(snap, changes)
    return u.select("op", "after.transaction_id", "after.user_id", "after.amount", "after.timestamp")


@register("S14_struct_flatten", f"""WITH {ENV_SQL}
  SELECT CASE WHEN op <> 'd' THEN transaction_id END AS after_transaction_id,
    CASE WHEN op <> 'd' THEN user_id END AS after_user_id, CASE WHEN op <> 'd' THEN amount END AS after_amount,
    CASE WHEN op <> 'd' THEN currency END AS after_currency, CASE WHEN op <> 'd' THEN "timestamp" END AS after_timestamp,
    'streaming' AS source_db, 'transactions' AS source_table, ts_ms AS source_ts_ms, op, ts_ms, "offset"
  FROM env""")
def q_struct_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cdc.struct_flatten(_env(spark, sf_dir), flatten=["after", "source"], as_json=["before"])
    return e.drop("before")


@register("S15_drop_nested", f"""WITH {ENV_SQL}
  SELECT op, ts_ms, "offset", '2024-02-01 00:00:00.000000' AS ingested_datetime FROM env""")
def q_drop_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.drop_nested(_env(spark, sf_dir), ingested_at="2024-02-01 00:00:00")
