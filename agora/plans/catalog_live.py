"""Registered queries that run as streams.

The ``events`` table's changes are delivered as JSON files; a Structured Streaming query
reads them through ``cdc_source``, ends with each delivery, and goes on from its
checkpoint with the next, which also brings the first delivery's changes again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runmetrics as L
from ..session import checkpoint_dir
from ..sources.changes import captured_late, envelopes_from_events
from ..sources.tables import read_table
from ..streaming import alerts as S
from ..streaming import cdc, sinks
from ..streaming.replay import play
from .catalog import register
from .catalog_streaming import ENV_SQL, LAKE_COLS, LAKE_SQL, TOPIC, _alert_sql

CUMULATIVE_SQL = f"""WITH {ENV_SQL},
  tx AS (SELECT user_id, abs(TRY_CAST(amount AS DECIMAL(12,2))) AS amount, "timestamp" // 1000 AS ms,
           "offset" AS tie FROM env
         WHERE op IN ('c', 'u', 'r') AND user_id IS NOT NULL AND TRY_CAST(amount AS DECIMAL(12,2)) IS NOT NULL),
  r AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY ms, tie ROWS UNBOUNDED PRECEDING) AS total,
          row_number() OVER (PARTITION BY user_id ORDER BY ms, tie) AS n FROM tx)
  SELECT user_id, CAST(total AS DOUBLE) AS total_amount, CAST(n AS INT) AS transaction_count, 'HIGH_VALUE_USER' AS alert_type,
    'User ' || user_id || ' spent $' || CAST(CAST(total AS DECIMAL(12,2)) AS VARCHAR) || ' total' AS message,
    strftime(epoch_ms(ms), '%Y-%m-%d %H:%M:%S.%f') AS detected_at FROM r WHERE total >= 3000.00"""


def _place(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/agora/live/{tag}-{uuid.uuid4().hex}"


def _env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes_from_events(read_table(spark, sf_dir, "events"))


def _played(spark: SparkSession, env: DataFrame, tag: str, made: Callable[[DataFrame], DataFrame],
            write: Callable[[str], Callable[[DataFrame, int], None]], parts: int = 3, again: bool = True) -> str:
    """Play ``env`` through ``made`` into the sink that ``write(folder)`` gives; returns that folder."""
    place = _place(spark, tag)
    name, folder = place.rsplit("/", 1)[1], f"{place}/table"
    play(env, f"{place}/changes", lambda: sinks.checkpointed_run(made(cdc.cdc_source(spark, f"{place}/changes")), write(folder), name),
         parts, again)
    return folder


@register("S1_cdc_source", f"""WITH {ENV_SQL}
  SELECT "offset", op, ts_ms, CASE WHEN op <> 'c' THEN transaction_id END AS before_transaction_id,
    CASE WHEN op <> 'd' THEN transaction_id END AS after_transaction_id,
    CASE WHEN op <> 'd' THEN user_id END AS after_user_id,
    CASE WHEN op <> 'd' THEN amount END AS after_amount,
    CASE WHEN op <> 'd' THEN "timestamp" END AS after_timestamp,
    'transactions' AS source_table FROM env""")
def q_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes as the source delivers them, key fields flattened."""
    folder = _played(spark, _env(spark, sf_dir), "source", lambda e: e, sinks.idempotent_parquet, again=False)
    e = spark.read.parquet(folder)
    return e.select("offset", "op", "ts_ms",
                    F.col("before.transaction_id").alias("before_transaction_id"),
                    F.col("after.transaction_id").alias("after_transaction_id"),
                    F.col("after.user_id").alias("after_user_id"),
                    F.col("after.amount").alias("after_amount"),
                    F.col("after.timestamp").alias("after_timestamp"),
                    F.col("source.table").alias("source_table"))


def _expiry_sql(window_days: int, parts: int) -> str:
    """Late and expired rows: watermark after a delivery = its latest capture less 5 s."""
    return f"""WITH {ENV_SQL},
  cap AS (SELECT user_id, "timestamp" // 1000 AS ms, op, "offset",
      ts_ms + CASE WHEN "offset" % 40 = 7 THEN 3 * 86400000 ELSE 0 END AS ts_ms FROM env),
  b AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM cap),
  part AS (SELECT cap.*, (SELECT count(*) FROM range({parts - 1}) r(i) WHERE cap.ts_ms > lo + (hi - lo) * (i + 1) // {parts}) AS k
           FROM cap, b),
  mark AS (SELECT k, max(ts_ms) FILTER (WHERE op <> 'd') - 5000 AS own FROM part GROUP BY k),
  wm AS (SELECT k, max(own) OVER (ORDER BY k) AS wm_after, coalesce(max(own) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
           AND 1 PRECEDING), 0) AS wm_before FROM mark),
  tx AS (SELECT part.*, part.ms < wm.wm_before AS late FROM part JOIN wm USING (k) WHERE op <> 'd'),
  ends AS (SELECT user_id, wm.k, wm.wm_after, (max(ms // 86400000) + {window_days + 1}) * 86400000 AS gone
           FROM tx JOIN wm ON tx.k <= wm.k AND NOT late GROUP BY ALL)
  SELECT user_id, 'late' AS kind, ms AS event_time_ms FROM tx WHERE late
  UNION ALL SELECT DISTINCT user_id, 'expired', gone FROM ends WHERE gone < wm_after"""


@register("S6_watermark", _expiry_sql(2, 5))
def q_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last window the watermark has passed, and events that came behind it.

    Every 40th change is captured three days late; windows are two days long."""
    def made(env: DataFrame) -> DataFrame:
        tx = S.transactions(env, with_arrival=True)
        return S.rolling_state_stream(tx, window_days=2, threshold=900, state_ttl="5 seconds").filter("kind <> 'alert'")

    env = captured_late(_env(spark, sf_dir))
    folder = _played(spark, env, "expiry", made, sinks.idempotent_parquet, parts=5, again=False)
    return spark.read.parquet(folder).select("user_id", "kind", "event_time_ms")


@register("S7_rolling_alert_stream", f"""SELECT user_id, total_amount, bucket_count, alert_type, message, severity,
    detected_at, window_days, threshold_amount FROM ({_alert_sql(7, "900.00")})""")
def q_rolling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling alert as keyed state over three deliveries, one of them twice."""
    def made(env: DataFrame) -> DataFrame:
        found = S.rolling_alert_stream(S.transactions(env), window_days=7, threshold=900)
        return S.stream_alert_rows(found, window_days=7, threshold=900)

    return spark.read.parquet(_played(spark, _env(spark, sf_dir), "rolling", made, sinks.idempotent_parquet)).drop("batch_id")


@register("S8_cumulative_alert_stream", CUMULATIVE_SQL)
def q_cumulative_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert row for every transaction that leaves a user at 3000 or more, from keyed state."""
    def made(env: DataFrame) -> DataFrame:
        return S.cumulative_alert_stream(S.transactions(env, strict_truthiness=False))

    folder = _played(spark, _env(spark, sf_dir), "cumulative", made, sinks.idempotent_parquet)
    return spark.read.parquet(folder).select("user_id", "total_amount", "transaction_count", "alert_type", "message", "detected_at")


@register("S9_alert_upsert_stream", f"""WITH a AS ({_alert_sql(7, "900.00")})
  SELECT user_id, arg_max(total_amount, detected_at) AS total_amount, arg_max(bucket_count, detected_at) AS bucket_count,
    arg_max(message, detected_at) AS message, max(detected_at) AS detected_at, min(detected_at) AS created_at,
    max(detected_at) AS updated_at FROM a GROUP BY user_id""")
def q_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert table that micro-batches of rolling alerts leave: one row per user."""
    def made(env: DataFrame) -> DataFrame:
        found = S.rolling_alert_stream(S.transactions(env), window_days=7, threshold=900)
        return S.stream_alert_rows(found, window_days=7, threshold=900)

    folder = _played(spark, _env(spark, sf_dir), "upsert", made, lambda to: S.upsert_alerts_into(to, f"{to}-stage"))
    return spark.read.parquet(folder).select("user_id", "total_amount", "bucket_count", "message", "detected_at", "created_at", "updated_at")


@register("S16_checkpointed_run", f"{LAKE_SQL} SELECT {LAKE_COLS} FROM rec")
def q_checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lake after a run that stopped, went on from its checkpoint and read one delivery twice."""
    def write(to: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, batch_id: sinks.write_lake_batch(batch, to)

    folder = _played(spark, _env(spark, sf_dir), "lake", lambda e: sinks.lake_records(e, TOPIC), write)
    return spark.read.schema("source_topic string, partition int, offset long, timestamp string, object_id string, op string, "
                             "year int, month string, day string").parquet(folder).select(
        "source_topic", "partition", "offset", "timestamp", "year", "month", "day", "object_id", "op")


@register("L1_run_log_of_stream", f"""WITH {ENV_SQL},
  b AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM env),
  part AS (SELECT (SELECT count(*) FROM range(2) r(i) WHERE env.ts_ms > lo + (hi - lo) * (i + 1) // 3) AS k FROM env, b)
  SELECT 'land_changes_batch_' || k AS operation, count(*) AS records, 'ok' AS status, true AS rate_ok FROM part GROUP BY k""")
def q_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run rows that a sink leaves, with their rate; durations differ from run to run, so the rate is checked against them."""
    log = _place(spark, "log")
    _played(spark, _env(spark, sf_dir), "logged", lambda e: e.select("offset", "op"),
            lambda to: sinks.logged(sinks.idempotent_parquet(to), log, "land_changes"), again=False)
    found = L.op_throughput(sinks.run_log(spark, log))
    return found.select("operation", "records", "status", (F.abs(
        F.col("records_per_second") * F.col("duration_seconds") - F.col("records")) <= 0.01 * F.col("duration_seconds")).alias("rate_ok"))
