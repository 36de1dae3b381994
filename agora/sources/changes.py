"""Change envelopes and run logs derived from the given tables (fixed mapping rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def envelopes_from_events(events: DataFrame) -> DataFrame:
    """The ``events`` table as CDC envelopes of a
    ``transactions`` table (fixed mapping: every 50th event is a delete,
    views are updates, errors carry a negative amount)."""
    eid = F.col("event_id")
    amount = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))
    row = F.struct(
        F.concat(F.lit("T"), eid.cast("string")).alias("transaction_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        amount.cast("decimal(10,2)").cast("string").alias("amount"),
        F.lit("USD").alias("currency"),
        F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("timestamp"),
    )
    op = F.when(eid % 50 == 0, "d").when(F.col("event_type") == "view", "u").otherwise("c")
    ts_ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp_ltz")) / 1000)
    return events.select(
        F.when(op != "c", row).alias("before"),
        F.when(op != "d", row).alias("after"),
        F.struct(F.lit("streaming").alias("db"), F.lit("transactions").alias("table"),
                 ts_ms.alias("ts_ms")).alias("source"),
        op.alias("op"),
        ts_ms.alias("ts_ms"),
        eid.alias("offset"),
    )


def run_log_from_orders(orders: DataFrame) -> DataFrame:
    """A run log derived from the orders: one load operation per (status,
    purchase year) with its row count, a duration from the delivery days,
    and failed status for unfinished work."""
    y = F.year("order_purchase_timestamp")
    g = orders.groupBy("order_status", y.alias("year")).agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.coalesce(F.sum("delivery_days"), F.lit(0)) / 1000.0, 3).alias("duration_seconds"))
    return g.select(F.concat(F.lit("load_"), F.col("order_status"), F.lit("_"), F.col("year").cast("string"))
                    .alias("operation"), "records", "duration_seconds",
                    F.when(F.col("order_status") == "processing", "failed").otherwise("ok").alias("status"))


def captured_late(env: DataFrame, every: int = 40, days: int = 3) -> DataFrame:
    """Every ``every``-th change is captured ``days`` days after its own time; offsets follow the time of capture."""
    late = F.when(F.col("offset") % every == 7, F.lit(days * 86_400_000)).otherwise(F.lit(0))
    return (env.withColumn("ts_ms", F.col("ts_ms") + late)
            .withColumn("offset", F.col("ts_ms") * 1_000_000 + F.col("offset")))
