"""Pipeline and stream metrics (L1-L7) computed from run logs and event tables.

Trailing-time and trailing-row windows are read off running counts (``operators.ordered``):
rows are dealt out by ranges of time, so a busy hour is spread over as many tasks as its
share of the rows. No window sees the whole stream or a whole hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_totals


def op_throughput(run_log: DataFrame) -> DataFrame:
    """L1: records per second of each operation (0 when the duration is 0)."""
    d = F.col("duration_seconds")
    return run_log.withColumn("records_per_second",
                              F.when(d > 0, F.round(F.col("records") / d, 2)).otherwise(F.lit(0.0)))


def pipeline_summary(run_log: DataFrame) -> DataFrame:
    """L2: totals, fastest and slowest operation, overall rate (one row)."""
    g = run_log.agg(
        F.count(F.lit(1)).alias("operations"), F.sum("records").alias("total_records"),
        F.round(F.sum("duration_seconds"), 6).alias("total_duration_seconds"),
        F.min_by("operation", F.struct("duration_seconds", "operation")).alias("fastest_operation"),
        F.max_by("operation", F.struct("duration_seconds", F.col("operation"))).alias("slowest_operation"))
    d = F.col("total_duration_seconds")
    return g.withColumn("overall_records_per_second",
                        F.when(d > 0, F.round(F.col("total_records") / d, 2)).otherwise(F.lit(0.0)))


def batch_success_rate(run_log: DataFrame) -> DataFrame:
    """L3: ok / (ok + failed) * 100, rounded to 2; 100 when nothing ran."""
    g = run_log.agg(F.count_if(F.col("status") == "ok").alias("succeeded"),
                    F.count_if(F.col("status") == "failed").alias("failed"))
    n = F.col("succeeded") + F.col("failed")
    return g.withColumn("success_rate", F.when(n > 0, F.round(F.col("succeeded") * 100.0 / n, 2))
                        .otherwise(F.lit(100.0)))


def stream_throughput(events: DataFrame, ts: str = "ts", window_s: int = 60, id_col: str = "event_id") -> DataFrame:
    """L4: per event, events in the trailing ``window_s`` seconds (inclusive)
    and that count / ``window_s``.

    Each event leaves three marks on the time axis: itself, one before all events of
    the moment its window begins, and one behind all events of its own moment. The
    window's events are the difference of the running counts at the latter two.
    Events without a time have none.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp_ltz"))
    mark = lambda at, place, n, sign: F.struct(at.alias("_us"), F.lit(place).alias("_at"), F.lit(n).alias("_n"), F.lit(sign).alias("_sign"))
    marks = events.withColumn("_row", F.monotonically_increasing_id()).select(id_col, ts, "_row", F.inline(F.array(
        mark(us - window_s * 1_000_000, 0, 0, -1), mark(us, 1, 1, 0), mark(us, 2, 0, 1)))).where("_us is not null")
    r = running_totals(marks, [], ["_us", "_at"], "_n")
    c = r.where("_sign <> 0").groupBy("_row").agg(F.first(id_col).alias(id_col), F.first(ts).alias(ts),
                                                  F.sum(F.col("_sign") * F.col("run_sum")).alias("events_in_window"))
    return c.select(id_col, ts, "events_in_window",
                    F.round(F.col("events_in_window") / float(window_s), 6).alias("events_per_second"))


def stream_latency_avg(events: DataFrame, latency: str = "latency_ms", ts: str = "ts", id_col: str = "event_id",
                       last_n: int = 100) -> DataFrame:
    """Per event, the mean of the last ``last_n`` latencies (itself included)."""
    us = F.unix_micros(F.col(ts).cast("timestamp_ltz"))
    e = events.select(id_col, ts, F.col(latency).cast("double").alias("_lat"), us.alias("_us"))
    r = running_totals(e, [], ["_us", id_col], "_lat").withColumnsRenamed({"run_n": "g_rank", "run_sum": "g_sum"})
    back = r.select((F.col("g_rank") + last_n).alias("g_rank"), F.col("g_sum").alias("_s_back"))
    j = r.join(back, "g_rank", "left")
    n = F.least(F.col("g_rank"), F.lit(last_n))
    window_sum = F.col("g_sum") - F.coalesce(F.col("_s_back"), F.lit(0.0))
    return j.select(id_col, ts, "g_rank", F.round(window_sum / n, 6).alias("avg_latency_ms"))


def stream_error_rate(events: DataFrame, failed: Column) -> DataFrame:
    """Failed / (ok + failed) * 100, rounded to 2 (one row)."""
    g = events.agg(F.count_if(failed).alias("failed"), F.count_if(~failed).alias("succeeded"))
    n = F.col("failed") + F.col("succeeded")
    return g.withColumn("error_rate", F.when(n > 0, F.round(F.col("failed") * 100.0 / n, 2)).otherwise(F.lit(0.0)))


def error_type_counts(events: DataFrame, failed: Column, error_type: Column) -> DataFrame:
    """Failures per error type."""
    return events.filter(failed).groupBy(error_type.alias("error_type")).agg(F.count(F.lit(1)).alias("errors"))


def backlog_level(pct: Column, as_written: bool = False) -> Column:
    """> 95 % critical, > 80 % warning, else ok.  ``as_written`` tests
    > 80 first, which makes the critical branch unreachable."""
    if as_written:
        return F.when(pct > 80, "warning").when(pct > 95, "critical").otherwise("ok")
    return F.when(pct > 95, "critical").when(pct > 80, "warning").otherwise("ok")


def backlog_by_minute(events: DataFrame, ts: str = "ts", as_written: bool = False) -> DataFrame:
    """L7 on a stream table: per minute, events as a percentage of the busiest
    minute, and the backlog level."""
    m = events.groupBy(F.date_trunc("minute", F.col(ts)).alias("minute")).agg(F.count(F.lit(1)).alias("events"))
    peak = m.select(F.max("events")).scalar()
    pct = F.round(F.col("events") * 100.0 / peak, 6)
    return m.select("minute", "events", pct.alias("backlog_pct"), backlog_level(pct, as_written).alias("level"))
