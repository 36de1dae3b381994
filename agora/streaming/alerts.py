"""Spending alerts: rolling bucketed window (S7), cumulative (S8), upsert (S9), idle users.

Batch forms are scans over rows dealt out by ranges of (user, time) (``operators.ordered``):
no task has to hold a user's history. Streaming forms keep state per user and work on a
micro-batch's amounts as whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import merge_into_partitions
from ..operators.ordered import inside, running, running_totals, slices
from .cdc import DAY_MS, cdc_flatten
from .sinks import bucket_of

# Fixed values of the alert jobs.
THRESHOLD = Decimal("3000.00")
WINDOW_DAYS = 30
ALERT_TYPE = "HIGH_VALUE_USER"
SEVERITY = "HIGH"
MONEY = "decimal(12,2)"


def transactions(env_or_flat: DataFrame, strict_truthiness: bool = True, with_arrival: bool = False) -> DataFrame:
    """Accepted transactions as (user_id, amount=|amount| decimal, event_time_ms, tie).
    ``with_arrival`` adds arrived_ms, the envelope's own time.

    Amounts arrive as text; text that is not a number is dropped here (it
    would stop the original job).  ``strict_truthiness=False`` is the SQL
    job's filter (NULL checks only) used by the cumulative alert.
    """
    kept = ("topic", "partition", "offset", "ts_ms") if with_arrival else ("topic", "partition", "offset")
    flat = (cdc_flatten(env_or_flat, strict_truthiness, kept) if "after" in env_or_flat.columns else env_or_flat)
    tie = F.col("offset") if "offset" in flat.columns else F.col("transaction_id")
    return flat.select(
        "user_id",
        F.abs(F.col("amount").try_cast(MONEY)).alias("amount"),
        F.floor(F.col("timestamp") / 1000).alias("event_time_ms"),
        tie.alias("tie"), *([F.col("ts_ms").alias("arrived_ms")] if with_arrival else [])).filter(F.col("amount").isNotNull())


def fired(totals: np.ndarray, threshold: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """Which totals (cents, in order) alert, and the last alerted total after them.

    A total alerts when it reaches the threshold and no alert stands or it differs by
    more than a cent from the last alerted one; a total below the threshold takes the
    alert back. Behind a total below, or a step of more than two cents, the alert is
    certain whatever came before; only smaller steps ask for the last alerted total.
    """
    n = len(totals)
    over = totals >= threshold
    step = np.abs(np.diff(totals))
    certain = np.zeros(n, dtype=bool)
    certain[1:] = over[1:] & (~over[:-1] | (step > 2))
    certain[0] = over[0] and (last is None or abs(int(totals[0]) - last) > 1)
    latest = np.maximum.accumulate(np.where(certain, np.arange(n), -1))
    alert, small = certain.copy(), -1
    for i in np.flatnonzero(over[1:] & ~certain[1:] & (step > 0)) + 1:
        j = max(int(latest[i]), small)
        held = int(totals[j]) if j >= 0 else last
        if held is None or abs(int(totals[i]) - held) > 1:
            alert[i], small = True, int(i)
    if not over[-1]:
        return alert, None
    hits = np.flatnonzero(alert)
    return alert, int(totals[hits[-1]]) if len(hits) else last


def small_step_alerts(small: DataFrame, threshold: int) -> DataFrame:
    """Alerts among steps of one or two cents, where the last alerted total decides.

    ``small`` has user_id, chain (what the steps since one certain alert share), _slice,
    cents (total), prev_cents (the one before), event_time_ms, tie, _place. After a total T the
    last alerted total is T, a cent more or a cent less; so a slice's part of a chain is
    a map of three cases. The maps of a chain are put one after another (one row per
    slice), then every part runs from the case that its predecessors lead to.
    """
    order = ["event_time_ms", "tie", "_place"]
    part = ["user_id", "chain", "_slice"]

    def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        totals, before = pdf["cents"].to_numpy(), int(pdf["prev_cents"].iloc[0])
        ends = [fired(totals, threshold, before + case)[1] - int(totals[-1]) for case in (-1, 0, 1)]
        return pdf[part].head(1).assign(ends=[ends])

    def led(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        case, start = 0, []
        for ends in pdf["ends"]:
            start.append(case)
            case = int(ends[case + 1])
        return pdf[part].assign(case=start)

    def applied(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        alert, _ = fired(pdf["cents"].to_numpy(), threshold, int(pdf["prev_cents"].iloc[0]) + int(pdf["case"].iloc[0]))
        return pdf[alert].drop(columns="case")

    keys = ", ".join(f"{c} {small.schema[c].dataType.simpleString()}" for c in part)
    maps = small.select(*part, *order, "cents", "prev_cents").groupBy(*part).applyInPandas(mapped, f"{keys}, ends array<int>")
    starts = maps.groupBy("user_id", "chain").applyInPandas(led, f"{keys}, case int")
    return small.join(starts, part).groupBy(*part).applyInPandas(applied, small.schema)


def rolling_alert(tx: DataFrame, window_days: int = WINDOW_DAYS, threshold=THRESHOLD) -> DataFrame:
    """S7 batch form: per-user day buckets over [day - window_days, day].

    Arrival order is taken as (event_time_ms, tie). An event alerts when its window
    total reaches ``threshold`` and there is no alert since the user's total was last
    below it, or the last *alerted* total differs by more than 0.01 (decimal
    arithmetic). ``bucket_count`` is the number of active days in the window (what the
    alert row calls transaction_count); ``transaction_count`` counts events.
    """
    t = slices(tx.filter(F.col("user_id").isNotNull()).withColumn("day", F.floor(F.col("event_time_ms") / DAY_MS).cast("int")),
               ["user_id"], ["event_time_ms", "tie"], "alerts")
    days = t.groupBy("user_id", "day").agg(F.sum("amount").alias("ds"), F.count(F.lit(1)).alias("dn"))
    back = Window.partitionBy("user_id").orderBy("day").rangeBetween(-window_days, -1)
    days = days.select(
        "user_id", "day",
        F.coalesce(F.sum("ds").over(back), F.lit(0)).alias("prev_sum"),
        F.coalesce(F.sum("dn").over(back), F.lit(0)).alias("prev_n"),
        F.count("ds").over(back).alias("prev_days"),
        "ds")
    # Total at the last event of the previous active day, for the first event of a day.
    days = days.withColumn("prev_day_end", F.lag(F.col("prev_sum") + F.col("ds")).over(
        Window.partitionBy("user_id").orderBy("day"))).drop("ds")
    keys, order = ["user_id", "day"], ["event_time_ms", "tie"]
    j = running(t, keys, order, "amount", days, keys)
    cents = lambda c: (c * 100).cast("long")
    total = (F.col("prev_sum") + F.col("run_sum")).cast(MONEY)
    j = j.withColumn("total", total).withColumn("prev_total", F.when(F.col("run_n") > 1, F.col("total") - F.col("amount"))
                                                .otherwise(F.col("prev_day_end")))
    j = j.withColumn("cents", cents(F.col("total"))).withColumn("prev_cents", cents(F.col("prev_total")))
    th = F.lit(threshold).cast(MONEY)
    step = F.abs(F.col("cents") - F.col("prev_cents"))
    over, known = F.col("total") >= th, F.coalesce(F.col("prev_total") >= th, F.lit(False))
    j = j.withColumn("certain", over & (~known | (step > 2)))
    # Steps of one or two cents belong to the chain of the last certain alert before them.
    window, _ = inside(keys, order)
    at = F.struct("event_time_ms", "tie", "_place")
    j = j.withColumn("chain", F.max(F.when(F.col("certain"), at)).over(window))
    fields = ["user_id", "day", "_slice", "event_time_ms", "tie", "_place", "total", "cents", "prev_cents", "prev_days", "prev_n", "run_n"]
    small = j.filter(over & known & (step > 0) & (step <= 2)).select(*fields, "chain")
    ends = j.groupBy("user_id", "day", "_slice").agg(F.max(F.when(F.col("certain"), at)).alias("end"))
    earlier = ends.withColumn("carried", F.max("end").over(
        Window.partitionBy("user_id").orderBy("day", "_slice").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    small = small.join(earlier, ["user_id", "day", "_slice"]).withColumn("chain", F.xxhash64(F.coalesce("chain", "carried"))).drop("carried")
    alerts = j.filter("certain").select(*fields).unionByName(
        small_step_alerts(small, int(Decimal(str(threshold)) * 100)).select(*fields))
    return alerts.select(
        "user_id",
        F.col("total").alias("total_amount"),
        (F.col("prev_days") + 1).cast("int").alias("bucket_count"),
        (F.col("prev_n") + F.col("run_n")).cast("int").alias("transaction_count"),
        F.lit(ALERT_TYPE).alias("alert_type"),
        F.concat(F.lit("User spent $"), F.col("total").cast("string"), F.lit(f" in last {window_days} days")).alias("message"),
        F.lit(SEVERITY).alias("severity"),
        F.timestamp_millis("event_time_ms").cast("timestamp_ntz").alias("detected_at"),
        F.lit(window_days).alias("window_days"),
        th.alias("threshold_amount"),
    )


def cumulative_alert(tx: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """S8 batch form: lifetime running sum and count per user in arrival order;
    every transaction at or above the threshold emits (updates count again)."""
    r = running_totals(tx.filter(F.col("user_id").isNotNull()), ["user_id"], ["event_time_ms", "tie"], "amount")
    return cumulative_rows(r.withColumn("total", F.col("run_sum").cast(MONEY)), threshold)


def cumulative_rows(r: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """Alert rows of running totals (user_id, total, run_n, event_time_ms)."""
    total = F.col("total")
    th = F.lit(threshold).cast(MONEY)
    ts = F.timestamp_millis("event_time_ms").cast("timestamp_ntz")
    return r.filter(total >= th).select(
        "user_id", total.alias("total_amount"), F.col("run_n").cast("int").alias("transaction_count"),
        F.lit(ALERT_TYPE).alias("alert_type"),
        F.concat(F.lit("User "), F.col("user_id"), F.lit(" spent $"), total.cast("string"), F.lit(" total"))
        .alias("message"),
        F.lit(SEVERITY).alias("severity"), ts.alias("detected_at"), F.lit(WINDOW_DAYS).alias("window_days"),
        th.alias("threshold_amount"), ts.alias("created_at"), ts.alias("updated_at"))


def alert_upsert(alerts: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """One row per user, newest alert wins; created_at of an existing row
    is kept, everything else is replaced. ``target`` is the current table."""
    fields = [c for c in alerts.columns if c not in ("user_id", "created_at", "updated_at")]
    latest = alerts.groupBy("user_id").agg(
        F.max_by(F.struct(*fields), "detected_at").alias("a"),
        F.min("detected_at").alias("first_at"))
    new = latest.select("user_id", "a.*", F.col("first_at").alias("created_at"),
                        F.col("a.detected_at").alias("updated_at"))
    if target is None:
        return new
    old = target.select("user_id", F.col("created_at").alias("_old_created"))
    merged = new.join(old, "user_id", "left").withColumn(
        "created_at", F.coalesce("_old_created", "created_at")).drop("_old_created")
    untouched = target.join(new.select("user_id"), "user_id", "left_anti")
    return untouched.unionByName(merged.select(target.columns))


# ---------------------------------------------------------------------------
# Streaming forms: keyed state per user (RocksDB state store)
# ---------------------------------------------------------------------------
BUCKET_STATE = "days array<long>, cents array<long>, last_alert long, offset long"
ROLLING_OUT = "user_id string, kind string, cents long, bucket_count int, event_time_ms long"
ROLLING_COLUMNS = [c.split()[0] for c in ROLLING_OUT.split(", ")]
TOTAL_OUT = "user_id string, cents long, run_n long, event_time_ms long"


def arrivals(pdfs: Iterator[pd.DataFrame], seen: int | None) -> pd.DataFrame:
    """A user's rows of a micro-batch in order of arrival; offsets seen before are redeliveries."""
    rows = pd.concat(list(pdfs), ignore_index=True).drop_duplicates("offset").sort_values("offset")
    return rows if seen is None else rows[rows["offset"] > seen]


def window_totals(buckets: dict[int, int], days: np.ndarray, cents: np.ndarray, window_days: int) -> tuple[np.ndarray, np.ndarray]:
    """Window total and number of active days at each amount, in order; ``buckets`` become those left.

    Amounts of one day that follow each other share their other buckets, so each such
    stretch is one running sum. Buckets before a stretch's window are dropped for good;
    those after its day (it came late) wait.
    """
    totals, active = np.empty(len(days), dtype=np.int64), np.empty(len(days), dtype=np.int32)
    starts = np.flatnonzero(np.diff(days, prepend=days[0] - 1))
    for start, stop in zip(starts, [*starts[1:], len(days)]):
        day = int(days[start])
        for old in [d for d in buckets if d < day - window_days]:
            del buckets[old]
        sums = buckets.get(day, 0) + np.cumsum(cents[start:stop])
        totals[start:stop] = sums + sum(c for d, c in buckets.items() if d < day)
        active[start:stop] = 1 + sum(d < day for d in buckets)
        buckets[day] = int(sums[-1])
    return totals, active


def _rolling_state(window_days: int, threshold: int, expire: bool):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            # The arrival clock has passed the user's last window: nothing left counts any more.
            last_day = max(state.get[0])
            state.remove()
            yield pd.DataFrame([(key[0], "expired", None, None, (last_day + window_days + 1) * DAY_MS)], columns=ROLLING_COLUMNS)
            return
        days, held, last, seen = state.get if state.exists else ([], [], None, None)
        buckets = dict(zip(days, held))
        rows, late = arrivals(pdfs, seen), None
        if expire and len(rows):
            # Behind the watermark: buckets that count with it may be gone.
            is_late = rows["event_time_ms"] < state.getCurrentWatermarkMs()
            late, rows = rows[is_late], rows[~is_late]
        seen = max([x for x in (seen, *([int(r["offset"].max()) for r in (rows, late) if r is not None and len(r)])) if x is not None],
                   default=None)
        if len(rows):
            ms = rows["event_time_ms"].to_numpy(np.int64)
            totals, active = window_totals(buckets, ms // DAY_MS, rows["cents"].to_numpy(np.int64), window_days)
            alert, last = fired(totals, threshold, last)
            yield pd.DataFrame({"user_id": key[0], "kind": "alert", "cents": totals[alert], "bucket_count": active[alert], "event_time_ms": ms[alert]})
        if late is not None and len(late):
            yield pd.DataFrame({"user_id": key[0], "kind": "late", "cents": late["cents"], "bucket_count": 0, "event_time_ms": late["event_time_ms"]})
        if buckets:
            state.update((sorted(buckets), [buckets[d] for d in sorted(buckets)], last, seen))
            if expire:
                state.setTimeoutTimestamp(max((max(buckets) + window_days + 1) * DAY_MS, state.getCurrentWatermarkMs() + 1))

    return fn


#: Users share a state row by the hash of their id: a call of Python costs milliseconds however few rows it gets, so
#: calls must not grow with the users. A row holds users / USER_GROUPS of them. Fixed for the life of a checkpoint.
USER_GROUPS = 8192
GROUP_BUCKET_STATE = ("users array<string>, n_days array<int>, days array<long>, cents array<long>, last_alert array<long>, "
                      "offset array<long>")
GROUP_TOTAL_STATE = "users array<string>, cents array<long>, n array<long>, offset array<long>"


def user_arrivals(pdfs: Iterator[pd.DataFrame], seen: Callable[[str], int | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Per user with rows in a micro-batch: user, cents, event times and offsets in order of arrival, each offset once;
    without the offsets up to the one that ``seen`` gives for the user."""
    parts = [p for p in pdfs if len(p)]
    if not parts:
        return
    column = lambda c: np.concatenate([p[c].to_numpy() for p in parts])
    codes, users = pd.factorize(column("user_id"))
    cents, ms, offset = (column(c).astype(np.int64) for c in ("cents", "event_time_ms", "offset"))
    order = np.lexsort((offset, codes))
    codes, cents, ms, offset = codes[order], cents[order], ms[order], offset[order]
    once = np.ones(len(codes), dtype=bool)
    once[1:] = (codes[1:] != codes[:-1]) | (offset[1:] != offset[:-1])
    codes, cents, ms, offset = codes[once], cents[once], ms[once], offset[once]
    ends = np.searchsorted(codes, np.arange(len(users)), side="right").tolist()
    start = 0
    for user, end in zip(users, ends):
        known = seen(user)
        if known is not None:
            start += int(np.searchsorted(offset[start:end], known, side="right"))
        yield user, cents[start:end], ms[start:end], offset[start:end]
        start = end


def _rolling_group_state(window_days: int, threshold: int, expire: bool):
    """``_rolling_state`` for all users of a group at once."""

    def held(state) -> dict[str, tuple[dict[int, int], int | None, int | None]]:
        if not state.exists:
            return {}
        users, n_days, days, cents, last, seen = state.get
        found, at = {}, 0
        for user, n, alerted, offset in zip(users, n_days, last, seen):
            found[user] = dict(zip(days[at:at + n], cents[at:at + n])), alerted, offset
            at += n
        return found

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = held(state)
        mark = state.getCurrentWatermarkMs() if expire else None
        gone = lambda buckets: (max(buckets) + window_days + 1) * DAY_MS
        out, came = [], set()

        def add(user: str, kind: str, cents, active, ms) -> None:
            out.append((np.full(len(ms), user, dtype=object), np.full(len(ms), kind, dtype=object), cents, active, ms))

        # A timeout brings no rows.
        for user, cents, ms, offset in user_arrivals(() if state.hasTimedOut else pdfs, lambda u: known[u][2] if u in known else None):
            came.add(user)
            if not len(offset):
                continue
            buckets, last, _ = known.get(user, ({}, None, None))
            seen = int(offset[-1])
            if expire and (late := ms < mark).any():
                # Behind the watermark: buckets that count with it may be gone.
                add(user, "late", cents[late], np.zeros(int(late.sum()), dtype=np.int32), ms[late])
                cents, ms = cents[~late], ms[~late]
            if len(ms):
                totals, active = window_totals(buckets, ms // DAY_MS, cents, window_days)
                alert, last = fired(totals, threshold, last)
                if alert.any():
                    add(user, "alert", totals[alert], active[alert], ms[alert])
            if buckets:
                known[user] = buckets, last, seen
        if expire:
            # The arrival clock has passed these users' last window: nothing left counts any more.
            idle = [u for u, (buckets, _, _) in known.items() if u not in came and gone(buckets) < mark]
            for user in idle:
                at = gone(known.pop(user)[0])
                add(user, "expired", np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int32), np.array([at]))
        if known:
            days = [sorted(buckets) for buckets, _, _ in known.values()]
            state.update((list(known), [len(d) for d in days], [d for ds in days for d in ds],
                          [buckets[d] for ds, (buckets, _, _) in zip(days, known.values()) for d in ds],
                          [last for _, last, _ in known.values()], [seen for _, _, seen in known.values()]))
            if expire:
                state.setTimeoutTimestamp(max(min(gone(buckets) for buckets, _, _ in known.values()), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(dict(zip(ROLLING_COLUMNS, (np.concatenate(c) for c in zip(*out)))))

    return fn


def _stateful_input(tx: DataFrame) -> DataFrame:
    arrived = F.col("arrived_ms") if "arrived_ms" in tx.columns else F.col("event_time_ms")
    return tx.select("user_id", (F.abs("amount") * 100).cast("long").alias("cents"), "event_time_ms", F.col("tie").cast("long").alias("offset"),
                     arrived.alias("arrived_ms"), F.pmod(F.xxhash64("user_id"), F.lit(USER_GROUPS)).cast("int").alias("user_group"))


def rolling_state_stream(tx: DataFrame, window_days: int = WINDOW_DAYS, threshold=THRESHOLD, state_ttl: str | None = None) -> DataFrame:
    """S7 streaming form with everything its state tells: rows of ``kind`` alert, late, expired.

    Events count in order of arrival (``tie``, the offset); offsets that were seen are
    skipped. State is at most ``window_days + 1`` buckets per user, kept by groups of
    users (``USER_GROUPS``). With ``state_ttl``
    (S6, e.g. ``'5 seconds'``) a watermark with that delay follows the clock of arrival
    (``arrived_ms``; where it is missing the event time, and Spark drops what is late
    itself): a user whose last window it has passed leaves an ``expired`` row and no
    state, and an event whose own time is behind it is a ``late`` row that counts in no
    total. Without it nothing expires and nothing is late, as in the original.
    """
    fn = _rolling_group_state(window_days, int(Decimal(str(threshold)) * 100), state_ttl is not None)
    t, timeout = _stateful_input(tx), "NoTimeout"
    if state_ttl is not None:
        t = t.withColumn("arrived_at", F.timestamp_millis("arrived_ms")).withWatermark("arrived_at", state_ttl)
        timeout = "EventTimeTimeout"
    return t.groupBy("user_group").applyInPandasWithState(fn, ROLLING_OUT, GROUP_BUCKET_STATE, "append", timeout)


def rolling_alert_stream(tx: DataFrame, window_days: int = WINDOW_DAYS, threshold=THRESHOLD,
                         state_ttl: str | None = None) -> DataFrame:
    """S7 streaming form: the alerts of ``rolling_state_stream`` (total_amount as text)."""
    found = rolling_state_stream(tx, window_days, threshold, state_ttl).filter("kind = 'alert'")
    return found.select("user_id", (F.col("cents").cast("decimal(20,0)") / 100).cast(MONEY).cast("string").alias("total_amount"),
                        "bucket_count", "event_time_ms")


def _total_group_state(threshold: int):
    columns = [c.split()[0] for c in TOTAL_OUT.split(", ")]

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = {u: held for u, *held in zip(*state.get)} if state.exists else {}
        out = []
        for user, cents, ms, offset in user_arrivals(pdfs, lambda u: known[u][2] if u in known else None):
            if not len(offset):
                continue
            held, n, _ = known.get(user, (0, 0, None))
            totals, count = held + np.cumsum(cents), n + np.arange(1, len(cents) + 1)
            known[user] = int(totals[-1]), int(count[-1]), int(offset[-1])
            over = totals >= threshold
            out.append((np.full(int(over.sum()), user, dtype=object), totals[over], count[over], ms[over]))
        state.update((list(known), *([held[i] for held in known.values()] for i in range(3))))
        if out:
            yield pd.DataFrame(dict(zip(columns, (np.concatenate(c) for c in zip(*out)))))

    return fn


def cumulative_alert_stream(tx: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """S8 streaming form: state is a user's total, number of transactions and last offset, by groups of users;
    every transaction that arrives at or above the threshold gives an alert row."""
    fn = _total_group_state(int(Decimal(str(threshold)) * 100))
    found = _stateful_input(tx).groupBy("user_group").applyInPandasWithState(fn, TOTAL_OUT, GROUP_TOTAL_STATE, "append", "NoTimeout")
    return cumulative_rows(found.withColumn("total", (F.col("cents").cast("decimal(20,0)") / 100).cast(MONEY)), threshold)


def stream_alert_rows(out: DataFrame, window_days: int = WINDOW_DAYS, threshold=THRESHOLD) -> DataFrame:
    """Alert rows (the batch ``rolling_alert`` columns, without the extra
    transaction_count) from the keyed-state output."""
    total = F.col("total_amount").cast(MONEY)
    return out.select(
        "user_id", total.alias("total_amount"), F.col("bucket_count").cast("int").alias("bucket_count"),
        F.lit(ALERT_TYPE).alias("alert_type"),
        F.concat(F.lit("User spent $"), total.cast("string"), F.lit(f" in last {window_days} days")).alias("message"),
        F.lit(SEVERITY).alias("severity"),
        F.timestamp_millis("event_time_ms").cast("timestamp_ntz").alias("detected_at"),
        F.lit(window_days).alias("window_days"), F.lit(threshold).cast(MONEY).alias("threshold_amount"))


def upsert_alerts_into(path: str, stage_path: str):
    """foreachBatch body for S9: merge a micro-batch of alerts into the alert table at
    ``path`` (one row per user, partitioned by a hash of the user). Only the buckets of
    the batch's users are read and replaced, by way of ``stage_path``. Replaying a batch
    gives the same table (newest alert wins, first ``created_at`` and ``severity`` kept)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        new = alert_upsert(batch).withColumn("bucket", bucket_of("user_id")).persist()
        try:
            if not new.isEmpty():
                replaced = [c for c in new.columns if c not in ("user_id", "bucket", "created_at", "severity")]
                merge_into_partitions(new, path, ["user_id"], ["bucket"], f"{stage_path}/{batch_id}", replaced)
        finally:
            new.unpersist()
    return write
