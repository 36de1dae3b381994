"""Structured Streaming: file-source replay of CDC envelopes equals the batch
forms; restart from the checkpoint continues where it stopped."""

import json
import os
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agora.sources.changes import envelopes_from_events
from agora.sources.tables import read_table
from agora.streaming import alerts as S
from agora.streaming import cdc, sinks
from conftest import SF_SMALL


def _write_envelope_files(spark, path, n_files=4):
    """Envelopes derived from events, split by time into ``n_files`` JSON files."""
    env = envelopes_from_events(read_table(spark, SF_SMALL, "events"))
    rows = [json.loads(r[0]) for r in env.select(F.to_json(F.struct(*env.columns))).collect()]
    rows.sort(key=lambda r: (r["ts_ms"], r["offset"]))
    os.makedirs(path, exist_ok=True)
    size = (len(rows) + n_files - 1) // n_files
    chunks = [rows[i:i + size] for i in range(0, len(rows), size)]
    return chunks


def _dump(path, i, chunk):
    with open(f"{path}/part-{i:03d}.json", "w") as f:
        for r in chunk:
            f.write(json.dumps(r) + "\n")
    # The file source takes files by age; files of one moment would come in any order.
    os.utime(f"{path}/part-{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))


def _alert_stream(spark, src, ttl=None):
    stream = cdc.cdc_source(spark, src, max_files_per_trigger=1)
    tx = S.transactions(stream)
    return S.rolling_alert_stream(tx, window_days=7, threshold=900, state_ttl=ttl)


def _batch_alerts(spark):
    env = envelopes_from_events(read_table(spark, SF_SMALL, "events"))
    b = S.rolling_alert(S.transactions(env), window_days=7, threshold=900)
    return sorted((r.user_id, str(r.total_amount), r.bucket_count) for r in b.collect())


@pytest.mark.parametrize("ttl", [None, "5 seconds"])
def test_rolling_alert_stream_replay_equals_batch(spark, tmp_dir, ttl):
    src = f"{tmp_dir}/src"
    for i, ch in enumerate(_write_envelope_files(spark, src)):
        _dump(src, i, ch)
    name = f"alerts_{uuid.uuid4().hex[:6]}"
    q = (_alert_stream(spark, src, ttl).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((r.user_id, r.total_amount, r.bucket_count) for r in spark.sql(f"SELECT * FROM {name}").collect())
    assert got == _batch_alerts(spark)


def test_restart_from_checkpoint(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    chunks = _write_envelope_files(spark, src)
    out = f"{tmp_dir}/out"
    ck = f"{tmp_dir}/ckpt"

    def run():
        w = sinks.idempotent_parquet(out)
        q = (_alert_stream(spark, src).writeStream.foreachBatch(w).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
        q.awaitTermination(300)

    for i, ch in enumerate(chunks[:2]):
        _dump(src, i, ch)
    run()                                   # first two files; state saved in the checkpoint
    for i, ch in enumerate(chunks[2:], start=2):
        _dump(src, i, ch)
    run()                                   # resumes with state, reads only the new files
    got = sorted((r.user_id, r.total_amount, r.bucket_count) for r in spark.read.parquet(out).collect())
    assert got == _batch_alerts(spark)


def test_lake_sink_foreach_batch(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    chunks = _write_envelope_files(spark, src, n_files=2)
    _dump(src, 0, chunks[0])
    _dump(src, 1, chunks[0][:50])            # redelivery of the same offsets
    _dump(src, 2, chunks[1])
    lake = f"{tmp_dir}/lake"
    stream = cdc.cdc_source(spark, src, max_files_per_trigger=1)
    recs = sinks.lake_records(stream, "cdc.streaming.transactions")
    q = sinks.checkpointed_run(recs, lambda df, bid: sinks.write_lake_batch(df, lake), f"lake_{uuid.uuid4().hex[:6]}")
    q.awaitTermination(300)
    stored = spark.read.parquet(lake)
    n_env = sum(len(c) for c in chunks)
    assert stored.count() == n_env
    assert stored.select("offset").distinct().count() == n_env
    assert set(stored.columns) >= {"source_topic", "year", "month", "day", "payload"}


def test_cumulative_alert_stream_skips_what_it_has_seen(spark, tmp_dir):
    """An alert row per transaction over the threshold; a file delivered again changes nothing."""
    src, name, out = f"{tmp_dir}/src", f"cum_{uuid.uuid4().hex[:6]}", f"{tmp_dir}/out"
    chunks = _write_envelope_files(spark, src, n_files=3)
    for i, ch in enumerate([chunks[0], chunks[1], chunks[0] + chunks[1], chunks[2]]):
        _dump(src, i, ch)
        rows = S.cumulative_alert_stream(S.transactions(cdc.cdc_source(spark, src)), threshold=500)
        sinks.checkpointed_run(rows, sinks.idempotent_parquet(out), name, spark=spark).awaitTermination(300)
    pick = ["user_id", "total_amount", "transaction_count", "detected_at"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*pick).collect())
    env = envelopes_from_events(read_table(spark, SF_SMALL, "events"))
    want = sorted(tuple(r) for r in S.cumulative_alert(S.transactions(env), threshold=500).select(*pick).collect())
    assert got == want and len(got) > 0


@pytest.mark.parametrize("mode,expect_snapshot", [("initial", True), ("never", False)])
def test_snapshot_modes(spark, mode, expect_snapshot):
    env = envelopes_from_events(read_table(spark, SF_SMALL, "events"))
    snap = cdc.cdc_flatten(env).limit(5)
    out = cdc.snapshot_then_stream(snap, env.limit(3), mode)
    assert out.filter("op = 'r'").count() == (5 if expect_snapshot else 0)


def test_alert_upsert_stream_equals_batch(spark, tmp_dir):
    """S7 stream -> S9 upsert per micro-batch into a bucketed table == batch S9."""
    src = f"{tmp_dir}/src"
    for i, ch in enumerate(_write_envelope_files(spark, src)):
        _dump(src, i, ch)
    table = f"{tmp_dir}/alerts"
    rows = S.stream_alert_rows(_alert_stream(spark, src), window_days=7, threshold=900)
    q = sinks.checkpointed_run(rows, S.upsert_alerts_into(table, f"{tmp_dir}/stage"), f"upsert_{uuid.uuid4().hex[:6]}")
    q.awaitTermination(300)
    got = sorted((r.user_id, str(r.total_amount), r.bucket_count, str(r.detected_at), str(r.created_at))
                 for r in spark.read.parquet(table).collect())
    env = envelopes_from_events(read_table(spark, SF_SMALL, "events"))
    b = S.alert_upsert(S.rolling_alert(S.transactions(env), window_days=7, threshold=900).drop("transaction_count"))
    want = sorted((r.user_id, str(r.total_amount), r.bucket_count, str(r.detected_at), str(r.created_at))
                  for r in b.collect())
    assert got == want


def test_run_log_of_a_sink(spark, tmp_dir):
    """Run rows are written by the sink itself: rows and outcome of each batch; a failed batch leaves its row."""
    from agora.operators import runmetrics as L
    src, log = f"{tmp_dir}/src", f"{tmp_dir}/log"
    for i, ch in enumerate(_write_envelope_files(spark, src, n_files=3)):
        _dump(src, i, ch)

    def fails_late(df, batch_id):
        if batch_id == 2:
            raise RuntimeError("sink is full")
        df.write.mode("overwrite").parquet(f"{tmp_dir}/out/batch_id={batch_id}")

    def run(write):
        q = sinks.checkpointed_run(cdc.cdc_source(spark, src, max_files_per_trigger=1), sinks.logged(write, log, "load"), name, spark=spark)
        q.awaitTermination(300)

    name = f"logged_{uuid.uuid4().hex[:6]}"
    with pytest.raises(Exception, match="sink is full"):
        run(fails_late)
    found = sinks.run_log(spark, log)
    assert L.batch_success_rate(found).first().success_rate == 66.67
    run(lambda df, batch_id: df.write.mode("overwrite").parquet(f"{tmp_dir}/out/batch_id={batch_id}"))
    tp = L.op_throughput(sinks.run_log(spark, log)).collect()
    assert sorted(r.operation for r in tp) == ["load_batch_0", "load_batch_1", "load_batch_2"]
    assert sum(r.records for r in tp) == 1000 and all(r.records_per_second > 0 for r in tp)
    assert L.batch_success_rate(sinks.run_log(spark, log)).first().success_rate == 100.0


def test_state_of_an_idle_user_is_gone(spark, tmp_dir):
    """The watermark passes a user's last window, the state store has no row of it any more; late events don't count."""
    day = 86_400_000

    def change(offset, user, at, arrived):
        row = {"transaction_id": f"T{offset}", "user_id": user, "amount": "600.00", "currency": "USD", "timestamp": at * day * 1000}
        return {"after": row, "op": "c", "ts_ms": arrived, "offset": offset}

    files = [[change(1, "idle", 10, 10 * day), change(2, "busy", 10, 10 * day + 1)],
             [change(3, "busy", 15, 15 * day)],
             [change(4, "busy", 11, 15 * day + 10), change(5, "idle", 15, 15 * day + 20)]]
    src, name = f"{tmp_dir}/src", f"idle_{uuid.uuid4().hex[:6]}"
    os.makedirs(src)
    rows = []
    for i, f in enumerate(files):
        _dump(src, i, f)
        tx = S.transactions(cdc.cdc_source(spark, src), with_arrival=True)
        out = S.rolling_state_stream(tx, window_days=2, threshold=1000, state_ttl="5 seconds")
        q = sinks.checkpointed_run(out, lambda df, _: rows.extend(tuple(r) for r in df.collect()), name, spark=spark)
        q.awaitTermination(300)
        if i == 1:   # only the busy user has state
            assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    assert sorted(r[:2] + (r[4],) for r in rows) == [("busy", "late", 11 * day), ("idle", "expired", 13 * day)]


def test_invoice_landing_stream(spark, tmp_dir):
    """S11/S12 as a stream: duplicates across micro-batches land once."""
    src = f"{tmp_dir}/inv"
    os.makedirs(src)
    good = ('{"invoice_id":"%s","order_id":"o","customer_id":"c","seller_id":"s","product_category":"p",'
            '"item_price":1.5,"freight_value":1.0,"total_amount":2.5,"payment_type":"x","payment_installments":1,'
            '"order_status":"d","customer_city":"a","customer_state":"b","seller_city":"c","seller_state":"d",'
            '"timestamp":"t","source_system":"pos","processing_time_ms":3}')
    batches = [["I1", "I2", "I2"], ["I2", "I3"], ["I1", "BAD"]]
    for i, ids in enumerate(batches):
        with open(f"{src}/b{i}.json", "w") as f:
            for j, x in enumerate(ids):
                line = (good % x).replace("1.5", '"x"') if x == "BAD" else good % x
                f.write(json.dumps({"value": line, "seq": i * 10 + j}) + "\n")
    stream = spark.readStream.schema("value string, seq long").option("maxFilesPerTrigger", 1).json(src)
    out = f"{tmp_dir}/landing"
    q = sinks.checkpointed_run(stream, sinks.land_invoices_into(out, order=["seq"]), f"inv_{uuid.uuid4().hex[:6]}")
    q.awaitTermination(300)
    got = sorted(r.invoice_id for r in spark.read.parquet(out).collect())
    assert got == ["I1", "I2", "I3"]
    assert {f for f in os.listdir(out) if not f.startswith(("_", "."))} <= {f"bucket={i}" for i in range(sinks.BUCKETS)}


def test_invoice_is_parsed_once(spark):
    """No filter of the checks moves down to where the message is made, to parse it again for every field."""
    from agora.plans.catalog import queries
    for name in ("S11_invoice_landing", "S11_invoice_landing_strict"):
        plan = queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1, name


class _GroupState:
    """A state row in memory; a timeout is a call without rows."""
    hasTimedOut, exists, mark = False, False, 0

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists = False

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        assert at > self.mark
        self.at = at


def test_users_of_a_group_are_apart():
    """A state row of many users gives each what a row of their own gave, redeliveries and late events included."""
    rng = np.random.default_rng(5)
    n = 600
    rows = pd.DataFrame({"user_id": rng.choice([f"u{i}" for i in range(20)], n), "cents": rng.choice([1, 2, 150, 40_000], n),
                         "event_time_ms": np.sort(rng.integers(0, 20 * cdc.DAY_MS, n)) + rng.integers(0, 2 * cdc.DAY_MS, n),
                         "offset": np.arange(n)})
    batches = [rows[:250], pd.concat([rows[100:400], rows[150:200]]).sample(frac=1, random_state=1), rows[400:]]
    fn, group, got, want = S._rolling_group_state(3, 50_000, False), _GroupState(), [], []
    one, alone = S._rolling_state(3, 50_000, False), {}
    totals, sums, total_rows = S._total_group_state(90_000), _GroupState(), []
    for b in batches:
        for out in fn((0,), iter([b[:70], b[70:]]), group):
            got += list(out.itertuples(index=False, name=None))
        for out in totals((0,), iter([b]), sums):
            total_rows += list(out.itertuples(index=False, name=None))
        for user, own in b.groupby("user_id"):
            for out in one((user,), iter([own]), alone.setdefault(user, _GroupState())):
                want += list(out.itertuples(index=False, name=None))
    assert sorted(got) == sorted(want) and len(got) > 100
    assert sorted(group.get[0]) == sorted(alone)
    run = rows.assign(total=rows.groupby("user_id")["cents"].cumsum(), k=rows.groupby("user_id").cumcount() + 1)
    over = run[run["total"] >= 90_000][["user_id", "total", "k", "event_time_ms"]]
    assert sorted(total_rows) == sorted(over.itertuples(index=False, name=None)) and len(total_rows) > 100


def test_only_idle_users_of_a_group_expire():
    """The group's timeout is that of its first idle user; the others keep their state."""
    day, fn, state = cdc.DAY_MS, S._rolling_group_state(2, 1000, True), _GroupState()
    frame = lambda *r: pd.DataFrame(r, columns=["user_id", "cents", "event_time_ms", "offset"])
    assert not list(fn((0,), iter([frame(("idle", 600, 10 * day, 1), ("busy", 600, 12 * day, 2))]), state))
    assert state.at == 13 * day
    state.mark, state.hasTimedOut = 13 * day + 1, True
    out = pd.concat(fn((0,), iter([frame()]), state))
    assert out[["user_id", "kind", "event_time_ms"]].values.tolist() == [["idle", "expired", 13 * day]]
    assert state.get[0] == ["busy"] and state.at == 15 * day
    state.mark, state.hasTimedOut = 15 * day + 1, False
    # Rows in the batch keep a user's state; what came late counts nowhere.
    out = pd.concat(fn((0,), iter([frame(("busy", 600, 13 * day, 3), ("new", 2000, 16 * day, 4))]), state))
    assert sorted(out[["user_id", "kind"]].values.tolist()) == [["busy", "late"], ["new", "alert"]]
    state.mark, state.hasTimedOut = 19 * day + 1, True
    assert sorted(pd.concat(fn((0,), iter([frame()]), state))["user_id"]) == ["busy", "new"] and not state.exists


def test_state_rows_are_bounded_by_groups(spark, tmp_dir, monkeypatch):
    """Users share state rows, so calls don't grow with the users; the alerts stay those of the batch form."""
    monkeypatch.setattr(S, "USER_GROUPS", 2)
    src, out = f"{tmp_dir}/src", f"{tmp_dir}/out"
    for i, ch in enumerate(_write_envelope_files(spark, src, n_files=2)):
        _dump(src, i, ch)
    q = sinks.checkpointed_run(_alert_stream(spark, src), sinks.idempotent_parquet(out), f"groups_{uuid.uuid4().hex[:6]}")
    q.awaitTermination(300)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    got = sorted((r.user_id, r.total_amount, r.bucket_count) for r in spark.read.parquet(out).collect())
    assert got == _batch_alerts(spark) and len({r[0] for r in got}) > 2


def test_alerts_of_an_upsert_are_found_once(spark):
    """What is put into the table reads the alerts that were found, not the changes again."""
    from agora.plans.catalog import queries
    files = queries()["S9_alert_upsert_into_target"](spark, SF_SMALL).inputFiles()
    assert files and all("/found_alerts-" in f or "/user_alerts-" in f for f in files)
