"""Unit tests with hand-made rows for the cases the fixture tables cannot supply."""

import hashlib
from datetime import datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.functions import day_diff, surrogate_key
from agora.functions.keys import mask_hash
from agora.functions.text import chunk_spans, split_text
from agora.operators import ingest as A
from agora.operators import merge as I
from agora.operators import quality as H
from agora.operators import retrieval as R
from agora.operators import scd2 as G
from agora.operators import staging as B
from agora.operators.runmetrics import backlog_level
from agora.sources import files
from agora.sources.changes import envelopes_from_events
from agora.sources.contracts import CONTRACTS, Contract, schema_from_metadata
from agora.streaming import alerts as S
from agora.streaming import cdc
from agora.streaming import sinks
from agora.streaming.sinks import insert_if_absent, invoice_landing

# ---------------------------------------------------------------- masking


def test_mask_hash_normalises_and_keeps_null(spark):
    df = spark.createDataFrame([(None,), ("",), (" São Paulo ",), ("SÃO PAULO",), ("\tsão paulo ",)], "c string")
    out = [r[0] for r in df.select(mask_hash("c")).collect()]
    expect = hashlib.sha256("são paulo".encode()).hexdigest()
    assert out[0] is None
    assert out[1] == hashlib.sha256(b"").hexdigest()
    assert out[2] == out[3] == out[4] == expect


def test_apply_masks_skips_missing_and_partial(spark):
    df = spark.createDataFrame([("a", "B")], "customer_city string, other string")
    out = A.apply_masks(df, {"customer_city": "hash", "customer_state": "hash", "other": "partial"}).first()
    assert out.customer_city == hashlib.sha256(b"a").hexdigest()
    assert out.other == "B"

# ---------------------------------------------------------------- CSV


def test_csv_import_messy_file(spark, tmp_dir):
    path = f"{tmp_dir}/r.csv"
    with open(path, "w", newline="") as f:
        f.write("review_id,order_id,review_score,review_comment_title,review_comment_message,"
                "review_creation_date,review_answer_timestamp\r\n")
        f.write('R1,O1,5,,"line one\r\nline two",2020-01-01 00:00:00,\r\n')
        f.write('R2,O2,x,"a, b","say ""hi""",2020-01-02 00:00:00,\r\n')
        f.write('R3,O3,  ,  ,   ,,\r\n')
    rows = {r.review_id: r for r in files.csv_import(spark, path, CONTRACTS["order_reviews"],
                                                     newline_columns=["review_comment_message"]).collect()}
    assert rows["R1"].review_comment_message == "line one line two"
    assert rows["R1"].review_comment_title is None
    assert rows["R2"].review_score is None             # wrong type -> NULL
    assert rows["R2"].review_comment_title == "a, b"
    assert rows["R2"].review_comment_message == 'say "hi"'
    assert rows["R3"].review_comment_message is None   # blank -> NULL


def test_csv_stage_load_rejects_bad_rows(spark, tmp_dir):
    path = f"{tmp_dir}/c.csv"
    with open(path, "w") as f:
        f.write("c_custkey,c_name,c_acctbal,c_mktsegment\n1,a,10.5,X\n2,b,NULL,null\n3,c,abc,Y\n4,d,1.00,\n")
    c = Contract("c", (("c_custkey", "bigint", False), ("c_name", "string", True),
                       ("c_acctbal", "decimal(12,2)", True), ("c_mktsegment", "string", True)))
    loaded, rejected = files.csv_stage_load(spark, path, c)
    got = {r.c_custkey: r for r in loaded.collect()}
    assert set(got) == {1, 2, 4}
    assert got[2].c_acctbal is None and got[2].c_mktsegment is None
    assert got[4].c_mktsegment is None
    assert rejected.count() == 1

# ---------------------------------------------------------------- orphans (A3)


def test_orphan_prune_parents_first(spark):
    t = {
        "customers": spark.createDataFrame([("C1",)], "customer_id string"),
        "orders": spark.createDataFrame([("O1", "C1"), ("O2", "C9")], "order_id string, customer_id string"),
        "order_items": spark.createDataFrame(
            [("O1", 1, "P1", "S1"), ("O1", 2, None, "S1"), ("O2", 1, "P1", "S1"), ("O8", 1, "P1", "S1")],
            "order_id string, order_item_id int, product_id string, seller_id string"),
        "products": spark.createDataFrame([("P1",)], "product_id string"),
        "sellers": spark.createDataFrame([("S1",)], "seller_id string"),
        "order_payments": spark.createDataFrame([("O2", 1)], "order_id string, payment_sequential int"),
        "order_reviews": spark.createDataFrame([("R1", "O1")], "review_id string, order_id string"),
    }
    out = A.orphan_prune(t)
    assert sorted((r.order_id, r.order_item_id) for r in out["order_items"].collect()) == [("O1", 1), ("O1", 2)]
    assert out["order_payments"].count() == 0
    assert out["orders"].count() == 1

# ---------------------------------------------------------------- watermark


def _wm(spark):
    return spark.createDataFrame(
        [(1, datetime(2020, 1, 1)), (2, datetime(2020, 1, 5)), (3, datetime(2020, 1, 10)),
         (4, datetime(2020, 1, 20)), (5, None)], "id int, wm timestamp_ntz")


def test_watermark_slice_bounds(spark):
    df = _wm(spark)
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(A.watermark_slice(df, "wm", "2020-01-01", "2020-01-10")) == [2, 3]
    assert ids(A.watermark_slice(df, "wm", None, "2020-01-05")) == [1, 2]
    assert ids(A.watermark_slice(df, "wm", "2020-01-01", "2020-01-10", as_written=True)) == [2, 3, 4]


def test_state_init_advance_reset(spark):
    empty = spark.createDataFrame([], A.STATE_SCHEMA)
    tables = spark.createDataFrame([("t1", "wm", "incremental_by_watermark"), ("t2", "wm", "full_load")],
                                   "table_name string, watermark_column string, strategy string")
    s = A.state_init(empty, tables)
    s = A.state_init(s, tables)                    # idempotent
    assert s.count() == 2
    runs = spark.createDataFrame([("t1", datetime(2020, 1, 1), "incremental_by_watermark", None),
                                  ("t2", datetime(2020, 1, 1), "full_load", "incremental_by_watermark")],
                                 "table_name string, run_at timestamp_ntz, strategy string, original_strategy string")
    s1 = A.state_advance(s, runs)
    s2 = {r.table_name: r for r in A.state_advance(s1, runs.withColumn("run_at", F.lit(datetime(2020, 2, 1)))).collect()}
    assert s2["t1"].load_from == datetime(2020, 1, 1) and s2["t1"].load_at == datetime(2020, 2, 1)
    assert s2["t2"].load_at is None               # forced full load: not advanced
    r = {x.table_name: x for x in A.state_reset(A.state_advance(s1, runs), ["t1"]).collect()}
    assert r["t1"].load_at is None


def test_plan_tables_force_full(spark):
    meta = A.metadata_frame(spark, CONTRACTS)
    p = A.plan_tables(meta, force_full=True).collect()
    assert all(r.strategy == "full_load" for r in p) and p[0].pipeline_order == 1
    assert A.plan_tables(meta, only_strategy="incremental_by_watermark").count() == 0


def test_schema_from_metadata():
    st, pk = schema_from_metadata({"columns": [
        {"name": "id", "type": "varchar(36)", "primary_key": True},
        {"name": "amount", "type": "numeric(12,2)"},
        {"name": "location", "type": "object", "fields": [{"name": "city", "type": "text"}]}]})
    assert pk == ["id"]
    assert [f.name for f in st.fields] == ["id", "amount", "location_city", "ingested_datetime"]
    assert not st["id"].nullable

# ---------------------------------------------------------------- stamps, NULLs


def test_ingestion_stamp_and_null_normalise(spark):
    df = spark.createDataFrame([(1, datetime(2020, 1, 1)), (2, None)], "id int, ingestion_date timestamp_ntz")
    got = {r.id: r.ingestion_date for r in A.ingestion_stamp(df, "2024-01-01 00:00:00").collect()}
    assert got == {1: datetime(2020, 1, 1), 2: datetime(2024, 1, 1)}
    n = spark.createDataFrame([("NaN", float("nan")), ("null", 1.0), ("", 2.0), ("x", None)], "s string, d double")
    rows = A.null_normalise(n).collect()
    assert [r.s for r in rows] == [None, None, None, "x"]
    assert rows[0].d is None
    rc = A.rowcount_nonzero({"a": df, "b": df.limit(0)}).collect()
    assert {r.table_name: r.ok for r in rc} == {"a": True, "b": False}

# ---------------------------------------------------------------- datediff, CASE with NULL


def test_day_diff_counts_midnights(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 23, 59), datetime(2020, 1, 2, 0, 1)),
                                (datetime(2020, 1, 1, 1), datetime(2020, 1, 1, 23)),
                                (datetime(2020, 1, 3), datetime(2020, 1, 1)), (None, datetime(2020, 1, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(day_diff("a", "b")).collect()] == [1, 0, -2, None]


def test_case_null_falls_through(spark):
    p = spark.createDataFrame([("P1", None, None, 0, 1, 1, 1)],
                              "product_id string, product_category_name string, product_photos_qty int, "
                              "product_weight_g int, product_length_cm int, product_height_cm int, product_width_cm int")
    p = p.withColumn("product_name_length", F.lit(1)).withColumn("product_description_length", F.lit(1))
    r = B.stg_products(p).first()
    assert r.photo_category == "many_photos" and r.product_weight_kg is None
    rv = spark.createDataFrame([("R", "O", None, None, None, None, None)], CONTRACTS["order_reviews"].struct)
    assert B.stg_order_reviews(rv).first().review_sentiment == "negative"
    pay = spark.createDataFrame([("O", 1, "x", n, Decimal("10.00")) for n in (None, 0, 1, 3)],
                                CONTRACTS["order_payments"].struct)
    assert [r.installment_value for r in B.stg_order_payments(pay).collect()] == [10.0, 10.0, 10.0, 3.333333]


def test_surrogate_key_null_token(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    got = df.select(surrogate_key("x", "y")).first()[0]
    assert got == hashlib.md5(b"a-_dbt_utils_surrogate_key_null_").hexdigest()

# ---------------------------------------------------------------- merge


def test_upsert_and_schema_sync(spark):
    tgt = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, v string, gone string")
    src = spark.createDataFrame([(2, "B", 9), (3, "c", 9)], "k int, v string, new int")
    got = sorted(tuple(r) for r in I.upsert_by_key(tgt, src, ["k"]).collect())
    assert got == [(1, "a", None), (2, "B", 9), (3, "c", 9)]
    part = sorted(tuple(r) for r in I.upsert_by_key(tgt, src, ["k"], update_cols=["new"]).collect())
    assert part == [(1, "a", None), (2, "b", 9), (3, "c", 9)]
    assert sorted(tuple(r) for r in I.upsert_by_key(None, src, ["k"]).collect()) == [(2, "B", 9), (3, "c", 9)]


def test_merge_is_idempotent(spark):
    src = spark.createDataFrame([("k1", datetime(2020, 1, 1).date(), 1), ("k2", datetime(2020, 1, 2).date(), 2)],
                                "order_item_key string, purchase_date date, v int")
    once = I.merge_order_items(src.limit(1), src)
    twice = I.merge_order_items(once, src)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == sorted(map(tuple, src.collect()))


def test_merge_reviews_duplicate_ids(spark):
    src = spark.createDataFrame([("a", "R1", "2020-01-02"), ("b", "R1", "2020-01-03"), ("c", "R2", "2020-01-01")],
                                "review_key string, review_id string, review_creation_date string")
    out = sorted(tuple(r) for r in I.merge_reviews(None, src, key="review_id").collect())
    assert out == [("b", "R1", "2020-01-03"), ("c", "R2", "2020-01-01")]


# ---------------------------------------------------------------- SCD2


def test_scd2_run_touches_no_closed_version(spark, tmp_dir):
    """A run reads the open versions only, leaves closed files as they are, and can be run again after a failure."""
    import glob
    import os
    path = f"{tmp_dir}/h"
    day = lambda rows: spark.createDataFrame(rows, "id string, a string")
    days = [(day([("1", "x"), ("2", "y")]), "2024-01-01"), (day([("1", "z"), ("2", "y")]), "2024-01-02"),
            (day([("1", "z"), ("3", "n")]), "2024-01-03")]
    h = None
    for i, (d, at) in enumerate(days):
        G.snapshot_run(path, d, "id", ["a"], at)
        h = G.scd2_check(h, d, "id", ["a"], at)
        if i == 1:
            closed = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/closed/*/*.parquet")}
    assert closed and all(os.stat(f).st_mtime_ns == m for f, m in closed.items())
    plan = G.changed_versions(spark.read.parquet(f"{path}/open"), days[2][0], "id", ["a"], "2024-01-04").inputFiles()
    assert plan and not any("/closed/" in f for f in plan)
    G.snapshot_run(path, days[2][0], "id", ["a"], "2024-01-03")
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df.select("id", "a", *G.META).collect())
    assert rows(G.stored_history(spark, path)) == rows(h)


def test_upsert_is_one_join(spark):
    """Both sides are read once; other columns, null keys and new rows are as before."""
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k int, v string, w int")
    s = spark.createDataFrame([(2, "B", 21), (3, "c", 30), (None, "m", 1)], "k int, v string, w int")
    got = I.upsert_by_key(t, s, ["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, t.filter("k = 1 or k is null").union(s).collect()))
    part = I.upsert_by_key(t, s, ["k"], update_cols=["w"]).filter("k = 2").first()
    assert (part.v, part.w) == ("b", 21)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and plan.count("LogicalRDD") == 2


def test_scd2_three_days_and_rerun(spark):
    sch = "id string, a string"
    d1 = spark.createDataFrame([("a", "x"), ("b", "y")], sch)
    d2 = spark.createDataFrame([("a", "x2"), ("c", "z")], sch)
    d3 = spark.createDataFrame([("a", "x2"), ("b", None), ("c", "z")], sch)
    h = G.scd2_check(None, d1, "id", ["a"], "2024-01-01")
    h = G.scd2_check(h, d2, "id", ["a"], "2024-01-02")
    h = G.scd2_check(h, d3, "id", ["a"], "2024-01-03")
    again = G.scd2_check(h, d3, "id", ["a"], "2024-01-04")
    rows = sorted((r.id, r.a or "-", str(r.dbt_valid_from)[:10], str(r.dbt_valid_to)[:10] if r.dbt_valid_to else "-")
                  for r in h.collect())
    assert rows == [("a", "x", "2024-01-01", "2024-01-02"), ("a", "x2", "2024-01-02", "-"),
                    ("b", "-", "2024-01-03", "-"), ("b", "y", "2024-01-01", "2024-01-02"),
                    ("c", "z", "2024-01-02", "-")]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, again.collect())) == sorted(map(key, h.collect()))
    open_per_key = again.filter("dbt_valid_to IS NULL").groupBy("id").count().filter("count > 1").count()
    assert open_per_key == 0

# ---------------------------------------------------------------- quality (H)


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z"), (None, "a")], "k int, v string")
    assert H.dq_unique(df, "k").collect()[0].n_records == 2
    assert H.dq_not_null(df, "v").count() == 1
    assert H.dq_accepted_values(df, "v", ["a"]).count() == 1      # NULL passes
    s = H.dq_quality_score(df, ["k"], ["v"]).first()
    assert (s.total_records, s.null_records, s.duplicate_records) == (4, 1, 1)
    assert s.quality_score == 50.0 and s.quality_issue
    e = H.dq_quality_score(df.limit(0), ["k"]).first()
    assert e.quality_score == 0.0
    pk = H.dq_pk_check(df, ["k"]).first()
    assert not pk.unique_ok and not pk.not_null_ok


def test_rowcount_drop(spark):
    a = spark.range(95)
    b = spark.range(100)
    r = H.dq_rowcount_drop(a, b).first()
    assert r.passed and r.ratio == 0.95
    assert not H.dq_rowcount_drop(spark.range(94), b).first().passed


def test_suite_counts(spark):
    df = spark.createDataFrame([(1, -1.0), (1, 2.0), (None, 3.0)], "k int, x double")
    parent = spark.createDataFrame([(1,)], "k int")
    T_ = H.Test
    out = {r.test_name: r.failures for r in H.dq_suite("m", df, [
        T_("not_null", "k"), T_("unique", "k"), T_("accepted_range", "x", min_value=0),
        T_("relationships", "k", parent=parent, parent_key="k")]).collect()}
    assert out == {"not_null_k": 1, "unique_k": 1, "accepted_range_x": 1, "relationships_k": 0}

# ---------------------------------------------------------------- rolling alert


def _tx(spark, rows):
    return spark.createDataFrame(
        [(u, Decimal(a), (d * 86_400_000 + h * 3_600_000), i) for i, (u, a, d, h) in enumerate(rows)],
        "user_id string, amount decimal(12,2), event_time_ms long, tie long")


def test_rolling_alert_edges(spark):
    rows = [("u", "1500.00", 0, 1), ("u", "1500.00", 0, 2),   # exactly 3000 -> alert
            ("u", "0.01", 0, 3),                              # a cent from the alerted total -> none
            ("u", "0.01", 0, 4),                              # two cents from the alerted total -> alert
            ("u", "0.01", 0, 5),                              # a cent from that one -> none
            ("u", "0.00", 0, 6),                              # no change -> none
            ("u", "100.00", 31, 1),                           # day 0 is 31 days old -> evicted, below
            ("u", "3000.00", 31, 5)]                          # back over the threshold -> alert
    out = S.rolling_alert(_tx(spark, rows)).orderBy("detected_at").collect()
    assert [str(r.total_amount) for r in out] == ["3000.00", "3000.02", "3100.00"]
    # 31-day window: an event on day 30 still sees day 0
    late = S.rolling_alert(_tx(spark, [("u", "1.00", 0, 1), ("u", "3000.00", 30, 5), ("u", "1.00", 31, 5)])).orderBy("detected_at").collect()
    assert [(str(r.total_amount), r.bucket_count) for r in late] == [("3001.00", 2)]


def test_small_steps_across_slices(spark):
    """A chain of cent steps over many slices: the last alerted total is carried from slice to slice."""
    n = 3_000
    steps = [1, 1, 2, 0, 1, 2, 1, 1, 0, 1]
    rows = [("u", "3000.00", 0, 0)] + [("u", f"0.0{steps[i % 10]}", 0, 1) for i in range(n)]
    total = last = 300_000
    want = [total]
    for i in range(n):
        total += steps[i % 10]
        if abs(total - last) > 1:
            last = total
            want.append(total)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = S.rolling_alert(_tx(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(int(r.total_amount * 100) for r in got) == want


def test_hot_user_and_hot_moment_are_spread(spark):
    """A user with a third of the rows, and a moment with a third of them, fill no slice by themselves."""
    from agora.operators.ordered import running_totals, slices
    n = 24_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("user_id"),
                               F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("at"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys, order in ((["user_id"], ["at"]), ([], ["at"])):
            shares = slices(df, keys, order).groupBy("_slice").count().collect()
            assert len(shares) == 8 and max(r["count"] for r in shares) < 2 * n / 8
        tot = running_totals(df, ["user_id"], ["at"], "v")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    last = {r.user_id: (r.s, r.n) for r in tot.groupBy("user_id").agg(F.max("run_sum").alias("s"), F.max("run_n").alias("n")).collect()}
    size = {r.user_id: r["count"] for r in df.groupBy("user_id").count().collect()}
    assert last == {u: (c, c) for u, c in size.items()}
    assert tot.groupBy("user_id", "run_n").count().where("count > 1").count() == 0


def test_stream_metrics_with_equal_times(spark):
    """L4/L5 on rows of one moment, and on events at both ends of a window."""
    from agora.operators import runmetrics as L
    secs = [0, 0, 0, 59, 60, 60, 61, 200]
    df = spark.createDataFrame([(i, s, float(i)) for i, s in enumerate(secs)], "event_id long, s long, latency_ms double").select(
        "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "latency_ms")
    got = {r.event_id: r.events_in_window for r in L.stream_throughput(df).collect()}
    assert got == {i: sum(s - 60 <= x <= s for x in secs) for i, s in enumerate(secs)}
    avg = {r.event_id: r.avg_latency_ms for r in L.stream_latency_avg(df, last_n=3).collect()}
    assert avg == {i: round(sum(range(max(0, i - 2), i + 1)) / min(i + 1, 3), 6) for i in range(len(secs))}


def test_cumulative_alert(spark):
    tx = _tx(spark, [("u", "2999.99", 0, 1), ("u", "0.01", 0, 2), ("u", "5.00", 1, 1), ("v", "10.00", 0, 1)])
    out = S.cumulative_alert(tx).orderBy("detected_at").collect()
    assert [(r.user_id, str(r.total_amount), r.transaction_count) for r in out] == [("u", "3000.00", 2), ("u", "3005.00", 3)]
    assert out[0].message == "User u spent $3000.00 total"

# ---------------------------------------------------------------- CDC


def test_cdc_flatten_edge_cases(spark):
    row = lambda tid, user, amt, ts: (tid, user, amt, "USD", ts)
    data = [
        (None, row("T1", "u1", "10.00", 5), None, "c", 1),
        (row("T2", "u1", "1", 5), None, None, "d", 2),            # delete: after NULL
        (None, row("T3", None, "1", 5), None, "c", 3),            # user NULL
        (None, row("T4", "u1", "0", 5), None, "c", 4),            # amount '0' is text, and there
        (None, row("T5", "u1", "", 5), None, "u", 5),             # empty amount
        (None, row("T6", "u1", "abc", 5), None, "u", 6),          # kept here, NULL after cast
        (None, row("T7", "u1", "1", 0), None, "c", 7),            # timestamp 0
    ]
    schema = T.StructType(cdc.ENVELOPE_SCHEMA.fields[:3] + [cdc.ENVELOPE_SCHEMA["op"],
                                                            T.StructField("offset", T.LongType())])
    env = spark.createDataFrame(data, schema)
    ids = sorted(r.transaction_id for r in cdc.cdc_flatten(env).collect())
    assert ids == ["T1", "T4", "T6"]
    parsed = cdc.json_parse(cdc.cdc_to_json(cdc.cdc_flatten(env))).collect()
    assert sorted(r.event_time_ms for r in parsed) == [0, 0, 0]


def test_json_parse_drops_malformed(spark):
    msgs = spark.createDataFrame([('{"user_id":"u","amount":"1","timestamp_micros":1500,"op":"c"}',),
                                  ("not json",), ('{"user_id":"u","amount":"1"}',)], "value string")
    out = cdc.json_parse(msgs).collect()
    assert len(out) == 1 and out[0].event_time_ms == 1


def test_struct_flatten_and_drop_nested(spark):
    df = spark.createDataFrame([(1, {"city": "x", "zip": None}, None)],
                               "id int, location struct<city:string,zip:string>, card struct<n:string>")
    f = cdc.struct_flatten(df, flatten=["location"], as_json=["card"]).first()
    assert f.location_city == "x" and f.location_zip is None and f.card is None
    d = cdc.drop_nested(df, ingested_at="2024-01-01 00:00:00")
    assert d.columns == ["id", "ingested_datetime"]

# ---------------------------------------------------------------- landing


def test_invoice_landing_strict(spark):
    good = ('{"invoice_id":"%s","order_id":"o","customer_id":"c","seller_id":"s","product_category":"p",'
            '"item_price":1.5,"freight_value":1.0,"total_amount":2.5,"payment_type":"x","payment_installments":1,'
            '"order_status":"d","customer_city":"a","customer_state":"b","seller_city":"c","seller_state":"d",'
            '"timestamp":"t","source_system":"pos","processing_time_ms":3}')
    msgs = spark.createDataFrame([(good % "I1", 1), (good % "I1", 2), (good % "I2", 3),
                                  ((good % "I3").replace("1.5", '"abc"'), 4),
                                  ((good % "I4").replace(',"timestamp":"t"', ""), 5)], "value string, seq int")
    existing = spark.createDataFrame([("I2",)], "invoice_id string")
    out = invoice_landing(msgs, existing, order=["seq"]).collect()
    assert [(r.invoice_id, r.seq) for r in out] == [("I1", 1)]
    assert "source_system" not in out[0].asDict()
    # Wrong JSON types land nothing: a number as id, an object as city, a fraction or a boolean as count, text as
    # price, null, no object at all. A whole price is a number.
    wrong = [('"invoice_id":"I9"', '"invoice_id":9'), ('"customer_city":"a"', '"customer_city":{"n":"a"}'),
             ('"payment_installments":1', '"payment_installments":1.0'), ('"payment_installments":1', '"payment_installments":true'),
             ('"freight_value":1.0', '"freight_value":"1.0"'), ('"seller_id":"s"', '"seller_id":null'), ('"order_id":"o"', '"order_id":["o"]')]
    bad = [((good % "I9").replace(*w), i) for i, w in enumerate(wrong)] + [("[]", 90), ("no json", 91), (None, 92), ('"I9"', 93)]
    assert all(m != good % "I9" for m, _ in bad)
    whole = [((good % "I8").replace("1.5", "2"), 99)]
    out = invoice_landing(spark.createDataFrame(bad + whole, "value string, seq int"), None, order=["seq"]).collect()
    assert [(r.invoice_id, r.item_price) for r in out] == [("I8", 2.0)]


def test_insert_if_absent(spark):
    tgt = spark.createDataFrame([("a",)], "k string")
    b = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], "k string, o int")
    assert [tuple(r) for r in insert_if_absent(tgt, b, ["k"], ["o"]).collect()] == [("b", 1)]

# ---------------------------------------------------------------- retrieval (R)


def _brute_force_topk(queries, vectors, k=4):
    """All distances, sorted."""
    rows = []
    for qid, qv in zip(queries["query_id"], queries["query_vec"]):
        qa = np.asarray(qv, dtype=np.float64)
        ds = [(float(((np.asarray(v, dtype=np.float64) - qa) ** 2).sum()), vid)
              for vid, v in zip(vectors["vec_id"], vectors["embedding"])]
        ds = sorted(d for d in ds if d[0] < R.MAX_DISTANCE)[:k]
        rows += [(qid, r + 1, vid, d) for r, (d, vid) in enumerate(ds)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "distance"])


def test_topk_ties_k_gt_n_filter_and_zero_vector(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [-1.0, 0.0], 1), (4, [0.0, 0.0], 1)],
                                 "vec_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(10, [0.0, 0.0], 0), (11, [1.0, 1.0], 5)], "query_id long, query_vec array<double>, f int")
    res = R.topk_similar(q, vecs, k=10).orderBy("query_id", "rank").collect()
    q10 = [(r.vec_id, r.distance) for r in res if r.query_id == 10]
    assert q10 == [(4, 0.0), (1, 1.0), (2, 1.0), (3, 1.0)]        # k > n, ties by id
    filt = R.topk_similar(q, vecs, k=2, query_filter="f", vector_filter="label").collect()
    assert {r.query_id for r in filt} == {10}                      # no match for label 5
    bf = _brute_force_topk(q.toPandas(), vecs.toPandas(), k=10)
    assert [tuple(x) for x in bf[bf.query_id == 10][["vec_id", "distance"]].itertuples(index=False)] == \
        [(4, 0.0), (1, 1.0), (2, 1.0), (3, 1.0)]


def test_topk_matches_brute_force_on_fixture(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = R.label_centroids(v)
    got = R.topk_similar(q, v, k=4).orderBy("query_id", "rank").toPandas()
    bf = _brute_force_topk(q.toPandas(), v.toPandas(), k=4)
    assert list(got.vec_id) == list(bf.sort_values(["query_id", "rank"]).vec_id)
    assert np.allclose(got.distance, bf.sort_values(["query_id", "rank"]).distance, atol=1e-6)


@pytest.mark.parametrize("text", ["a" * 1000, "a" * 1001, "word " * 700, "\n" * 50, "", "x\n\ny " * 400])
def test_chunk_invariants(text):
    chunks = split_text(text)
    assert all(len(c) <= 1000 for c in chunks)
    if not text.strip():
        assert chunks == []
    assert _spelled(text) == "".join(text.split())
    spans = chunk_spans(text)
    assert all(0 <= a[1] - b[0] <= 200 or a[1] < b[0] for a, b in zip(spans, spans[1:]))


def _spelled(text):
    """The characters of the chunks other than blanks, overlaps once."""
    out, done = "", 0
    for a, b in chunk_spans(text):
        out += "".join(text[max(a, done):b].split())
        done = max(done, b)
    return out


def test_context_says_when_nothing_is_found(spark):
    ranked = spark.createDataFrame([(1, 1, 0.5, "s", "c")], "query_id int, rank int, similarity double, source string, content string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r.context for r in R.context_format(ranked, queries=asked).collect()}
    assert got == {1: "[Document 1 - s (relevance: 0.50)]\nc\n", 2: "No relevant documents found."}


def test_exchanges_over_gaps_in_turns(spark):
    t = spark.createDataFrame([(1, 1, "user", "a"), (1, 3, "assistant", "b"), (1, 1023, "user", "c"), (1, 5000, "assistant", "d")],
                              "conv_id int, turn int, role string, text string")
    got = R.recent_exchanges(t).collect()
    assert [(r.exchanges_kept, r.context) for r in got] == [(2, "User: a\nAssistant: b\nUser: c\nAssistant: d")]


def test_topk_with_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 5)
    v = spark.createDataFrame([(i, [float(i % 4), float(i // 4)]) for i in range(16)], "vec_id int, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = R.topk_similar(q, v, k=3).orderBy("query_id", "rank").toPandas()
    want = _brute_force_topk(q.toPandas(), v.toPandas(), k=3)
    assert got[["query_id", "vec_id"]].values.tolist() == want[["query_id", "vec_id"]].values.tolist()


def test_lake_keeps_offsets_of_all_partitions(spark):
    env = envelopes_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).limit(4)
    env = env.withColumn("offset", F.lit(7).cast("long")).withColumn("partition", (F.monotonically_increasing_id() % 2).cast("int")).withColumn("topic", F.lit("t"))
    rows = sinks.lake_dedupe(sinks.lake_records(env, "unused")).collect()
    assert sorted((r.source_topic, r.partition) for r in rows) == [("t", 0), ("t", 1)]


def test_schema_from_mapping_with_unknown_types():
    st, pk = schema_from_metadata({"columns": {"id": {"type": "uuid", "primary_key": True}, "n": {"type": "strange"},
                                               "o": {"type": "object", "fields": {"x": "int"}}}})
    assert pk == ["id"] and [f.name for f in st.fields][:3] == ["id", "n", "o_x"]
    assert st["n"].dataType == T.StringType()


def test_chunk_documents_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ch = R.chunk_documents(docs)
    big = docs.orderBy(F.desc("n_chars")).first()
    parts = [r.chunk_text for r in ch.filter(F.col("doc_id") == big.doc_id).orderBy("chunk_no").collect()]
    assert all(len(p) <= 1000 for p in parts)
    assert _spelled(big.text) == "".join(big.text.split())
    assert ch.select("doc_id").distinct().count() == docs.filter(F.length(F.trim("text")) > 0).count()


def test_route_and_exchanges(spark):
    t = spark.createDataFrame([(1, 0, "user", "Show the docs and count rows"), (1, 1, "assistant", "ok"),
                               (1, 2, "user", "what is a manual"), (1, 3, "system", "x"),
                               (1, 4, "user", "hello"), (1, 5, "assistant", "hi")],
                              "conv_id long, turn long, role string, text string")
    routes = [r.route for r in R.route_query(t.filter("role = 'user'")).orderBy("turn").collect()]
    assert routes == ["hybrid", "document", "model"]
    ex = R.recent_exchanges(t, keep=10, show=1).first()
    assert ex.exchanges_kept == 2 and ex.context == "User: hello\nAssistant: hi"


def test_backlog_branch_order(spark):
    df = spark.createDataFrame([(97.0,), (85.0,), (10.0,)], "p double")
    assert [r[0] for r in df.select(backlog_level(F.col("p"))).collect()] == ["critical", "warning", "ok"]
    assert [r[0] for r in df.select(backlog_level(F.col("p"), True)).collect()] == ["warning", "warning", "ok"]


def test_chunked_append_reports_failures(spark, tmp_dir):
    df = spark.range(2500).repartition(1)
    calls = []

    def writer(pdf: pd.DataFrame, chunk_id: str):
        if pdf["id"].min() >= 1000 and pdf["id"].min() < 2000:
            raise RuntimeError("boom")

    st = files.chunked_append(df, writer, 1000).collect()
    assert sorted((r.rows, r.status) for r in st) == [(500, "ok"), (1000, "failed"), (1000, "ok")]
    del calls


def test_lake_write_empty_writes_nothing(spark, tmp_dir):
    path, n = files.lake_write(spark.range(0), tmp_dir, "t", "r1")
    assert path is None and n == 0
    path, n = files.lake_write(spark.range(3), tmp_dir, "t", "r2")
    assert n == 3 and spark.read.parquet(path).count() == 3


def test_merge_into_partitions_rewrites_only_touched(spark, tmp_dir):
    import glob
    import os
    t = spark.createDataFrame([(1, "a", "m1"), (2, "b", "m1"), (3, "c", "m2")], "k int, v string, p string")
    path = f"{tmp_dir}/t"
    I.merge_into_partitions(t, path, ["k"], ["p"], f"{tmp_dir}/s0")
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/p=m2/*.parquet")}
    src = spark.createDataFrame([(2, "B", "m1"), (4, "d", "m1")], "k int, v string, p string")
    I.merge_into_partitions(src, path, ["k"], ["p"], f"{tmp_dir}/s1")
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "p").collect())
    assert got == [(1, "a", "m1"), (2, "B", "m1"), (3, "c", "m2"), (4, "d", "m1")]
    assert {f: os.path.getmtime(f) for f in glob.glob(f"{path}/p=m2/*.parquet")} == before


def test_append_chunks_publishes_by_manifest(spark, tmp_dir):
    df = spark.range(2500).withColumn("v", F.col("id") * 2).repartition(3)
    bad = {"no multiple of 1500": (F.col("id") % 1500 == 0) & (F.col("id") > 0)}
    for _ in range(2):   # a second run replaces the first
        st = files.append_chunks(df, f"{tmp_dir}/t", "a1", ["id"], bad, 1000).collect()
    assert sorted((r.chunk, r.rows, r.status, r.error) for r in st) == [
        (0, 1000, "ok", None), (1, 1000, "failed", "no multiple of 1500"), (2, 500, "ok", None)]
    files.append_chunks(df.filter("id < 3"), f"{tmp_dir}/t", "a2", ["id"], bad, 1000)
    # An append without a manifest has not happened.
    df.filter("id < 9").withColumn("chunk", F.lit(0).cast("long")).write.parquet(f"{tmp_dir}/t/rows/append_id=a3")
    got = files.appended(spark, f"{tmp_dir}/t")
    assert sorted(r.id for r in got.filter("append_id = 'a1'").collect()) == [*range(1000), *range(2000, 2500)]
    assert got.count() == 1503
    lost = files.appended(spark, f"{tmp_dir}/t", "rejected").collect()
    assert sorted(r.id for r in lost) == list(range(1000, 2000)) and {r.error for r in lost} == {"no multiple of 1500"}


def test_dim_date_defaults_and_weekday(spark):
    from agora.operators.dimensions import dim_date
    d = dim_date(spark)
    assert d.count() == 1826
    last = d.orderBy(F.desc("date_day")).first()
    assert str(last.date_day) == "2020-12-30"
    sun = d.filter(F.col("date_day") == F.lit("2016-01-03").cast("date")).first()
    assert sun.day_of_week == 0 and sun.is_weekend and str(sun.week_start) == "2015-12-28"


def test_require_nonzero(spark):
    df = spark.range(2)
    A.require_nonzero(A.rowcount_nonzero({"a": df}))
    with pytest.raises(RuntimeError, match="b"):
        A.require_nonzero(A.rowcount_nonzero({"a": df, "b": df.limit(0)}))


def test_declared_tests_find_what_is_wrong(spark):
    """All kinds on one table; a key's values are counted once for uniqueness and relationship."""
    from agora.plans.declared_tests import declared
    T_ = H.Test
    t = spark.createDataFrame([("a", 1, "x"), ("a", -2, "q"), ("b", None, None), (None, 3, "x")], "k string, n int, v string")
    p = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    tests = [T_("unique", "k"), T_("relationships", "k", parent="p", parent_key="k"), T_("not_null", "n"),
             T_("accepted_range", "n", min_value=0), T_("accepted_values", "v", values=["x", "y"])]
    got = {r.test_name: r.failures for r in H.dq_model("m", t, tests, {"p": p}).collect()}
    assert got == {"unique_k": 1, "relationships_k": 1, "not_null_n": 1, "accepted_range_n": 1, "accepted_values_v": 1}
    empty = H.dq_model("m", t.limit(0), tests, {"p": p}).collect()
    assert [r.status for r in empty] == ["pass"] * 5
    assert sum(map(len, declared().values())) + 2 == 104


def test_upsert_few_moves_only_rows_that_meet(spark):
    """Same table as the full upsert, nulls and value columns included; and by the plain way where many rows meet."""
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k int, v string, w int")
    s = spark.createDataFrame([(2, "B", 9), (3, "c", 9), (None, "m", 9)], "k int, v string, w int")
    rows = lambda df: sorted(map(str, df.collect()))
    for cols in (None, ["w"]):
        whole = rows(I.upsert_by_key(t, s, ["k"], cols))
        assert rows(I.upsert_few(t, s, ["k"], cols)) == whole == rows(I.upsert_few(t, s, ["k"], cols, max_rows=0))


def test_joins_known_keeps_rows_where_they_are(spark):
    """A key table too large to broadcast: missing, repeated and null keys as in the plain join, without its shuffle."""
    from agora.plans.strategy import joins_known
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), ("b", 5)], "k string, v int")
    known = spark.createDataFrame([(c,) for c in "bbac"] + [("z",)], "k string").filter("k <> 'c'")
    got = joins_known(rows, [known], ["k"], rows, max_rows=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(known, "k").collect())) == [("a", 1)] + [("b", 2)] * 2 + [("b", 5)] * 2
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_chunks_leave_a_task_in_bounded_pieces(spark, monkeypatch):
    """No Arrow batch of documents or chunks grows with the number of rows."""
    docs = spark.createDataFrame([(i, "word " * 400) for i in range(300)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(R, "BATCH_BYTES", 100_000)
    ch = R.chunk_documents(docs)
    sizes = ch.select("chunk_text", "chunk_chars").mapInPandas(
        lambda it: (p[["chunk_chars"]].sum().to_frame("s") for p in it), "s long").collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "100000"
    assert len(sizes) > 1 and sum(r.s for r in sizes) == ch.agg({"chunk_chars": "sum"}).first()[0]
