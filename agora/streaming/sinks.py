"""Sinks: partitioned CDC lake (S10), landing tables (S11, S12), and
checkpointed, idempotent micro-batch runs (S16)."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpoint_dir

LAKE_PARTITIONS = ["source_topic", "year", "month", "day"]


def lake_records(env: DataFrame, topic: str, processed_ms: str = "ts_ms", partition: int = 0) -> DataFrame:
    """S10 enrichment: {source_topic, partition, offset, timestamp, payload}
    plus the object-path parts (year/month/day of the processing time) and the
    object id: transaction_id, else user_id, else detail_id, else offset.

    A source that delivers ``topic`` and ``partition`` columns decides them;
    the arguments stand in where it does not."""
    ts = F.timestamp_millis(F.col(processed_ms)).cast("timestamp_ntz")
    after_fields = {f.name for f in env.schema["after"].dataType.fields}
    ids = [F.col(f"after.{c}") for c in ("transaction_id", "user_id", "detail_id") if c in after_fields]
    uid = F.coalesce(*[F.when(c != "", c) for c in ids], F.col("offset").cast("string"))
    placed = ("topic", "partition", "offset")
    payload = F.to_json(F.struct(*[c for c in env.columns if c not in placed]))
    from_topic = F.col("topic") if "topic" in env.columns else F.lit(topic)
    from_partition = F.col("partition") if "partition" in env.columns else F.lit(partition)
    return env.select(
        from_topic.alias("source_topic"), from_partition.alias("partition"), "offset",
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        payload.alias("payload"),
        F.year(ts).alias("year"), F.lpad(F.month(ts).cast("string"), 2, "0").alias("month"),
        F.lpad(F.dayofmonth(ts).cast("string"), 2, "0").alias("day"),
        uid.alias("object_id"), F.coalesce(F.col("op"), F.lit("c")).alias("op"),
        F.col("after").isNull().alias("_no_after"))


def lake_dedupe(records: DataFrame, as_written: bool = False) -> DataFrame:
    """Default: one record per (topic, partition, offset), nothing else lost.

    ``as_written``: records without an ``after`` image are skipped and only the
    first record (lowest offset) per (topic, day, object id, op) is kept, as an
    object store keyed by that path would keep it.
    """
    if not as_written:
        return records.dropDuplicates(["source_topic", "partition", "offset"]).drop("_no_after")
    r = records.filter(~F.col("_no_after"))
    w = Window.partitionBy(*LAKE_PARTITIONS, "object_id", "op").orderBy("partition", "offset")
    return r.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_no_after")


def table_at(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame | None:
    """The Parquet files at ``paths`` (folders of the table ``base``); None where nothing is written yet."""
    reader = spark.read.option("basePath", base) if base else spark.read
    try:
        return reader.parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_partitions(spark: SparkSession, path: str, partitions: list[dict]) -> DataFrame | None:
    """The existing folders among ``partitions`` (dicts of partition column -> value) of a
    ``partitionBy`` Parquet table; the table is not listed as a whole."""
    folders = [path.rstrip("/") + "".join(f"/{k}={v}" for k, v in p.items()) for p in partitions]
    found = [f for f in folders if table_at(spark, f) is not None]
    return table_at(spark, *found, base=path) if found else None


def touched_partitions(batch: DataFrame, columns: Sequence[str]) -> list[dict]:
    """Partition values of a micro-batch or slice: a handful of days, or at most the number of buckets."""
    return [r.asDict() for r in batch.select(*columns).distinct().collect()]


def write_lake_batch(batch: DataFrame, path: str, as_written: bool = False) -> None:
    """foreachBatch body: dedupe, skip keys already in the touched day
    partitions (existence check = anti join on the partition-pruned read),
    append partitioned by topic/year/month/day. The micro-batch is computed once; its
    rows are rebalanced by day, so that a hot day is several files and a small one a single."""
    new = lake_dedupe(batch, as_written).persist()
    key = (["source_topic", "year", "month", "day", "object_id", "op"] if as_written
           else ["source_topic", "partition", "offset"])
    try:
        old = read_partitions(batch.sparkSession, path, touched_partitions(new, LAKE_PARTITIONS))
        add = new if old is None else new.join(old.select(*key), key, "left_anti").select(new.columns)
        add.hint("rebalance", *LAKE_PARTITIONS).write.mode("append").partitionBy(*LAKE_PARTITIONS).parquet(path)
    finally:
        new.unpersist()


def insert_if_absent(target: DataFrame | None, batch: DataFrame, key: Sequence[str],
                     order: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is new (ON CONFLICT DO NOTHING); inside
    the batch the first row per key (by ``order``) wins."""
    key = list(key)
    if order:
        w = Window.partitionBy(*key).orderBy(*order)
        batch = batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    else:
        batch = batch.dropDuplicates(key)
    if target is None:
        return batch
    return batch.join(target.select(*key), key, "left_anti")


# Fixed invoice contract: 18 typed fields, 16 stored.
INVOICE_SCHEMA = T.StructType([
    T.StructField("invoice_id", T.StringType()), T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()), T.StructField("seller_id", T.StringType()),
    T.StructField("product_category", T.StringType()), T.StructField("item_price", T.DoubleType()),
    T.StructField("freight_value", T.DoubleType()), T.StructField("total_amount", T.DoubleType()),
    T.StructField("payment_type", T.StringType()), T.StructField("payment_installments", T.LongType()),
    T.StructField("order_status", T.StringType()), T.StructField("customer_city", T.StringType()),
    T.StructField("customer_state", T.StringType()), T.StructField("seller_city", T.StringType()),
    T.StructField("seller_state", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("source_system", T.StringType()), T.StructField("processing_time_ms", T.LongType()),
])
INVOICE_STORED = [f.name for f in INVOICE_SCHEMA.fields][:16]


#: JSON types that a strictly typed field takes: a whole number is a number too, text and booleans are not.
JSON_TYPES = {"string": lambda of: of == "STRING", "double": lambda of: of.isin("BIGINT", "DOUBLE") | of.startswith("DECIMAL"),
              "bigint": lambda of: of == "BIGINT"}


def strict_fields(value: Column, schema: T.StructType) -> tuple[Column, list[Column]]:
    """Whether ``value``, an object's fields as VARIANTs (``variant_fields``), has every field in its JSON type, and the fields.

    A message that is no JSON object, repeats a key, or holds an integer of more than 64
    bits in an integer field is not accepted.
    """
    ok, fields = F.lit(True), []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        of = F.schema_of_variant(value[f.name])
        ok = ok & F.coalesce(JSON_TYPES[kind](of), F.lit(False))
        fields.append(F.try_variant_get(value[f.name], "$", kind).alias(f.name))
    return ok, fields


def variant_fields(text: Column, schema: T.StructType) -> Column:
    """The fields of a JSON object as VARIANTs, each taken from the parsed text once."""
    return F.try_variant_get(F.try_parse_json(text), "$", f"struct<{','.join(f'{f.name}:variant' for f in schema.fields)}>")


def invoice_landing(messages: DataFrame, existing: DataFrame | None = None, col: str = "value",
                    order: Sequence[str] | None = None) -> DataFrame:
    """Parse JSON strictly against the 18-field contract (a field of the
    wrong JSON type or a missing field rejects the record: a numeric id is no text, an
    object no city), keep the 16 stored fields, insert only new invoice ids."""
    extra = [c for c in messages.columns if c != col]
    # A generator, which no filter passes: as a column, the message would be made and parsed again for every field that is checked.
    parsed = messages.select(F.explode(F.array(variant_fields(F.col(col), INVOICE_SCHEMA))).alias("_json"), *extra)
    ok, fields = strict_fields(F.col("_json"), INVOICE_SCHEMA)
    good = parsed.filter(ok).select(*fields[:len(INVOICE_STORED)], *extra)
    return insert_if_absent(existing, good, ["invoice_id"], order)


def checkpointed_run(stream: DataFrame, write_batch: Callable[[DataFrame, int], None], name: str,
                     trigger: dict | None = None, spark: SparkSession | None = None) -> StreamingQuery:
    """Start a micro-batch query whose progress and state live under the
    cluster's shared ``spark.checkpoint.dir``; ``write_batch(df, batch_id)``
    must be idempotent per batch id (see ``idempotent_parquet``)."""
    spark = spark or stream.sparkSession
    loc = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = stream.writeStream.queryName(name).option("checkpointLocation", loc).foreachBatch(write_batch)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def idempotent_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that overwrites ``path/batch_id=N``: replaying a batch
    after a failure rewrites the same folder instead of appending twice."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


#: Folders of a landing table: an id is looked for in its own bucket only.
BUCKETS = 64


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def land_invoices_into(path: str, order: Sequence[str] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for S11/S12: validate a micro-batch of invoice JSON
    and append only ids not yet in the landing table at ``path``
    (ON CONFLICT DO NOTHING; first row per id inside the batch wins). The table is
    partitioned by a hash of the id: only the batch's buckets and their id column are read."""
    def write(batch: DataFrame, batch_id: int) -> None:
        new = invoice_landing(batch, None, order=order).withColumn("bucket", bucket_of("invoice_id")).persist()
        try:
            old = read_partitions(batch.sparkSession, path, touched_partitions(new, ["bucket"]))
            add = new if old is None else new.join(old.select("bucket", "invoice_id"), ["bucket", "invoice_id"], "left_anti").select(new.columns)
            add.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)
        finally:
            new.unpersist()
    return write


RUN_LOG = "operation string, batch_id long, records long, duration_seconds double, status string"


def logged(write_batch: Callable[[DataFrame, int], None], path: str, operation: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that also writes its run row (L1-L3): rows, seconds and outcome of each
    micro-batch, under ``path``. A batch that is run again replaces its row, one that fails
    leaves a ``failed`` row and the error."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, began, n, status = batch.sparkSession, time.time(), 0, "failed"
        batch = batch.persist()
        try:
            n = batch.count()
            write_batch(batch, batch_id)
            status = "ok"
        finally:
            batch.unpersist()
            spark.createDataFrame([(operation, batch_id, n, time.time() - began, status)], RUN_LOG).write.mode("overwrite").parquet(
                f"{path.rstrip('/')}/{operation}/{batch_id}")
    return write


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The run rows that ``logged`` writers left under ``path``."""
    found = spark.read.option("recursiveFileLookup", "true").schema(RUN_LOG).parquet(path)
    return found.withColumn("operation", F.concat_ws("_batch_", "operation", F.col("batch_id").cast("string"))).drop("batch_id")
