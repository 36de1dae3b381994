"""Change-data-capture envelopes: source, flattening, JSON hop, event time.

S1 cdc_source, S2 cdc_flatten, S3 cdc_to_json, S4 json_parse, S5 event_day,
S6 watermark, S13 snapshot_then_stream, S14 struct_flatten, S15 drop_nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", T.StringType()),        # decimals arrive as text
    T.StructField("currency", T.StringType()),
    T.StructField("timestamp", T.LongType()),       # epoch microseconds
])
SOURCE_SCHEMA = T.StructType([
    T.StructField("db", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
])
ENVELOPE_SCHEMA = T.StructType([
    T.StructField("before", ROW_SCHEMA),
    T.StructField("after", ROW_SCHEMA),
    T.StructField("source", SOURCE_SCHEMA),
    T.StructField("op", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
])
SIMPLE_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("timestamp_micros", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("op", T.StringType()),
])
DAY_MS = 86_400_000


def cdc_source(spark: SparkSession, path_or_topic: str, fmt: str = "json", bootstrap: str | None = None,
               starting_offsets: str = "earliest", max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming envelope source.

    ``fmt='kafka'`` reads a topic from the earliest offset (needs the Kafka
    connector on the classpath) and decodes JSON values; ``fmt='json'`` reads
    JSON-lines files of any folder below with the fixed envelope schema.
    """
    if fmt == "kafka":
        raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
               .option("subscribe", path_or_topic).option("startingOffsets", starting_offsets).load())
        env = F.from_json(F.col("value").cast("string"), ENVELOPE_SCHEMA)
        return raw.select(env.alias("e"), "offset", "partition", "topic").select("e.*", "offset", "partition",
                                                                               "topic")
    schema = T.StructType(ENVELOPE_SCHEMA.fields + [T.StructField("offset", T.LongType())])
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path_or_topic)


def _present(c: Column) -> Column:
    """Truthiness of a text field: not NULL, not ''. The text '0' is there."""
    return c.isNotNull() & (c != "")


def _nonzero(c: Column) -> Column:
    """Truthiness of a number: not NULL, not 0."""
    return c.isNotNull() & (c != 0)


def cdc_flatten(env: DataFrame, strict_truthiness: bool = True,
                kept: Sequence[str] = ("topic", "partition", "offset")) -> DataFrame:
    """Keep creates/updates/snapshot reads with an ``after`` image and the
    required fields; project ``after.*`` plus ``op`` and the envelope's ``kept``
    columns. Deletes are ignored."""
    keep = (F.col("op").isin("c", "u", "r") & F.col("after").isNotNull()
            & F.col("after.user_id").isNotNull() & F.col("after.amount").isNotNull())
    if strict_truthiness:
        keep = (keep & _present(F.col("after.user_id")) & _present(F.col("after.amount"))
                & _nonzero(F.col("after.timestamp")))
    return env.filter(keep).select("after.*", "op", *[c for c in kept if c in env.columns])


def cdc_rejects(env: DataFrame) -> DataFrame:
    """S3 side output: envelopes that ``cdc_flatten`` drops, with the reason
    (``op`` not c/u/r, no ``after`` image, or a required field missing/empty)."""
    reason = (F.when(~F.col("op").isin("c", "u", "r") | F.col("op").isNull(), "operation")
              .when(F.col("after").isNull(), "no_after")
              .when(~(_present(F.col("after.user_id")) & _present(F.col("after.amount"))
                      & _nonzero(F.col("after.timestamp"))), "missing_field"))
    extra = [c for c in ("topic", "partition", "offset") if c in env.columns]
    return env.select(reason.alias("reject_reason"), "op", "ts_ms", *extra).filter(F.col("reject_reason").isNotNull())


def cdc_to_json(flat: DataFrame, key: str = "user_id") -> DataFrame:
    """S3: simplified JSON record {user_id, amount, timestamp_micros, currency, op}
    with its message key (as a Kafka sink expects: ``key``, ``value``)."""
    value = F.to_json(F.struct(
        "user_id", "amount", F.col("timestamp").alias("timestamp_micros"), "currency", "op"))
    extra = [c for c in ("topic", "partition", "offset") if c in flat.columns]
    return flat.select(F.col(key).cast("string").alias("key"), value.alias("value"), *extra)


def json_parse(messages: DataFrame, col: str = "value") -> DataFrame:
    """Parse simplified JSON; malformed or incomplete records are dropped.
    Event time in ms is floor(micros / 1000)."""
    p = messages.select(F.from_json(F.col(col), SIMPLE_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"),
                        *[c for c in messages.columns if c != col and c != "key"])
    j = F.col
    ok = (_present(j("j.user_id")) & _present(j("j.amount")) & _nonzero(j("j.timestamp_micros")))
    return p.filter(ok).select(
        j("j.user_id").alias("user_id"), j("j.amount").alias("amount"),
        F.floor(j("j.timestamp_micros") / 1000).alias("event_time_ms"),
        *[c for c in p.columns if c != "j"])


def event_day(ms_col: str = "event_time_ms") -> Column:
    """UTC day number since epoch."""
    return F.floor(F.col(ms_col) / DAY_MS).cast("int")


def with_event_time(df: DataFrame, ms_col: str = "event_time_ms", delay: str = "5 seconds") -> DataFrame:
    """Event-time column plus a bounded-out-of-orderness watermark.

    The watermark only bounds state retention; nothing is dropped as late.
    """
    return (df.withColumn("event_time", F.timestamp_millis(F.col(ms_col)).cast("timestamp_ltz"))
            .withWatermark("event_time", delay))


def snapshot_then_stream(snapshot: DataFrame, changes: DataFrame, mode: str = "initial") -> DataFrame:
    """Bootstrap with a snapshot tagged ``op='r'`` and then the changes.

    ``initial``/``always`` include the snapshot; ``never``/``schema_only`` only
    the change stream (``schema_only`` keeps the snapshot's columns).
    """
    if mode in ("never", "schema_only"):
        return changes
    snap = snapshot.select(F.lit(None).cast(ROW_SCHEMA).alias("before"), F.struct(*[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in ROW_SCHEMA.fields]).alias("after"),
        F.lit(None).cast(SOURCE_SCHEMA).alias("source"), F.lit("r").alias("op"),
        F.lit(None).cast("long").alias("ts_ms"), F.lit(None).cast("long").alias("offset"))
    return snap.unionByName(changes.select(snap.columns))


def struct_flatten(df: DataFrame, flatten: Sequence[str] = (), as_json: Sequence[str] = ()) -> DataFrame:
    """Nested structs in ``flatten`` become ``<struct>_<field>`` columns,
    structs in ``as_json`` become JSON text (missing -> NULL)."""
    out: list[Column] = []
    for f in df.schema.fields:
        if f.name in flatten and isinstance(f.dataType, T.StructType):
            out += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        elif f.name in as_json:
            out.append(F.when(F.col(f.name).isNotNull(), F.to_json(F.col(f.name))).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def drop_nested(df: DataFrame, ingested_at=None) -> DataFrame:
    """Keep only scalar columns, plus ``ingested_datetime``."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    keep = [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]
    out = df.select(*keep)
    if "ingested_datetime" not in keep:
        ts = F.current_timestamp() if ingested_at is None else F.lit(ingested_at).cast("timestamp_ntz")
        out = out.withColumn("ingested_datetime", ts)
    return out
