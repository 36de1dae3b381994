"""Operator 1: contiguous shards of near-equal bytes by global prefix sums.

Native: DataFrame functions only. Rows are ordered by a hash of the text, then by
``doc_id``, so copies of a text stand together. Prefix sums of sizes come from
totals: per hash range, per (text, slice of copies), then a running sum inside a
slice. No window sees more than one hash range's totals or one slice of copies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch

#: Copies of one text are dealt to so many slices, so that a hot text has no single task.
COPY_SLICES = 32
#: Rows that one hash range holds on average.
RANGE_ROWS = 20_000
#: A group of copies of at most this share of a shard is kept in one shard.
WHOLE_GROUP = 0.05


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Deal documents to ``shards`` contiguous shards of near-equal bytes.

    Size is the UTF-8 length of the text plus 1 (null text: 1, and checksum 0, as the
    empty text). Shard ``s`` holds the documents whose midpoint of the global prefix
    sum lies in the s-th equal part of all bytes, so shard sizes differ from equal by
    less than one document; copies of one text that together are at most
    ``WHOLE_GROUP`` of a shard share the midpoint of the group and so their shard.
    Larger groups are cut like other rows. Returns doc_id, size, text_crc32, law,
    shard, slot (0.. inside each shard), grown_shard (null under this law).

    Null ``doc_id`` sorts first; repeated rows are rows of their own (their mutual
    order is arbitrary but their sizes are equal); an empty table gives no rows;
    other columns are ignored.
    """
    sized = scratch(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
        F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SLICES)).alias("part")), "sized")
    rows = sized.count()
    bits = max(6, math.ceil(math.log2(max(1, rows / RANGE_ROWS))))
    sized = sized.withColumn("r", F.shiftright("h", 64 - bits))
    totals = sized.groupBy("r", "h", "part").agg(F.sum("size").alias("t"), F.count("*").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    # One row per hash range: 2**bits of them, a window over range totals alone.
    all_ranges = Window.orderBy("r")
    ranges = (totals.groupBy("r").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
              .select("r", over("t", all_ranges).alias("rt"), over("n", all_ranges).alias("rn")))
    inside = Window.partitionBy("r").orderBy("h", "part")
    group = Window.partitionBy("r", "h")
    starts = (totals.join(ranges, "r")
              .withColumn("t0", F.col("rt") + over("t", inside)).withColumn("n0", F.col("rn") + over("n", inside))
              .select("r", "h", "part", "t0", "n0", F.min("t0").over(group).alias("g0"),
                      F.sum("t").over(group).alias("gt")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    slice_ = Window.partitionBy("r", "h", "part").orderBy(F.col("doc_id").asc_nulls_first())
    placed = (sized.join(starts, ["r", "h", "part"])
              .withColumn("p", F.col("t0") + over("size", slice_))
              .withColumn("at", F.col("n0") + F.row_number().over(slice_) - 1))
    whole = F.col("gt") * shards <= F.lit(WHOLE_GROUP) * total
    twice_middle = F.when(whole, 2 * F.col("g0") + F.col("gt")).otherwise(2 * F.col("p") + F.col("size"))
    placed = scratch(placed.select("doc_id", "size", "text_crc32", "at", F.least(
        F.lit(shards - 1), F.floor(twice_middle.cast("decimal(38,0)") * shards / (2 * max(total, 1)))
    ).cast("int").alias("shard")), "placed")
    # One row per shard.
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
