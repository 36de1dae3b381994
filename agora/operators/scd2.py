"""Type-2 history with the check strategy.

One full outer join on the key between the open versions and the new source
decides, per key, whether to keep, close, open, or close-and-open. A stored history
keeps its open and its closed versions apart (``snapshot_run``): a run reads and
replaces the open ones and adds the versions that it closes; it neither reads nor
writes what was closed before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import surrogate_key
from ..plans.strategy import written_table
from ..streaming.sinks import table_at

META = ["dbt_scd_id", "dbt_updated_at", "dbt_valid_from", "dbt_valid_to"]

# Fixed check columns of the three snapshots.
CUSTOMER_CHECK = ["customer_city", "customer_state", "geo_city", "geo_state"]
PRODUCT_CHECK = ["product_category_name", "product_name_length", "product_description_length",
                 "product_photos_qty", "product_volume_cm3", "product_weight_kg", "photo_category"]
SELLER_CHECK = ["seller_city", "seller_state", "geo_city", "geo_state"]


def _versioned(src: DataFrame, key: str, run_ts) -> DataFrame:
    ts = F.lit(run_ts).cast("timestamp_ntz")
    return src.select("*", surrogate_key(key, ts).alias("dbt_scd_id"), ts.alias("dbt_updated_at"),
                      ts.alias("dbt_valid_from"), F.lit(None).cast("timestamp_ntz").alias("dbt_valid_to"))


def scd2_check(history: DataFrame | None, source: DataFrame, key: str, check_cols: Sequence[str], run_ts,
               close_missing: bool = True) -> DataFrame:
    """Apply one snapshot run at ``run_ts``.

    - new key -> open a version; changed check columns (NULL-safe) -> close the
      open version at ``run_ts`` and open a new one; unchanged -> keep;
    - key missing from the source -> close it (``close_missing``, i.e. hard
      deletes invalidated); a key that comes back gets a new version.
    Re-running the same source at a later time changes nothing.
    """
    if history is None:
        return _versioned(source, key, run_ts)
    closed = history.filter(F.col("dbt_valid_to").isNotNull())
    out = changed_versions(history.filter(F.col("dbt_valid_to").isNull()), source, key, check_cols, run_ts, close_missing)
    return closed.select(out.columns).unionByName(out)


def changed_versions(open_: DataFrame, source: DataFrame, key: str, check_cols: Sequence[str], run_ts,
                     close_missing: bool = True) -> DataFrame:
    """The open versions after a run, and those that it closes (``dbt_valid_to`` = ``run_ts``)."""
    ts = F.lit(run_ts).cast("timestamp_ntz")
    cols = source.columns
    o = open_.select(F.col(key).alias("_k"), F.struct(*cols, *META).alias("o"))
    s = source.select(F.col(key).alias("_k"), F.struct(*cols).alias("s"))
    j = o.join(s, "_k", "full_outer")
    has_o, has_s = F.col("o").isNotNull(), F.col("s").isNotNull()
    same = F.lit(True)
    for c in check_cols:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    keep_o = has_o & ((has_s & same) | (~has_s & F.lit(not close_missing)))
    close_o = has_o & ((has_s & ~same) | (~has_s & F.lit(close_missing)))
    open_s = has_s & (~has_o | ~same)
    old_kept = F.struct(*[F.col(f"o.{c}").alias(c) for c in cols + META])
    old_closed = F.struct(*[F.col(f"o.{c}").alias(c) for c in cols + META[:3]], ts.alias("dbt_valid_to"))
    new = F.struct(*[F.col(f"s.{c}").alias(c) for c in cols], surrogate_key(F.col("_k"), ts).alias("dbt_scd_id"),
                   ts.alias("dbt_updated_at"), ts.alias("dbt_valid_from"),
                   F.lit(None).cast("timestamp_ntz").alias("dbt_valid_to"))
    rows = F.filter(F.array(F.when(keep_o, old_kept), F.when(close_o, old_closed), F.when(open_s, new)),
                    lambda x: x.isNotNull())
    return j.select(F.explode(rows).alias("r")).select("r.*")


def snapshot_run(path: str, source: DataFrame, key: str, check_cols: Sequence[str], run_ts, close_missing: bool = True) -> None:
    """G4 on a stored history: apply one run to the table at ``path``.

    ``open`` holds the open versions, ``closed/closed_on=...`` those that each run closed.
    The run's rows are written aside first; the run's own ``closed_on`` folder and
    ``open`` are then replaced by them, so a run that failed half-way can be run again.
    """
    spark = source.sparkSession
    open_ = table_at(spark, f"{path}/open")
    found = _versioned(source, key, run_ts) if open_ is None else changed_versions(open_, source, key, check_cols, run_ts, close_missing)
    found = written_table(found, "scd2_run")
    day = F.date_format("dbt_valid_to", "yyyy-MM-dd'T'HHmmss")
    ended = found.filter(F.col("dbt_valid_to").isNotNull()).withColumn("closed_on", day)
    ended.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("closed_on").parquet(f"{path}/closed")
    found.filter(F.col("dbt_valid_to").isNull()).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/open")


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the table at ``path``."""
    open_, closed = spark.read.parquet(f"{path}/open"), table_at(spark, f"{path}/closed")
    return open_ if closed is None else open_.unionByName(closed.select(open_.columns))


def customer_source(int_customers: DataFrame) -> DataFrame:
    """G1: customers by customer_id, checking city/state and geo city/state."""
    src = int_customers.select(surrogate_key("customer_id").alias("customer_key"), "customer_id",
                               "customer_unique_id", "customer_zip_code_prefix", "customer_city",
                               "customer_state", "geo_city", "geo_state")
    return src


def snap_dim_customer(path: str, int_customers: DataFrame, run_ts) -> None:
    snapshot_run(path, customer_source(int_customers), "customer_id", CUSTOMER_CHECK, run_ts)


def product_source(int_products: DataFrame) -> DataFrame:
    """Products by product_id over seven check columns."""
    src = int_products.select(surrogate_key("product_id").alias("product_key"), "product_id",
                              "product_category_name", "product_name_length", "product_description_length",
                              "product_photos_qty", "product_volume_cm3", "product_weight_kg", "photo_category")
    return src


def snap_dim_product(path: str, int_products: DataFrame, run_ts) -> None:
    snapshot_run(path, product_source(int_products), "product_id", PRODUCT_CHECK, run_ts)


def seller_source(int_sellers: DataFrame) -> DataFrame:
    """Sellers by seller_id, checking city/state and geo city/state."""
    src = int_sellers.select(surrogate_key("seller_id").alias("seller_key"), "seller_id",
                             "seller_zip_code_prefix", "seller_city", "seller_state", "geo_city", "geo_state")
    return src


def snap_dim_seller(path: str, int_sellers: DataFrame, run_ts) -> None:
    snapshot_run(path, seller_source(int_sellers), "seller_id", SELLER_CHECK, run_ts)
