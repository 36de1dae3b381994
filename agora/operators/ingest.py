"""Ingest jobs: orphan pruning, watermark windows and state, table planning,
stamps, masking, row-count and NULL normalisation (A3, A5-A7, A10, A12-A14, A16).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import mask_hash
from ..sources.contracts import Contract

# ---------------------------------------------------------------- A3 orphans


def orphan_split(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a parent (or a NULL key, as NOT IN keeps them) and the rest.

    One left join against the distinct parent keys (both sides shuffle on the
    key once) serves both outputs, so the child is scanned once."""
    p = parent.select(F.col(pk).alias("_pk")).filter(F.col("_pk").isNotNull()).distinct()
    j = child.join(p, F.col(fk) == F.col("_pk"), "left")
    keep = j.filter(F.col("_pk").isNotNull() | F.col(fk).isNull()).drop("_pk")
    rejected = j.filter(F.col("_pk").isNull() & F.col(fk).isNotNull()).drop("_pk")
    return keep, rejected


def orphan_prune(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A3: delete children without a parent, parents first, so the children of
    a pruned order go too (the fixed point of the original, order-dependent
    deletes): orders without customer; items without order, product or seller;
    payments and reviews without order."""
    t = dict(tables)
    t["orders"], _ = orphan_split(t["orders"], "customer_id", t["customers"], "customer_id")
    items = t["order_items"]
    for fk, parent in (("order_id", "orders"), ("product_id", "products"), ("seller_id", "sellers")):
        items, _ = orphan_split(items, fk, t[parent], fk)
    t["order_items"] = items
    t["order_payments"], _ = orphan_split(t["order_payments"], "order_id", t["orders"], "order_id")
    t["order_reviews"], _ = orphan_split(t["order_reviews"], "order_id", t["orders"], "order_id")
    return t

# ------------------------------------------------------------ A5 / A6 / A16


def watermark_slice(df: DataFrame, wm: str, load_from=None, load_at=None, as_written: bool = False) -> DataFrame:
    """A5: rows of one incremental run.

    First run (``load_from`` NULL): ``wm <= load_at``.  Later runs:
    ``load_from < wm <= load_at``; ``as_written`` drops the upper bound as the
    original did (so consecutive runs overlap).  NULL watermarks never load.
    The predicates are plain comparisons, so they reach the Parquet/JDBC scan.
    """
    c = F.col(wm)
    if load_from is None:
        cond = c <= F.lit(load_at).cast(T.TimestampNTZType()) if load_at is not None else c.isNotNull()
    else:
        cond = c > F.lit(load_from).cast(T.TimestampNTZType())
        if not as_written and load_at is not None:
            cond = cond & (c <= F.lit(load_at).cast(T.TimestampNTZType()))
    return df.filter(cond)


def max_watermark(df: DataFrame, wm: str) -> DataFrame:
    """One row with MAX(wm) (NULL when empty); Parquet min/max statistics
    answer it without reading pages when aggregate push-down is on."""
    return df.agg(F.max(wm).alias("max_watermark"))


STATE_SCHEMA = "table_name string, watermark_column string, strategy string, load_from timestamp_ntz, " \
               "load_at timestamp_ntz"


def state_init(state: DataFrame, tables: DataFrame) -> DataFrame:
    """A6 initialise-if-absent: add state rows for tables not yet tracked."""
    new = tables.select("table_name", "watermark_column", "strategy",
                        F.lit(None).cast("timestamp_ntz").alias("load_from"),
                        F.lit(None).cast("timestamp_ntz").alias("load_at"), F.lit(1).alias("_p"))
    both = state.withColumn("_p", F.lit(0)).unionByName(new)
    first = F.row_number().over(Window.partitionBy("table_name").orderBy("_p"))
    return both.withColumn("_rn", first).filter("_rn = 1").drop("_rn", "_p")


def state_advance(state: DataFrame, loaded: DataFrame) -> DataFrame:
    """A6 advance: for every (table_name, run_at, strategy, original_strategy)
    that loaded successfully, ``load_from := load_at`` and ``load_at := run_at``;
    skipped when the run was forced to a full load of an incremental table."""
    adv = loaded.filter(F.col("original_strategy").isNull()
                        | (F.col("original_strategy") == F.col("strategy"))
                        | (F.col("strategy") != "full_load")).select("table_name", "run_at")
    j = state.join(adv, "table_name", "left")
    moved = F.col("run_at").isNotNull()
    return j.select("table_name", "watermark_column", "strategy",
                    F.when(moved, F.col("load_at")).otherwise(F.col("load_from")).alias("load_from"),
                    F.when(moved, F.col("run_at").cast("timestamp_ntz")).otherwise(F.col("load_at")).alias("load_at"))


def state_reset(state: DataFrame, tables: Sequence[str] | None = None) -> DataFrame:
    """A6 reset: clear load_from/load_at for the given tables (all if None)."""
    hit = F.lit(True) if tables is None else F.col("table_name").isin(list(tables))
    return state.select("table_name", "watermark_column", "strategy",
                        *[F.when(hit, F.lit(None).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c)
                          for c in ("load_from", "load_at")])


def plan_tables(meta: DataFrame, only_strategy: str | None = None, force_full: bool = False) -> DataFrame:
    """Pick the tables of a run (all / one strategy / all forced to a full
    load, remembering ``original_strategy``), in pipeline order."""
    m = meta if only_strategy is None else meta.filter(F.col("strategy") == only_strategy)
    if force_full:
        m = m.withColumn("original_strategy", F.col("strategy")).withColumn("strategy", F.lit("full_load"))
    else:
        m = m.withColumn("original_strategy", F.lit(None).cast("string"))
    return m.orderBy("pipeline_order", "table_name")


def metadata_frame(spark: SparkSession, contracts: dict[str, Contract]) -> DataFrame:
    rows = [(c.table, c.strategy, c.watermark, c.order) for c in contracts.values()]
    return spark.createDataFrame(rows, "table_name string, strategy string, watermark_column string, "
                                       "pipeline_order int")

# ------------------------------------------------------- A10 / A12 / A13 / A14


def ingestion_stamp(df: DataFrame, ts, col: str = "ingestion_date") -> DataFrame:
    """A10: add ``ingestion_date`` if absent; fill it only where NULL."""
    v = F.lit(ts).cast("timestamp_ntz")
    if col not in df.columns:
        return df.withColumn(col, v)
    return df.withColumn(col, F.coalesce(F.col(col), v))


def apply_masks(df: DataFrame, contract: Contract | dict) -> DataFrame:
    """Columns flagged ``hash`` become sha256(lower(strip(value))) hex;
    NULL stays NULL; missing columns are skipped; ``partial`` and unknown
    kinds leave the column unchanged (as the original does)."""
    masks = contract.masks if isinstance(contract, Contract) else contract
    hashed = {c for c, kind in masks.items() if kind == "hash" and c in df.columns}
    return df.select(*[mask_hash(c).alias(c) if c in hashed else F.col(f"`{c}`") for c in df.columns])


def rowcount_nonzero(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its count and ok flag (count > 0); the run
    fails when any flag is false.  One small aggregate per table, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", F.col("row_count") > 0)


def require_nonzero(counts: DataFrame) -> None:
    """A13 gate: fail the run when any table loaded no rows, naming them.
    ``counts`` is ``rowcount_nonzero`` output (one row per table)."""
    empty = [r.table_name for r in counts.filter(~F.col("ok")).select("table_name").collect()]
    if empty:
        raise RuntimeError(f"tables loaded with 0 rows: {', '.join(sorted(empty))}")


# Fixed values normalised to NULL before a relational sink.
NULL_TOKENS = ("NaN", "nan", "null", "")


def null_normalise(df: DataFrame) -> DataFrame:
    """A14: 'NaN', 'nan', 'null', '' and floating NaN become NULL in all columns."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(list(NULL_TOKENS)), F.lit(None)).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)
