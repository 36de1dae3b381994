"""Model build: write the table models once, in dependency order, and compute
marts from the written tables (the production flow; staging/intermediate
models stay lazy views inside the table builds).

Layout choices per table (the reference's clustering keys): dimensions are
clustered by their state/city or category columns, ``fact_order_items`` is
partitioned by purchase month, ``fact_orders_accumulating`` clustered by
purchase date and status.  Writes use the ``rebalance`` hint so AQE sizes the
output files and splits a skewed month instead of writing one huge file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marts as M
from .models import AS_OF_ORDERS, Warehouse

# (model, partition columns, clustering columns) in dependency order.
TABLES = [
    ("dim_customer", [], ["customer_state", "customer_city"]),
    ("dim_seller", [], ["seller_state", "seller_city"]),
    ("dim_product", [], ["product_category_name"]),
    ("dim_geography", [], ["state"]),
    ("dim_payment_type", [], []),
    ("fact_order_items", ["purchase_month"], ["purchase_date"]),
    ("fact_orders_accumulating", [], ["purchase_date", "order_status"]),
    ("fact_payments", [], ["order_id"]),
    ("fact_reviews", [], ["order_id"]),
]


def _layout(df: DataFrame, model: str) -> DataFrame:
    if model == "fact_order_items":
        return df.withColumn("purchase_month", F.date_format("purchase_date", "yyyy-MM"))
    return df


def build_tables(spark: SparkSession, sf_dir: str, base: str, as_of: str = AS_OF_ORDERS) -> dict[str, str]:
    """Write every table model under ``base``; returns model -> path."""
    w = Warehouse(spark, sf_dir, as_of)
    paths = {}
    for model, parts, cluster in TABLES:
        df = _layout(getattr(w, model), model)
        df = df.hint("rebalance", *parts) if parts else df.hint("rebalance")
        if cluster:
            df = df.sortWithinPartitions(*cluster)
        path = f"{base.rstrip('/')}/{model}"
        writer = df.write.mode("overwrite")
        if parts:
            writer = writer.partitionBy(*parts)
        writer.parquet(path)
        paths[model] = path
    return paths


class BuiltTables:
    """Marts over the written tables of ``build_tables``."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], as_of: str = AS_OF_ORDERS):
        self.spark, self.paths, self.as_of = spark, paths, as_of

    def table(self, model: str) -> DataFrame:
        df = self.spark.read.parquet(self.paths[model])
        return df.drop("purchase_month") if model == "fact_order_items" else df

    def mart_sales_metrics(self, as_written: bool = False) -> DataFrame:
        t = self.table
        return M.mart_sales_metrics(t("fact_order_items"), t("dim_customer"), t("dim_seller"), t("dim_product"),
                                    t("fact_orders_accumulating"), t("fact_reviews"), as_written=as_written)

    def mart_customer_metrics(self) -> DataFrame:
        t = self.table
        return M.mart_customer_metrics(t("fact_order_items"), t("fact_reviews"), t("fact_orders_accumulating"),
                                       t("dim_customer"), self.as_of)

    def mart_product_metrics(self) -> DataFrame:
        t = self.table
        return M.mart_product_metrics(t("fact_order_items"), t("fact_reviews"), t("dim_product"), self.as_of)
