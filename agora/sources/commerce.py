"""Map the given TPC-H-style tables onto the nine commerce source tables.

Every raw table is a lazy DataFrame derived from the given Parquet files, so
its size grows with them.  The mapping rules are fixed values (they define
the fixture); the DuckDB twin lives in ``agora.plans.oracle``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table


def _id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _zip(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 5, "0")


def _state(c: str = "r_name") -> Column:
    return F.substring(F.col(c), 1, 2)


def _plus(ts: Column, unit: str, n: Column) -> Column:
    return F.timestamp_add(unit, n, ts)


class CommerceSource:
    """Raw commerce tables of one fixture directory (all lazy)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        # One relation per table: listing and footer reads happen once, and
        # the same scan node lets Spark reuse exchanges built on it.
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.sf_dir, name)
        return self._tables[name]

    @cached_property
    def _nation_region(self) -> DataFrame:
        # 25 x 5 rows by definition of the schema: a fixed-size lookup.
        n = self.t("nation")
        r = self.t("region")
        return F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)
                           .select("n_nationkey", "n_name", "r_name"))

    @cached_property
    def customers(self) -> DataFrame:
        c = self.t("customer").select("c_custkey", "c_nationkey")
        j = c.join(self._nation_region, c.c_nationkey == F.col("n_nationkey"))
        return j.select(
            _id("C", "c_custkey").alias("customer_id"),
            F.concat(F.lit("U"), (F.col("c_custkey") % 1000).cast("string")).alias("customer_unique_id"),
            F.when(F.col("c_custkey") % 53 != 0, _zip("c_nationkey")).alias("customer_zip_code_prefix"),
            F.lower("n_name").alias("customer_city"),
            _state().alias("customer_state"),
        )

    @cached_property
    def geolocation(self) -> DataFrame:
        nr = self._nation_region.filter(F.col("n_nationkey") != 24)
        return nr.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
            _zip("n_nationkey").alias("geolocation_zip_code_prefix"),
            F.col("n_nationkey").cast("decimal(10,8)").alias("geolocation_lat"),
            (-F.col("n_nationkey")).cast("decimal(11,8)").alias("geolocation_lng"),
            F.concat(F.lower("n_name"), F.when(F.col("k") == 0, F.lit("")).otherwise(F.lit("_alt")))
            .alias("geolocation_city"),
            _state().alias("geolocation_state"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        s = self.t("supplier").select("s_suppkey", "s_nationkey")
        j = s.join(self._nation_region, s.s_nationkey == F.col("n_nationkey"))
        return j.select(
            _id("S", "s_suppkey").alias("seller_id"),
            _zip("s_nationkey").alias("seller_zip_code_prefix"),
            F.lower("n_name").alias("seller_city"),
            _state().alias("seller_state"),
        )

    @cached_property
    def products(self) -> DataFrame:
        p = self.t("part")
        k = F.col("p_partkey")
        size = F.col("p_size")
        return p.select(
            _id("P", "p_partkey").alias("product_id"),
            F.when(k % 41 != 0, F.lower("p_type")).alias("product_category_name"),
            F.length("p_name").cast("int").alias("product_name_length"),
            (F.length("p_name") * 10).cast("int").alias("product_description_length"),
            F.when(k % 37 != 0, size % 9).cast("int").alias("product_photos_qty"),
            F.when(k % 29 == 0, F.lit(0)).otherwise(size * 100).cast("int").alias("product_weight_g"),
            size.cast("int").alias("product_length_cm"),
            (size % 10 + 1).cast("int").alias("product_height_cm"),
            (size % 7 + 1).cast("int").alias("product_width_cm"),
        )

    @cached_property
    def category_translation(self) -> DataFrame:
        p = self.t("part").select("p_type").filter(~F.col("p_type").startswith("PROMO"))
        return p.select(
            F.lower("p_type").alias("product_category_name"),
            F.concat(F.upper("p_type"), F.lit("_EN")).alias("product_category_name_english"),
        ).distinct()

    @cached_property
    def orders(self) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        k = F.col("o_orderkey")
        purchase = _plus(F.col("o_orderdate"), "HOUR", (k % 24).cast("int"))
        status = (F.when(F.col("o_orderstatus") == "F", "delivered")
                  .when(F.col("o_orderstatus") == "O", "shipped").otherwise("processing"))
        return o.select(
            _id("O", "o_orderkey").alias("order_id"),
            _id("C", "o_custkey").alias("customer_id"),
            status.alias("order_status"),
            purchase.alias("order_purchase_timestamp"),
            F.when(k % 31 != 0, _plus(purchase, "DAY", (k % 5).cast("int"))).alias("order_approved_at"),
            F.when(F.col("o_orderstatus").isin("F", "O"), _plus(purchase, "DAY", (k % 6 + 2).cast("int")))
            .alias("order_delivered_carrier_date"),
            F.when(F.col("o_orderstatus") == "F",
                   F.when(k % 101 == 0, _plus(purchase, "DAY", F.lit(-1)))
                   .otherwise(_plus(purchase, "DAY", (k % 30 + 3).cast("int"))))
            .alias("order_delivered_customer_date"),
            _plus(F.col("o_orderdate"), "DAY", F.lit(20)).alias("order_estimated_delivery_date"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.t("lineitem")
        # Line numbers repeat inside an order in the fixture; a total order
        # over all columns gives a unique item number per order. The window is by the
        # key that items are joined on, so that one shuffle serves both.
        w = Window.partitionBy("order_id").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
            "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
        return li.withColumn("order_id", _id("O", "l_orderkey")).select(
            "order_id",
            F.row_number().over(w).cast("int").alias("order_item_id"),
            _id("P", "l_partkey").alias("product_id"),
            _id("S", "l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
            F.col("l_quantity").cast("decimal(10,2)").alias("freight_value"),
        )

    @cached_property
    def item_ids(self) -> DataFrame:
        """The product and seller ids of ``order_items``, without the items' numbers."""
        return self.t("lineitem").select(_id("P", "l_partkey").alias("product_id"), _id("S", "l_suppkey").alias("seller_id"))

    @cached_property
    def order_payments(self) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
        k = F.col("o_orderkey")
        seq = F.explode(F.when(k % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        first_type = (F.when(F.col("o_orderpriority") == "1-URGENT", "credit_card")
                      .when(F.col("o_orderpriority") == "2-HIGH", "boleto")
                      .when(F.col("o_orderpriority") == "3-MEDIUM", "debit_card")
                      .when(F.col("o_orderpriority") == "5-LOW", "voucher")
                      .otherwise("not_defined"))
        return o.select("*", seq.alias("payment_sequential")).select(
            _id("O", "o_orderkey").alias("order_id"),
            F.col("payment_sequential").cast("int"),
            F.when(F.col("payment_sequential") == 2, F.lit("voucher")).otherwise(first_type).alias("payment_type"),
            F.when(k % 50 == 0, F.lit(0)).otherwise(k % 12 + 1).cast("int").alias("payment_installments"),
            F.when(k % 211 == 0, F.lit(0).cast("decimal(10,2)"))
            .otherwise(F.col("o_totalprice").cast("decimal(10,2)")).alias("payment_value"),
        )

    @cached_property
    def order_reviews(self) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_orderdate").filter(F.col("o_orderkey") % 3 != 0)
        k = F.col("o_orderkey")
        fmt = "yyyy-MM-dd HH:mm:ss"
        return o.select(
            F.concat(F.lit("R"), F.floor(k / 2).cast("string")).alias("review_id"),
            _id("O", "o_orderkey").alias("order_id"),
            (k % 5 + 1).cast("int").alias("review_score"),
            F.lit(None).cast("string").alias("review_comment_title"),
            F.when(k % 4 != 0, F.lit("ok")).alias("review_comment_message"),
            F.date_format(_plus(F.col("o_orderdate"), "DAY", F.lit(10)), fmt).alias("review_creation_date"),
            F.date_format(_plus(F.col("o_orderdate"), "DAY", F.lit(12)), fmt).alias("review_answer_timestamp"),
        )
