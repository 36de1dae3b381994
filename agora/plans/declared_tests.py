"""The declared data tests of the warehouse, as data, and the job that runs them all.

Each line of ``DECLARED`` is a model and its tests: ``column kind[, kind ...]``, several
columns parted by ``;``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as H
from ..operators import scd2 as G
from ..session import checkpoint_dir
from .catalog import register
from .catalog_marts import F1_BODY
from .models import Warehouse
from .oracle import with_ctes
from .strategy import written_table

# The models, columns, kinds and value lists that the warehouse declares.
STATUSES = "delivered shipped canceled processing invoiced created approved unavailable"
DECLARED = f"""
raw.customers: customer_id unique, not_null
raw.geolocation: geolocation_zip_code_prefix not_null
raw.order_items: order_id not_null; price not_null
raw.order_payments: order_id not_null; payment_value not_null
raw.order_reviews: review_id not_null; order_id not_null; review_score in 1 2 3 4 5; review_creation_date not_null; review_answer_timestamp not_null
raw.orders: order_id unique, not_null; customer_id not_null; order_status in {STATUSES}; order_purchase_timestamp not_null
raw.products: product_id unique, not_null
raw.sellers: seller_id unique, not_null
raw.category_translation: product_category_name unique, not_null; product_category_name_english not_null
stg_customers: customer_id unique, not_null
stg_geolocation: geolocation_zip_code_prefix not_null
stg_order_items: order_id not_null; price not_null
stg_order_payments: order_id not_null; payment_value not_null
stg_order_reviews: id unique, not_null; review_id not_null; order_id not_null; review_score in 1 2 3 4 5; review_sentiment in positive neutral negative
stg_orders: order_id unique, not_null; customer_id not_null; order_status in {STATUSES}; order_purchase_timestamp not_null; delivery_performance in on_time late unknown
stg_products: product_id unique, not_null; photo_category in no_photos few_photos moderate_photos many_photos
stg_sellers: seller_id unique, not_null
stg_category_translation: product_category_name unique, not_null; product_category_name_english not_null
int_customers_geocoded: customer_id unique, not_null
int_orders_lifecycle: order_id unique, not_null; customer_id not_null; purchase_date not_null
dim_customer: customer_key unique, not_null; customer_id unique, not_null
dim_seller: seller_key unique, not_null; seller_id unique, not_null
dim_product: product_key unique, not_null; product_id unique, not_null
fact_orders_accumulating: order_id unique, not_null; customer_id not_null, key of dim_customer; order_status not_null; purchase_date not_null
fact_order_items: order_item_key unique, not_null; customer_key key of dim_customer; seller_key key of dim_seller; product_key key of dim_product; freight_value not_null, from 0; total_item_value not_null, from 0; price not_null, from 0
fact_payments: order_id not_null; payment_type_key not_null, key of dim_payment_type
fact_reviews: review_key unique, not_null; review_id not_null; order_id not_null
mart_sales_metrics: order_month not_null
mart_customer_metrics: customer_key unique, not_null; customer_lifetime_value not_null
mart_product_metrics: product_key unique, not_null
snap_dim_customer: customer_id not_null
snap_dim_seller: seller_id not_null
snap_dim_product: product_id not_null
"""


def declared() -> dict[str, list[H.Test]]:
    """Tests by model; the parent of a ``key of`` test is the parent's name."""
    found: dict[str, list[H.Test]] = {}
    for line in DECLARED.strip().splitlines():
        model, columns = line.split(": ", 1)
        for column in columns.split("; "):
            name, kinds = column.split(" ", 1)
            for kind in kinds.split(", "):
                word, *values = kind.split(" ")
                if word == "in":
                    test = H.Test("accepted_values", name, values=values)
                elif word == "from":
                    test = H.Test("accepted_range", name, min_value=int(values[0]))
                elif word == "key":
                    test = H.Test("relationships", name, parent=values[1], parent_key=name)
                else:
                    test = H.Test(word, name)
                found.setdefault(model, []).append(test)
    return found


def _sql() -> str:
    """DuckDB twin: one count per test."""
    tables = {"raw.order_payments": "raw_payments", "raw.order_reviews": "raw_reviews", "raw.category_translation": "raw_translation",
              "mart_sales_metrics": f"({F1_BODY.replace('{cond}', 'fi.order_id = o.order_id')})",
              "mart_customer_metrics": "(SELECT customer_key, sum(total_item_value) AS customer_lifetime_value FROM dim_customer JOIN "
                                       "fact_order_items USING (customer_key) GROUP BY 1)",
              "mart_product_metrics": "(SELECT DISTINCT product_key FROM dim_product JOIN fact_order_items USING (product_key))",
              "snap_dim_customer": "int_customers_geocoded", "snap_dim_seller": "int_sellers_geocoded", "snap_dim_product": "int_products_cleaned"}
    parts = []
    for model, tests in declared().items():
        source = tables.get(model, model.replace(".", "_"))
        for t in tests:
            c = t.column
            bad = {"not_null": f"SELECT count(*) FROM {source} x WHERE {c} IS NULL",
                   "unique": f"SELECT count(*) FROM (SELECT {c} FROM {source} x WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
                   "accepted_values": f"SELECT count(*) FROM {source} x WHERE CAST({c} AS VARCHAR) NOT IN ({', '.join(repr(v) for v in t.values or [])})",
                   "accepted_range": f"SELECT count(*) FROM {source} x WHERE {c} < {t.min_value}",
                   "relationships": f"SELECT count(*) FROM {source} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {t.parent} p WHERE p.{c} = x.{c})"}
            parts.append(f"SELECT '{model}' AS model, '{t.name}' AS test_name, ({bad[t.kind]}) AS failures")
    parts.append("SELECT 'fact_orders_accumulating', 'valid_order_dates', (SELECT count(*) FROM fact_orders_accumulating WHERE delivered_date < purchase_date)")
    parts.append("""SELECT 'fact_payments', 'positive_revenue', (SELECT count(*) FROM (SELECT order_id FROM fact_payments JOIN fact_orders_accumulating
        USING (order_id) WHERE order_status = 'delivered' GROUP BY 1 HAVING sum(payment_value) <= 0))""")
    return with_ctes(f"""SELECT model, test_name, CAST(failures AS BIGINT) AS failures,
        CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({' UNION ALL '.join(parts)})""")


@register("H12_declared_tests", _sql())
def q_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 104 declared tests. Of each model the tested columns are written once; its tests read those."""
    w = Warehouse(spark, sf_dir)
    w.store_items()
    history = f"{checkpoint_dir(spark).rstrip('/')}/agora/history/{uuid.uuid4().hex}"

    def model(name: str) -> DataFrame:
        if name.startswith("snap_dim_"):
            kind = name.removeprefix("snap_dim_")
            getattr(G, name)(f"{history}/{kind}", getattr(w, f"int_{kind}s_{'cleaned' if kind == 'product' else 'geocoded'}"), "2024-01-01 00:00:00")
            return G.stored_history(spark, f"{history}/{kind}")
        found = getattr(w.raw, name[4:]) if name.startswith("raw.") else getattr(w, name)
        return found() if callable(found) else found

    # Columns that other models' tests, and the two whole-table tests, read besides a model's own.
    more = {"dim_customer": ["customer_id", "customer_key"], "dim_payment_type": ["payment_type_key"],
            "fact_orders_accumulating": ["delivered_date"], "fact_payments": ["payment_value"]}
    tests = declared()
    tables: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in tables:
            columns = dict.fromkeys([*[t.column for t in tests.get(name, [])], *more.get(name, [])])
            found = model(name).select(*columns)
            # The items are written already, by ids, in a third of the space of their keys.
            tables[name] = found if name == "fact_order_items" else written_table(found, name.replace(".", "_"), "zstd")
        return tables[name]

    found = [H.dq_model(name, table(name), own, {t.parent: table(t.parent) for t in own if t.parent}) for name, own in tests.items()]
    whole = {("fact_orders_accumulating", "valid_order_dates"): H.dq_valid_order_dates(table("fact_orders_accumulating")),
             ("fact_payments", "positive_revenue"): H.dq_positive_revenue(table("fact_orders_accumulating"), table("fact_payments"))}
    found += [H.counted(bad, *names) for names, bad in whole.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
