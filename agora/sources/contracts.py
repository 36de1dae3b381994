"""Table contracts: column list and types, keys, watermark, masking, strategy.

Contracts are data; ``Contract.struct`` gives the explicit read schema so no
job ever infers a schema.  Values below are fixed (the source contracts).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "money": T.DecimalType(10, 2), "lat": T.DecimalType(10, 8), "lng": T.DecimalType(11, 8),
}


def spark_type(name: str) -> T.DataType:
    name = name.lower().strip()
    if name in _TYPES:
        return _TYPES[name]
    if name.startswith("decimal"):
        p, s = name[name.index("(") + 1:name.index(")")].split(",")
        return T.DecimalType(int(p), int(s))
    if name.startswith(("varchar", "char", "text")):
        return T.StringType()
    if name in ("integer", "smallint"):
        return T.IntegerType()
    if name in ("datetime", "timestamp_ntz"):
        return T.TimestampNTZType()
    if name in ("float", "real"):
        return T.DoubleType()
    raise ValueError(f"unknown type {name}")


@dataclass(frozen=True)
class Contract:
    table: str
    columns: tuple[tuple[str, str, bool], ...]      # (name, type, nullable)
    primary_key: tuple[str, ...] = ()
    watermark: str | None = None
    masks: dict = field(default_factory=dict)      # column -> 'hash' | 'partial'
    strategy: str = "full_load"
    order: int = 0

    @property
    def names(self) -> list[str]:
        return [c[0] for c in self.columns]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(t), nullable) for n, t, nullable in self.columns])


def _c(table, cols, pk=(), wm=None, masks=None, order=0):
    return Contract(table, tuple((n, t, n not in pk) for n, t in cols), tuple(pk), wm, masks or {}, "full_load", order)


# Fixed source contracts (column order as declared by the source tables).
CONTRACTS: dict[str, Contract] = {c.table: c for c in [
    _c("customers", [("customer_id", "string"), ("customer_unique_id", "string"),
                     ("customer_zip_code_prefix", "string"), ("customer_city", "string"),
                     ("customer_state", "string")], ["customer_id"],
       masks={"customer_city": "hash", "customer_state": "hash"}, order=1),
    _c("geolocation", [("geolocation_zip_code_prefix", "string"), ("geolocation_lat", "lat"),
                       ("geolocation_lng", "lng"), ("geolocation_city", "string"),
                       ("geolocation_state", "string")], order=2),
    _c("order_items", [("order_id", "string"), ("order_item_id", "int"), ("product_id", "string"),
                       ("seller_id", "string"), ("shipping_limit_date", "timestamp"), ("price", "money"),
                       ("freight_value", "money")], ["order_id", "order_item_id"], "shipping_limit_date", order=5),
    _c("order_payments", [("order_id", "string"), ("payment_sequential", "int"), ("payment_type", "string"),
                          ("payment_installments", "int"), ("payment_value", "money")],
       ["order_id", "payment_sequential"], order=6),
    _c("order_reviews", [("review_id", "string"), ("order_id", "string"), ("review_score", "int"),
                         ("review_comment_title", "string"), ("review_comment_message", "string"),
                         ("review_creation_date", "string"), ("review_answer_timestamp", "string")],
       ["review_id"], "review_creation_date", order=7),
    _c("orders", [("order_id", "string"), ("customer_id", "string"), ("order_status", "string"),
                  ("order_purchase_timestamp", "timestamp"), ("order_approved_at", "timestamp"),
                  ("order_delivered_carrier_date", "timestamp"), ("order_delivered_customer_date", "timestamp"),
                  ("order_estimated_delivery_date", "timestamp")], ["order_id"], "order_purchase_timestamp",
       order=4),
    _c("products", [("product_id", "string"), ("product_category_name", "string"),
                    ("product_name_length", "int"), ("product_description_length", "int"),
                    ("product_photos_qty", "int"), ("product_weight_g", "int"), ("product_length_cm", "int"),
                    ("product_height_cm", "int"), ("product_width_cm", "int")], ["product_id"], order=3),
    _c("sellers", [("seller_id", "string"), ("seller_zip_code_prefix", "string"), ("seller_city", "string"),
                   ("seller_state", "string")], ["seller_id"], order=3),
    _c("category_translation", [("product_category_name", "string"),
                                ("product_category_name_english", "string")], ["product_category_name"], order=2),
]}


def _named(columns: list | dict) -> list[dict]:
    """Columns as dicts that hold their name; a mapping's value may be the type alone."""
    if isinstance(columns, dict):
        return [{"name": k, **(c if isinstance(c, dict) else {"type": c})} for k, c in columns.items()]
    return columns


def _type_or_text(name: str) -> T.DataType:
    name = name.lower().strip().replace("numeric", "decimal")
    try:
        return spark_type(name)
    except (KeyError, ValueError):
        return T.StringType()


def schema_from_metadata(meta: str | dict, add_ingested: bool = True) -> tuple[T.StructType, list[str]]:
    """Metadata JSON -> (StructType, primary key).

    ``{"columns": ...}`` holds a list of ``{"name", "type", "nullable",
    "primary_key"}`` or a mapping from names to the rest; a type that is not
    known becomes text.  OBJECT columns with ``fields`` (list or mapping) become ``<col>_<field>`` columns; an
    ``ingested_datetime`` timestamp is appended when absent.
    """
    m = json.loads(meta) if isinstance(meta, str) else meta
    fields: list[T.StructField] = []
    pk: list[str] = []
    for c in _named(m["columns"]):
        if c.get("primary_key"):
            pk.append(c["name"])
        if c["type"].lower() in ("object", "jsonb") and c.get("fields"):
            for f in _named(c["fields"]):
                fields.append(T.StructField(f"{c['name']}_{f['name']}", _type_or_text(f["type"]), True))
            continue
        t = T.StringType() if c["type"].lower() in ("object", "jsonb") else _type_or_text(c["type"])
        fields.append(T.StructField(c["name"], t, bool(c.get("nullable", True)) and not c.get("primary_key")))
    if add_ingested and "ingested_datetime" not in {f.name for f in fields}:
        fields.append(T.StructField("ingested_datetime", T.TimestampNTZType(), True))
    return T.StructType(fields), pk
