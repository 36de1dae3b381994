"""Data-quality checks (H1-H12). Each check returns the violating rows
(empty = pass), except the one-row summaries H8-H10 and the suite H12.

Row-local tests of one model run in a single aggregate pass; key tests use a
map-side partially aggregated ``groupBy``; relationship tests an anti join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.strategy import bounded_broadcast


def dq_unique(df: DataFrame, col: str) -> DataFrame:
    """H1: non-NULL values seen more than once, with their count."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n_records")).filter(F.col("n_records") > 1))


def dq_not_null(df: DataFrame, col: str) -> DataFrame:
    """H2: rows whose column is NULL."""
    return df.filter(F.col(col).isNull())


def _not_accepted(col: str, values: Sequence) -> Column:
    return F.col(col).isNotNull() & ~F.col(col).isin(list(values))


def dq_accepted_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """H3: rows whose value is outside ``values``; NULL passes."""
    return df.filter(_not_accepted(col, values))


def dq_relationships(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """H4: child rows whose non-NULL key has no parent."""
    p = parent.select(F.col(pk).alias("_pk")).filter(F.col("_pk").isNotNull())
    return child.filter(F.col(fk).isNotNull()).join(p, F.col(fk) == F.col("_pk"), "left_anti")


def _out_of_range(col: str, min_value=None, max_value=None, inclusive: bool = True) -> Column:
    c = F.col(col)
    cond = F.lit(False)
    if min_value is not None:
        cond = cond | ((c < min_value) if inclusive else (c <= min_value))
    if max_value is not None:
        cond = cond | ((c > max_value) if inclusive else (c >= max_value))
    return c.isNotNull() & cond


def dq_accepted_range(df: DataFrame, col: str, min_value=None, max_value=None,
                      inclusive: bool = True) -> DataFrame:
    """H5: rows outside [min, max]; NULL passes."""
    return df.filter(_out_of_range(col, min_value, max_value, inclusive))


def dq_valid_order_dates(fact_orders: DataFrame) -> DataFrame:
    """H6: orders delivered before they were purchased."""
    return (fact_orders.filter(F.col("delivered_date") < F.col("purchase_date"))
            .select("order_id", "purchase_date", "delivered_date"))


def dq_positive_revenue(fact_orders: DataFrame, fact_payments: DataFrame) -> DataFrame:
    """H7: delivered orders whose payments sum to <= 0."""
    delivered = fact_orders.filter(F.col("order_status") == "delivered").select("order_id")
    return (fact_payments.select("order_id", "payment_value").join(delivered, "order_id")
            .groupBy("order_id").agg(F.sum("payment_value").alias("total_revenue"))
            .filter(F.col("total_revenue") <= 0))


def dq_pk_check(df: DataFrame, pk: Sequence[str], min_not_null_ratio: float = 1.0) -> DataFrame:
    """H8: one row with key uniqueness and non-NULL ratio of a primary key."""
    key = F.struct(*[F.col(c) for c in pk])
    any_null = F.lit(False)
    for c in pk:
        any_null = any_null | F.col(c).isNull()
    s = df.agg(F.count(F.lit(1)).alias("total_rows"),
               F.count_distinct(key).alias("distinct_keys"),
               F.count_if(any_null).alias("null_keys"))
    ratio = F.when(F.col("total_rows") > 0,
                   F.round((F.col("total_rows") - F.col("null_keys")) / F.col("total_rows"), 6)).otherwise(F.lit(1.0))
    return s.select(
        "total_rows", "distinct_keys", "null_keys",
        (F.col("total_rows") - F.col("distinct_keys")).alias("duplicate_rows"),
        ratio.alias("not_null_ratio"),
        (F.col("total_rows") == F.col("distinct_keys")).alias("unique_ok"),
        (ratio >= min_not_null_ratio).alias("not_null_ok"))


def dq_rowcount_drop(now: DataFrame, prev: DataFrame, min_ratio: float = 0.95) -> DataFrame:
    """H9: this load must keep at least ``min_ratio`` of the previous row count."""
    tagged = (now.select(F.lit(1).alias("_now"), F.lit(0).alias("_prev"))
              .unionByName(prev.select(F.lit(0).alias("_now"), F.lit(1).alias("_prev"))))
    j = tagged.agg(F.coalesce(F.sum("_now"), F.lit(0)).cast("long").alias("current_rows"),
                   F.coalesce(F.sum("_prev"), F.lit(0)).cast("long").alias("previous_rows"))
    ratio = F.when(F.col("previous_rows") > 0,
                   F.round(F.col("current_rows") / F.col("previous_rows"), 6))
    return j.select("current_rows", "previous_rows", ratio.alias("ratio"),
                    (F.coalesce(ratio, F.lit(1.0)) >= min_ratio).alias("passed"))


def dq_quality_score(df: DataFrame, pk: Sequence[str], cols: Sequence[str] | None = None,
                     threshold: float = 95.0) -> DataFrame:
    """100 * (total - rows with a NULL - surplus key rows) / total; 0 if empty."""
    cols = list(cols) if cols else list(df.columns)
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    key = F.struct(*[F.col(c) for c in pk])
    s = df.agg(F.count(F.lit(1)).alias("total_records"),
               F.count_if(any_null).alias("null_records"),
               (F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicate_records"))
    valid = F.col("total_records") - F.col("null_records") - F.col("duplicate_records")
    score = F.when(F.col("total_records") > 0,
                   F.round(valid * 100.0 / F.col("total_records"), 2)).otherwise(F.lit(0.0))
    return s.select("total_records", "null_records", "duplicate_records", valid.alias("valid_records"),
                    score.alias("quality_score"), (score < threshold).alias("quality_issue"))


def dq_check_enum(df: DataFrame, checks: dict[str, Sequence]) -> DataFrame:
    """CHECK-constraint style enums; one row per violating (row, column).

    All checks run in one pass: each row emits one struct per failed check."""
    hits = F.filter(F.array(*[
        F.when(_not_accepted(c, v), F.struct(F.lit(c).alias("check_column"), F.col(c).cast("string").alias("bad_value")))
        for c, v in checks.items()]), lambda x: x.isNotNull())
    return (df.select(F.explode(hits).alias("_v"), *df.columns)
            .select("_v.check_column", "_v.bad_value", *df.columns))


@dataclass
class Test:
    kind: str                      # not_null | unique | accepted_values | accepted_range | relationships
    column: str
    values: Sequence | None = None
    min_value: object = None
    max_value: object = None
    parent: DataFrame | str | None = field(default=None, repr=False)
    parent_key: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.column}"


def dq_suite(model: str, df: DataFrame, tests: Sequence[Test]) -> DataFrame:
    """All tests of a model in one result table (model, test, failures, status).

    Row-local tests share one aggregate pass over the model; each ``unique``
    and ``relationships`` test adds one keyed aggregation. The model is read once per
    such test, so it should be a table.
    """
    local = [t for t in tests if t.kind in ("not_null", "accepted_values", "accepted_range")]
    results: list[DataFrame] = []
    if local:
        def cond(t: Test) -> Column:
            if t.kind == "not_null":
                return F.col(t.column).isNull()
            if t.kind == "accepted_values":
                return _not_accepted(t.column, t.values)
            return _out_of_range(t.column, t.min_value, t.max_value)
        counts = df.agg(*[F.count_if(cond(t)).alias(f"t{i}") for i, t in enumerate(local)])
        stack = F.explode(F.array(*[F.struct(F.lit(t.name).alias("test_name"),
                                             F.col(f"t{i}").alias("failures"))
                                    for i, t in enumerate(local)]))
        results.append(counts.select(stack.alias("r")).select("r.*"))
    for t in tests:
        if t.kind == "unique":
            bad = dq_unique(df, t.column).agg(F.count(F.lit(1)).alias("failures"))
        elif t.kind == "relationships":
            # Only distinct keys, with their number, meet the parent.
            keys = df.filter(F.col(t.column).isNotNull()).groupBy(t.column).agg(F.count(F.lit(1)).alias("_n"))
            parent = bounded_broadcast(t.parent.select(t.parent_key))
            bad = dq_relationships(keys, t.column, parent, t.parent_key).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("failures"))
        else:
            continue
        results.append(bad.select(F.lit(t.name).alias("test_name"), "failures"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.lit(model).alias("model"), "test_name", F.col("failures").cast("long").alias("failures"),
                      F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"))


def counted(bad: DataFrame, model: str, test: str) -> DataFrame:
    """The number of violating rows as a row of the result table."""
    return with_status(bad.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(model).alias("model"), F.lit(test).alias("test_name"), "failures"))


def with_status(found: DataFrame) -> DataFrame:
    return found.select("model", "test_name", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"),
                        F.when(F.coalesce("failures", F.lit(0)) == 0, "pass").otherwise("fail").alias("status"))


def dq_model(model: str, table: DataFrame, tests: Sequence[Test], parents: dict[str, DataFrame]) -> DataFrame:
    """H12 on a written table: all tests of a model.

    Row-local tests are one aggregate. The rows of a tested key are counted per value
    once, for its uniqueness and for its relationship alike; only distinct values meet
    the parent. ``parents`` holds the tables that ``Test.parent`` names.
    """
    def bad(t: Test) -> Column:
        if t.kind == "not_null":
            return F.col(t.column).isNull()
        if t.kind == "accepted_values":
            return F.col(t.column).isNotNull() & ~F.col(t.column).cast("string").isin(list(t.values))
        return _out_of_range(t.column, t.min_value, t.max_value)

    def row(t: Test, failures: Column) -> Column:
        return F.struct(F.lit(t.name).alias("test_name"), failures.cast("long").alias("failures"))

    results = []
    local = [t for t in tests if t.kind not in ("unique", "relationships")]
    if local:
        results.append(table.agg(F.array(*[row(t, F.count_if(bad(t))) for t in local]).alias("r")))
    for column in dict.fromkeys(t.column for t in tests if t.kind in ("unique", "relationships")):
        own = [t for t in tests if t.column == column and t.kind in ("unique", "relationships")]
        values = table.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        counts = []
        for i, t in enumerate(own):
            if t.kind == "unique":
                counts.append(row(t, F.count_if(F.col("_n") > 1)))
            else:
                there = parents[t.parent].select(F.col(t.parent_key).alias("_k"), F.lit(True).alias(f"_in{i}")).distinct()
                values = values.join(there, "_k", "left")
                counts.append(row(t, F.coalesce(F.sum(F.when(F.col(f"_in{i}").isNull(), F.col("_n"))), F.lit(0))))
        results.append(values.agg(F.array(*counts).alias("r")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return with_status(out.select(F.explode("r").alias("r")).select(F.lit(model).alias("model"), "r.*"))
