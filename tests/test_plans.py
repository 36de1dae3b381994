"""Plan shape: pushed filters, pruned scans, broadcasts, no pair-producing joins."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from agora.operators import ingest as A
from agora.sources import files
from agora.plans.catalog_ingest import LINEITEM
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_or_nested_loop(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_watermark_filter_reaches_scan_and_columns_are_pruned(spark):
    df = files.contract_scan(spark, f"{SF_SMALL}/lineitem.parquet", LINEITEM)
    s = A.watermark_slice(df, "l_shipdate", "1996-01-01", "1997-01-01").select("l_orderkey")
    p = _plan(s)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThan(l_shipdate" in p
    assert "LessThanOrEqual(l_shipdate" in p
    read_schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_orderkey" in read_schema and "l_quantity" not in read_schema and "l_partkey" not in read_schema


def test_flagship_broadcasts_bounded_dimensions(spark):
    p = _plan(E.entry(spark))
    assert p.count("BroadcastHashJoin") >= 2
    # items are joined to orders and reviews on order_id, not on customer_key + order_id
    assert "hashpartitioning(customer_key" not in p


def test_partial_aggregation_before_shuffle(spark):
    p = _plan(E.queries()["S5_event_day"](spark, SF_SMALL))
    assert "partial_count" in p or "partial_sum" in p


def test_sales_mart_copies_no_rows(spark):
    for name in ("F1_mart_sales_metrics", "F1_mart_sales_metrics_dedupe"):
        assert "Expand" not in _plan(E.queries()[name](spark, SF_SMALL))


def test_items_are_shuffled_once_for_number_and_join(spark):
    """The window that numbers an order's items and their join to the order share one shuffle."""
    p = _plan(E.queries()["C4_int_order_items_enriched"](spark, SF_SMALL))
    assert p.count("Exchange hashpartitioning") == 2 and "hashpartitioning(l_orderkey" not in p


def test_facts_are_not_shuffled_on_small_keys(spark):
    """Payments are added up per key before they leave their task; products meet items where those are."""
    p = _plan(E.queries()["Q4_payment_distribution"](spark, SF_SMALL))
    assert re.search(r"Exchange hashpartitioning\(payment_type_key[^\n]*\n[^\n]*HashAggregate\(keys=\[payment_type_key[^\n]*partial_sum", p)
    assert "hashpartitioning(product_key" not in _plan(E.queries()["Q1_top_categories_by_revenue"](spark, SF_SMALL))


@pytest.fixture()
def nothing_is_small(monkeypatch):
    """Dimensions as large as at scale: no side is broadcast."""
    from agora.plans import strategy
    monkeypatch.setattr(strategy, "are_small", lambda *dfs, **_: [False] * len(dfs))


@pytest.mark.parametrize("name", ["F1_mart_sales_metrics", "F1_mart_sales_metrics_dedupe", "F1_mart_sales_metrics_as_written",
                                  "F2_mart_customer_metrics", "F3_mart_product_metrics"])
def test_items_of_marts_meet_dimensions_by_id_and_orders_last(spark, nothing_is_small, name):
    """One shuffle of the items per large dimension and one by order; orders are counted where they are."""
    p = _plan(E.queries()[name](spark, SF_SMALL))
    items = [part for part in re.split(r"Exchange ", p) if part.startswith("hashpartitioning(")]
    by = [re.match(r"hashpartitioning\(([a-z_]+)#\d+(, [a-z_]+#\d+)*", part).group(0) for part in items if re.match(r"hashpartitioning\([a-z_]+#", part)]
    assert not [b for b in by if "seller_key" in b or re.search(r"(customer|product)_key#\d+, order_id|o_order_id#\d+, ", b)]
    assert sum("l_orderkey" in part.split("FileScan")[1] for part in items if "FileScan parquet" in part
               and re.match(r"hashpartitioning\((order_id|seller_id|product_id)#", part)) <= 3
