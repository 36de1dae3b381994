"""Scans in the order of a key, dealt out by ranges instead of by key.

A window per key puts all rows of a key into one task. Here rows are dealt out by
ranges of (key, order), so that a key with a third of all rows is spread over a third
of the tasks; a range's rows carry its number (``_slice``). A running value is the one
inside (key, slice) plus what the key's earlier slices add up to, and there is only one
row per key and slice of those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.strategy import written_table


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordered") -> DataFrame:
    """A written table of ``df`` with the number of each row's range of (keys, order).

    Numbers ascend with (keys, order). Rows equal in all of them are told apart by
    their place in the input, so that they too are spread. The table is written once:
    every later pass sees the same ranges.
    """
    by = [*keys, *order, "_place"]
    dealt = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*by)
    return written_table(dealt.withColumn("_slice", F.spark_partition_id()), name)


def inside(keys: Sequence[str], order: Sequence[str]) -> tuple[Window, list[Column]]:
    """Window over the rows of a key inside a slice, up to the current row."""
    by = [F.col(c) for c in (*order, "_place")]
    return Window.partitionBy(*keys, "_slice").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0), by


def offsets(dealt: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key and slice: sum (``off_sum``) and number (``off_n``) of the rows in the key's earlier slices."""
    per = dealt.groupBy(*keys, "_slice").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("off_sum"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("off_n"))


def running(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, more: DataFrame | None = None,
            on: Sequence[str] = ()) -> DataFrame:
    """Add ``run_sum`` and ``run_n``: running sum and number of rows of a key in ``order``.

    ``dealt`` comes from ``slices`` by (a prefix of ``keys``, then ``order``). ``more``
    adds columns of a table keyed by ``on`` (some of ``keys``); it meets the offsets, not
    the rows. Keys must be free of nulls.
    """
    window, _ = inside(keys, order)
    offs = offsets(dealt, keys, value)
    if more is not None:
        offs = offs.join(more, list(on))
    rows = dealt.join(offs, [*keys, "_slice"])
    extra = [c for c in offs.columns if c not in (*keys, "_slice", "off_sum", "off_n")]
    return rows.select(*dealt.columns, *extra, (F.col("off_sum") + F.sum(value).over(window)).alias("run_sum"),
                       (F.col("off_n") + F.count(F.lit(1)).over(window)).alias("run_n"))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``run_sum`` and ``run_n``: running sum and number of ``value`` within ``keys`` in ``order``."""
    found = running(slices(df, keys, order), keys, order, value)
    return found.select(*df.columns, "run_sum", "run_n")
