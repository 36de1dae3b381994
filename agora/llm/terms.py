"""Look up corpus-wide values of terms for per-document term frequencies.

Two tiers. Terms with at least ``HEAVY`` of all occurrences number at most
1 / ``HEAVY`` whatever the input, so their table is sent to every task and their
frequencies are summed where the text is read. All other terms are rare by
definition; their per-document frequencies meet the term table in one shuffle join
(no key in it holds more than ``HEAVY`` of the occurrences), and the sums return to
the documents by row key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import encoded, keyed_chunks, packed, texts_of, to_arrow, unpacked

#: Share of all occurrences from which a term's value is sent to every task: at most a million terms.
HEAVY = 1e-6

#: Splits texts into (row numbers, terms in order).
Splitter = Callable[[pa.Array], tuple[np.ndarray, pa.Array]]


def count_terms(docs: DataFrame, split: Splitter) -> DataFrame:
    """(term, n): occurrences of every term in all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in keyed_chunks(batches):
            codes, terms = encoded(split(texts_of(part))[1])
            yield pa.RecordBatch.from_arrays(
                [terms.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(terms)), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def heavy_terms(table: DataFrame, total: int, *columns: str) -> pa.Table:
    """The terms that hold at least ``HEAVY`` of all ``total`` occurrences: 1 / HEAVY rows at most."""
    return to_arrow(table.where(F.col("n") >= HEAVY * total).select("term", *columns).orderBy("term"))


def document_sums(docs: DataFrame, table: DataFrame, total: int, heavy: pa.Table, split: Splitter,
                  head: T.StructType, inside: Callable, rare: dict[str, Column], mark: Callable | None = None) -> DataFrame:
    """Per row of ``docs``: the ``head`` fields plus sums over its rare terms.

    ``inside(part, texts, rows, codes, terms, found, heavy)`` makes the head columns
    of a chunk, sums over heavy terms included; ``found`` has each distinct term's row
    in ``heavy`` or -1. ``rare`` has, by head field, the column to add per (document,
    rare term), made of ``freq``, ``term`` and the table's columns (null if the table
    has no such term). ``mark(codes, terms)`` may give every token a number: ``before``
    has those of the tokens of a (document, rare term), else it is null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(packed(heavy))
    names = [f.name for f in head.fields]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("term", T.StringType()),
                           T.StructField("freq", T.IntegerType()), T.StructField("before", T.ArrayType(T.IntegerType())),
                           T.StructField("head", head)])
    arrow_head = pa.struct([(f.name, {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
                             .get(f.dataType.simpleString(), pa.int64())) for f in head.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(sent.value)
        value_set = known["term"].combine_chunks()
        for keys, part in keyed_chunks(batches):
            rows, values = split(texts_of(part))
            codes, terms = encoded(values)
            terms = terms.cast(pa.string())
            found = pc.fill_null(pc.index_in(terms, value_set=value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            heads = inside(part, rows, codes, terms, found, known)
            mask = found[codes] < 0
            tokens = rows[mask] * max(1, len(terms)) + codes[mask]
            pairs, freq = np.unique(tokens, return_counts=True)
            where, which = np.divmod(pairs, max(1, len(terms)))
            n, m = len(keys), len(pairs)
            # A row's head has a term of its own, with a blank, which no term of the table equals.
            own = pc.binary_join_element_wise(pa.array(keys).cast(pa.string()), "\n", " ")
            before = pa.nulls(n + m, pa.list_(pa.int32()))
            if mark is not None:
                marks = mark(codes, terms)[mask][np.argsort(tokens, kind="stable")].astype(np.int32)
                ends = np.cumsum(np.concatenate([np.zeros(n + 1, np.int64), freq])).astype(np.int32)
                before = pa.ListArray.from_arrays(pa.array(ends), pa.array(marks))
            columns = [pa.array(np.concatenate([keys, keys[where]])), pa.concat_arrays([own, terms.take(pa.array(which))]),
                       pa.array(np.concatenate([np.zeros(n, np.int64), freq]).astype(np.int32)), before,
                       pa.concat_arrays([pa.StructArray.from_arrays([pa.array(heads[f.name], f.type) if not isinstance(heads[f.name], pa.Array) else heads[f.name].cast(f.type) for f in arrow_head], fields=list(arrow_head)), pa.nulls(m, arrow_head)])]
            for at in range(0, n + m, 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in columns], names=schema.names)

    found = docs.mapInArrow(run, schema)
    tail = table.where(F.col("n") < HEAVY * total)
    # All rows go through the join, heads too: the texts are read once.
    joined = found.join(tail, "term", "left")
    adds = [F.sum(F.when(F.col("head").isNull(), c)).alias(f"_{k}") for k, c in rare.items()]
    sums = joined.groupBy("key").agg(F.max("head").alias("head"), *adds)
    return sums.select(*[
        (F.col(f"head.{k}") + F.coalesce(F.col(f"_{k}"), F.lit(0))).alias(k) if k in rare else F.col(f"head.{k}").alias(k)
        for k in names])
