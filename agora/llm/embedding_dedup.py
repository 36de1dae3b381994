"""Operator 2: embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated (random signs, then a Hadamard transform) and split into
blocks of few dimensions. Two vectors within squared distance D are, in at least one
block, within that block's proportional part of D. Each block is range-joined on its
own: slabs as wide as the block's radius along its first coordinate, so partners lie
in the same or the next slab. A candidate is verified exactly in the task that found
it, and counts only in the first block that holds it, so the union of the blocks has
each pair once without any pair being written. Tasks return counts of links and a
spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, prepare, scratch

#: Dimensions of a block.
BLOCK = 8
#: Rows of a slab that one task takes; larger slabs are dealt to tasks as pairs of parts.
PART = 2_048
#: Seed of the random signs.
SEED = 20_240_611


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow of squares."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """An orthogonal map, by sums and differences alone: a row's result doesn't depend on other rows."""
    n, d = vectors.shape
    width = max(BLOCK, 1 << (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = vectors * np.random.RandomState(SEED).choice([-1.0, 1.0], d)
    h = 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width) / np.sqrt(width)


def block_budget(width: int, cosine: float) -> float:
    """A block's part of the squared distance at this cosine, with room for rounding."""
    return (2.0 - 2.0 * cosine) * BLOCK / width * (1 + 1e-9) + 1e-12


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1).astype(np.float64)


def _slabs(classes: DataFrame, cosine: float, kind: str) -> DataFrame:
    """Where each vector stands: its own slab of every block (home) and, as a visitor, the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                # Vectors of one table may differ in length; those of different length have no cosine.
                by_width: dict[int, list[int]] = {}
                data = part.column("vector").to_pylist()
                for i, v in enumerate(data):
                    by_width.setdefault(len(v), []).append(i)
                for bytes_, at in by_width.items():
                    x = rotated(unit(_matrix([data[i] for i in at], kind)))
                    blocks = x.shape[1] // BLOCK
                    radius = np.sqrt(block_budget(x.shape[1], cosine)) * (1 + 1e-6)
                    slab = np.floor(x[:, ::BLOCK] / radius).astype(np.int64)
                    n = len(at)
                    rows = part.take(pa.array(at * 2 * blocks))
                    home = np.repeat(np.array([True, False]), n * blocks)
                    block = np.tile(np.repeat(np.arange(blocks), n), 2)
                    where = np.concatenate([slab.T.ravel(), slab.T.ravel() + 1])
                    yield pa.RecordBatch.from_arrays([
                        rows.column("label"), rows.column("cid"), pa.array(np.full(2 * n * blocks, bytes_, np.int32)),
                        pa.array(block.astype(np.int32)), pa.array(where), pa.array(home)],
                        names=["label", "cid", "width", "block", "slab", "home"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "cid", "vector").mapInArrow(
        run, f"label {label}, cid long, width int, block int, slab long, home boolean")


def _joined(cosine: float, kind: str):
    """Verify one task: part x with part y of a slab."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["cid", "home"]).sort_values(["home", "cid"], ascending=[False, True])
        block, i, j = int(group["block"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
        cid, part, home = group["cid"].to_numpy(), group["part"].to_numpy(), group["home"].to_numpy()
        copies = group["copies"].to_numpy()
        raw = _matrix(group["vector"].tolist(), kind)
        plain = unit(raw)
        x = rotated(plain)
        budget = block_budget(x.shape[1], cosine)
        own = np.ascontiguousarray(x[:, block * BLOCK:(block + 1) * BLOCK])
        square = (own * own).sum(1)
        parent = list(range(len(cid)))

        def find(a: int) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        links = np.zeros(len(cid), np.int64)
        homes = int(home.sum())
        numbers = np.arange(len(cid))
        for first in range(0, homes, 256):
            last = min(first + 256, homes)
            near = square[first:last, None] + square[None, :] - 2.0 * own[first:last] @ own.T <= budget + 1e-9
            for a in np.flatnonzero(near.any(axis=1)).tolist():
                row = first + a
                # Homes meet later homes and every visitor; of two parts, one from each.
                ok = near[a] & ((numbers > row) | ~home)
                ok &= (part == j) if i == j else (part != part[row])
                c = np.flatnonzero(ok)
                if not len(c):
                    continue
                cos = (plain[c] * plain[row]).sum(1)
                c = c[cos >= cosine]
                if not len(c):
                    continue
                apart = ((x[c] - x[row]) ** 2).reshape(len(c), -1, BLOCK).sum(2) <= budget
                # The first block that holds a pair counts it.
                c = c[apart.argmax(1) == block]
                links[row] += copies[c].sum()
                links[c] += copies[row]
                for b in c.tolist():
                    p, q = find(row), find(b)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        held = np.flatnonzero(links)
        roots = np.array([find(a) for a in held.tolist()], dtype=np.int64)
        return pd.DataFrame({"a": cid[held], "b": cid[roots] if len(held) else cid[held], "n": links[held]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine in double
    precision is at least ``cosine``. ``n_links`` counts other rows linked directly,
    ``component_id`` is the smallest vec_id reachable by links, itself included, and
    ``kept`` tells if the row has that id.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing. Vectors of different lengths don't link. Equal
    vectors under one label (repeated rows too) are one class with a number of copies;
    copies link. A null vec_id links like others but is no component's id unless there
    is no other; an empty table gives no rows; other columns are ignored.
    """
    prepare(vectors.sparkSession)
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    e = F.col("embedding")
    fine = (F.col("label").isNotNull() & (F.size(e) > 0)
            & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0))
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("cid", F.when(F.col("fine"), F.xxhash64("label", "embedding")))
    label = vectors.schema["label"].dataType.simpleString()

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(v.values, dtype=kind).tobytes() for v in batch.column("embedding")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())],
                                             names=["label", "cid", "copies", "vector"])

    classes = (rows.where("fine").groupBy("label", "cid").agg(F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
               .mapInArrow(binary, f"label {label}, cid long, copies long, vector binary"))
    classes = scratch(classes, "vectors")
    slabs = scratch(_slabs(classes, cosine, kind), "slabs")
    place = ["label", "width", "block", "slab"]
    sizes = slabs.groupBy(*place).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    # Each part meets every part of its slab, itself too, in a task of its own.
    dealt = (slabs.join(sizes, place).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*place, "cid", "home", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")))
    full = dealt.join(classes, ["label", "cid"])
    found = scratch(full.groupBy(*place, "i", "j").applyInPandas(_joined(cosine, kind), "a long, b long, n long"), "found")
    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("a <> b").select("a", "b"))
    by_class = (rows.where("fine").groupBy("label", "cid").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
                .join(counts, "cid", "left").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
                .withColumn("root", F.coalesce("root", "cid")))
    smallest = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = by_class.join(smallest, "root").select(
        "cid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("fine").select("vec_id", "cid").join(by_class, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same links in DuckDB, by comparing all pairs of a label.
ORACLE = """
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x,
         label IS NOT NULL AND coalesce(len(embedding), 0) > 0
         AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
         AND len(list_filter(embedding, lambda v: v <> 0)) > 0 AS fine
  FROM embeddings),
edges AS (
  SELECT a.r AS a, b.r AS b FROM rows_ a JOIN rows_ b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
  WHERE a.fine AND b.fine AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (
  SELECT r AS a, r AS b FROM rows_ UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least_ AS (
  SELECT reach.a AS r, min(rows_.vec_id) AS component_id FROM reach JOIN rows_ ON reach.b = rows_.r GROUP BY reach.a),
counts AS (
  SELECT a AS r, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows_ JOIN least_ USING (r) LEFT JOIN counts USING (r)
"""
