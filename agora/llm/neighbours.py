"""Operator 7: approximate nearest neighbours by NN-descent and graph search.

The index is a neighbour graph over all distinct vectors. It starts from exact
neighbours inside blocks: runs of a random order, and of orders by the sides of random
planes that the vectors lie on. Each round joins every node's neighbours and reverse
neighbours with their vectors, compares them with each other (neighbours of
neighbours) where one of the two is new, and keeps each node's nearest, until hardly a
row of the graph changes. Queries search the graph greedily: a beam of the nearest
nodes found so far, from the query's own node on, is widened by the neighbours of its
nodes until it has no node that was not widened. Both are guided by distances in double
precision on the original vectors, which are also the results'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import prepare, scratch

#: Neighbours of a node in the graph; reverse neighbours that a node adds in a round.
NEIGHBOURS, REVERSE = 24, 16
#: Rounds end when at most this share of the graph's rows is new.
SETTLED = 1e-3
#: Orders of the start by planes, planes of an order, and nodes of a block.
ORDERS, PLANES, START = 3, 48, 256
#: Nodes of a query's beam.
BEAM = 192
#: Seed of the planes.
SEED = 7


def _nearest(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark trims before the shuffle too, so a hub is no large group."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A shuffled join whatever the sizes: no vectors pass through the driver to be broadcast."""
    return left.join(right.hint("merge"), on, how)


def _rows_of(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed vectors, and where each row's begin."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    numbers = np.frombuffer(data, kind) if data is not None and data.size else np.zeros(0, kind)
    return numbers, offsets // np.dtype(kind).itemsize


def _by_length(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length of vectors in a column."""
    numbers, offsets = _rows_of(column, kind)
    lengths = np.diff(offsets)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, numbers[offsets[at][:, None] + np.arange(n)].astype(np.float64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``a`` to that of ``b``: the same for a pair wherever it is met."""
    return ((a - b) ** 2).sum(1)


def _about(x: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by one product, and a bound of their rounding errors."""
    y = x - middle
    square = (y * y).sum(1)
    both = square[:, None] + square[None, :]
    d = both - 2.0 * y @ y.T
    np.fill_diagonal(d, np.inf)
    return d, both * (4.0 * (x.shape[1] + 4) * np.finfo(np.float64).eps)


def _sides(x: np.ndarray) -> np.ndarray:
    """ORDERS numbers a row: the sides of random planes through the origin, the first plane's the highest bit."""
    planes = np.random.RandomState(SEED).normal(size=(x.shape[1], ORDERS, PLANES))
    above = np.einsum("nd,dop->nop", x / np.abs(x).max(axis=1, keepdims=True), planes, optimize=True) > 0
    return above.astype(np.int64) @ (1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64))


def _links(table: pa.Table, kind: str) -> Iterator[pa.RecordBatch]:
    """Each node's nearest others among a block's nodes of its length."""
    ids = table["node"].to_numpy()
    for at, x in _by_length(table["vector"].combine_chunks(), kind):
        k = min(NEIGHBOURS, len(at) - 1)
        if k > 0:
            d, _ = _about(x, np.median(x, axis=0))
            near = np.argpartition(d, k - 1, axis=1)[:, :k].ravel()
            rows = np.repeat(np.arange(len(at)), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[rows]]), pa.array(ids[at[near]]), pa.array(_apart(x[rows], x[near]))],
                                             names=["u", "v", "d"])


def _start(nodes: DataFrame, kind: str) -> DataFrame:
    """Exact neighbours inside the blocks of each order: (u, v, d).

    One order's blocks have no links to each other; the blocks of another cross them.
    Orders are by length first. A length of so few nodes that a block holds them all is
    a block of its own besides, so that its nodes all meet wherever blocks are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 2 * START - count)
                held.append(part)
                count, at = count + part.num_rows, at + part.num_rows
                if count == 2 * START:
                    table = pa.Table.from_batches(held)
                    yield from _links(table.slice(0, START), kind)
                    held, count = table.slice(START).to_batches(), START
        if count:
            yield from _links(pa.Table.from_batches(held), kind)

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_links(table, kind), pa.schema([("u", pa.int64()), ("v", pa.int64()), ("d", pa.float64())]))

    out = "u long, v long, d double"
    found = None
    for order in (F.xxhash64(F.lit(1), F.col("node")), *[F.col("sides")[i] for i in range(ORDERS)]):
        dealt = nodes.select("width", order.alias("place"), "node", "vector").repartitionByRange("width", "place", "node")
        near = dealt.sortWithinPartitions("width", "place", "node").select("node", "vector").mapInArrow(run, out)
        found = near if found is None else found.union(near)
    few = nodes.groupBy("width").agg(F.count("*").alias("n")).where(F.col("n") <= 2 * START).select("width")
    if not few.isEmpty():
        found = found.union(_met(nodes, few, "width").select("width", "node", "vector").groupBy("width").applyInArrow(whole, out))
    return _best(found.withColumn("new", F.lit(True)))


def _best(links: DataFrame) -> DataFrame:
    """(u, v, d, new, rank, worst): each node's nearest, once each, by one shuffle that is trimmed before.

    ``worst`` is the distance that a node must come under to be taken up by u. A link
    that was there before (not new) stays so.
    """
    near = Window.partitionBy("u").orderBy("d", "v")
    # Repeated links have equal places, so the trim before the shuffle counts different ones.
    some = links.withColumn("_r", F.dense_rank().over(near)).where(F.col("_r") <= NEIGHBOURS).drop("_r")
    once = some.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    full = F.count("*").over(Window.partitionBy("u"))
    return once.withColumn("rank", F.row_number().over(near)).withColumn(
        "worst", F.when(full < NEIGHBOURS, F.lit(float("inf"))).otherwise(F.max("d").over(Window.partitionBy("u"))))


def _round(graph: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """One round: neighbours of a common node that are nearer to each other than what they have."""
    worst = graph.where("rank = 1").select(F.col("u").alias("v"), "worst")
    known = _met(nodes.select(F.col("node").alias("v"), "vector"), worst, "v", "left")
    back = _nearest(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "new"), "u", [F.desc("new"), "d", "v"], REVERSE)
    around = graph.select("u", "v", "new").union(back.select("u", "v", "new"))
    # Nodes around which nothing is new have no pair to compare.
    lists = (around.groupBy("u").agg(F.collect_list(F.struct("v", "new")).alias("near"))  # NEIGHBOURS + REVERSE at most
             .where(F.exists("near", lambda x: x["new"])).select("u", F.inline("near")))
    full = (_met(lists, known, "v").groupBy("u")
            .agg(F.collect_list(F.struct("v", "new", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "vector")).alias("near")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("near")
            bounds = lists.offsets.to_numpy()
            flat = lists.values
            ids, worst = flat.field("v").to_numpy(), flat.field("worst").to_numpy()
            fresh = flat.field("new").to_numpy(zero_copy_only=False)
            numbers, offsets = _rows_of(flat.field("vector"), kind)
            us, vs, ds = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                y = numbers[offsets[a]:offsets[b]].astype(np.float64).reshape(b - a, -1)
                d, error = _about(y, y.mean(0))
                p, q = np.nonzero((d < worst[a:b, None] + error) & (fresh[a:b, None] | fresh[a:b][None, :])
                                  & (ids[a:b, None] != ids[a:b][None, :]))
                d = _apart(y[p], y[q])
                less = d < worst[a:b][p]
                us.append(ids[a:b][p[less]])
                vs.append(ids[a:b][q[less]])
                ds.append(d[less])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)),
                                                  pa.array(np.concatenate(ds))], names=["u", "v", "d"])

    better = full.select("near").mapInArrow(run, "u long, v long, d double")
    return _best(graph.select("u", "v", "d", F.lit(False).alias("new")).union(better.withColumn("new", F.lit(True))))


def neighbour_graph(nodes: DataFrame, kind: str) -> DataFrame:
    """(u, v, d, ...): the approximate nearest neighbours of every node (node, width, sides, vector as numpy's ``kind``)."""
    graph = scratch(_start(nodes, kind), "graph")
    while True:
        state = graph.agg(F.count("*").alias("n"), F.count_if("new").alias("new")).first()
        if state["new"] <= SETTLED * state["n"]:
            return graph
        graph = scratch(_round(graph, nodes, kind), "graph")


def _search(graph: DataFrame, nodes: DataFrame, starts: DataFrame, kind: str) -> DataFrame:
    """(q, node, d): the beam of each query node at its end; ``starts`` has (q)."""
    asked = _met(starts, nodes.select(F.col("node").alias("q"), F.col("vector").alias("asked")), "q")
    asked = scratch(asked, "asked")
    beam = scratch(starts.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("done")), "beam")
    edges = graph.select(F.col("u").alias("node"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.zeros(batch.num_rows)
                for (at, a), (_, b) in zip(_by_length(batch.column("asked"), kind), _by_length(batch.column("vector"), kind)):
                    d[at] = _apart(a, b)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(d),
                                                  pa.array(np.zeros(batch.num_rows, bool))], names=["q", "node", "d", "done"])

    while not (open_ := beam.where("NOT done")).isEmpty():
        reached = _met(open_.select("q", "node"), edges, "node").select("q", F.col("v").alias("node"), F.lit(False).alias("held"))
        # What the beam holds already is not measured again.
        found = (reached.union(beam.select("q", "node", F.lit(True).alias("held"))).groupBy("q", "node")
                 .agg(F.max("held").alias("held")).where("NOT held").select("q", "node"))
        measured = (_met(_met(found, asked, "q"), nodes.select("node", "vector"), "node")
                    .select("q", "node", "vector", "asked").mapInArrow(run, "q long, node long, d double, done boolean"))
        beam = scratch(_nearest(beam.withColumn("done", F.lit(True)).union(measured), "q", ["d", "node"], BEAM), "beam")
    return beam.select("q", "node", "d")


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest found of every query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all
    rows but the query's own. Score is the Euclidean distance in double precision on
    the original vectors; nearest first, ties to the smaller vec_id; all candidates if
    there are fewer than k (and the start's block holds them all).

    Vectors that are null, empty, zero, hold null or non-finite components, or have a
    null vec_id take no part. Vectors of different lengths have no distance and are
    never compared: each length is a graph of its own by having no links to others.
    Equal rows (same vec_id, same vector) are one. Equal vectors are one node, whose
    k + 1 smallest ids are enough for exact ties. An empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    e = F.col("embedding")
    fine = (F.col("vec_id").isNotNull() & (F.size(e) > 0)
            & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0))
    rows = vectors.select("vec_id", "embedding").where(fine).withColumn("node", F.xxhash64("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = pa.array([np.asarray(v.values, dtype=kind).tobytes() for v in batch.column("embedding")], pa.binary())
                width, sides = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, ORDERS), np.int64)
                for at, x in _by_length(packed, kind):
                    width[at], sides[at] = x.shape[1], _sides(x)
                sides = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * ORDERS), pa.array(sides.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(width), sides, packed],
                                                 names=["node", "width", "sides", "vector"])

    nodes = rows.groupBy("node").agg(F.first("embedding").alias("embedding")).mapInArrow(
        pack, "node long, width int, sides array<long>, vector binary")
    nodes = scratch(nodes, "nodes")
    if nodes.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids = rows.select("node", "vec_id").distinct()
    starts = scratch(ids.where(F.col("vec_id") % every == 0).select("vec_id", "node"), "queries")
    graph = neighbour_graph(nodes, kind)
    beam = _search(graph, nodes, starts.select(F.col("node").alias("q")).distinct(), kind)
    # Every node that ties with the last one that can count: the smaller vec_id decides.
    reach = Window.partitionBy("q").orderBy("d")
    beam = beam.withColumn("_r", F.rank().over(reach)).where(F.col("_r") <= k + 1)
    members = _nearest(ids, "node", ["vec_id"], k + 1)
    every_ = (beam.select("q", "node", F.sqrt("d").alias("score"))
              .join(starts.select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")), "q")
              .join(members, "node").where("vec_id <> query_id").select("query_id", "vec_id", "score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
