"""Helpers shared by the training-data operators.

Nothing here knows an operator: scratch tables in the cluster's shared folder,
chunked access to text columns inside Arrow tasks, and connected components of
a link table by repeated contraction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.session import checkpoint_dir

#: Words of every contract: runs of anything but space and \t \n \v \f \r.
WORDS = r"[^\x20\x09-\x0D]+"
#: Text handled at once inside a task, in bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Shift of the partition number in a row key: 2**40 rows in a partition.
KEY_SHIFT = 40


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts don't pile up in a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def scratch(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The folder comes from ``spark.checkpoint.dir``; tasks that are repeated after
    an executor is lost read the table instead of repeating what made it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of at most ``limit`` text bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held + n > limit and i > start:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def keyed_chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
                 limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Chunks of rows with a key for each row: partition number and row number."""
    context = TaskContext.get()
    seen = (context.partitionId() if context else 0) << KEY_SHIFT
    for batch in batches:
        for start, length in slices(batch, column, limit):
            yield np.arange(seen, seen + length, dtype=np.int64), batch.slice(start, length)
            seen += length


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def flat_tokens(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Row number and value of every non-empty string in a list column."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    rows = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(offsets))
    full = pc.greater(pc.binary_length(values), 0)
    return rows[full.to_numpy(zero_copy_only=False)], values.filter(full)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number and value of every word (``WORDS``, A-Z lower-cased) in order."""
    return flat_tokens(pc.ascii_split_whitespace(pc.ascii_lower(texts)))


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values."""
    d = values.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def to_arrow(df: DataFrame) -> pa.Table:
    """Bring a table to the driver; callers state why its size has a bound."""
    return df.toArrow()


def packed(table: pa.Table) -> bytes:
    """An Arrow table as bytes, to send to tasks once per worker."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def prefix_offsets(rows: DataFrame, group: list[str], levels: list[list[str]], value: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` before each finest level, within ``group``.

    ``levels`` refine each other: the order is by the columns of the first, then of
    the second, and so on. Totals are made per level with map-side sums, so that a
    window sees the totals of one parent and never all rows of a hot group. All key
    columns must be free of nulls. Returns ``group`` + level columns + ``offset``.
    """
    found = None
    totals = rows.groupBy(*group, *[c for level in levels for c in level]).agg(F.sum(value).alias("_t"))
    for i, level in enumerate(levels):
        parent = [*group, *[c for x in levels[:i] for c in x]]
        own = totals.groupBy(*parent, *level).agg(F.sum("_t").alias("_t"))
        before = Window.partitionBy(*parent).orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
        own = own.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
        if found is None:
            found = own.withColumnRenamed("_o", "offset")
        else:
            # Dealt by the whole parent: found's own window is by less, and the join would take that for all.
            found = (own.join(found.repartition(*parent), parent) if parent else own.crossJoin(found))
            found = found.withColumn("offset", F.col("offset") + F.col("_o")).drop("_o")
    return found


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links by repeated contraction.

    Returns (node, root): every node that has a link, with the node that stands for
    its component. Each round, every node moves to the neighbour (or itself) of the
    smallest hash under that round's salt and the links are rewritten between the
    targets; the expected number of remaining nodes falls by a constant factor, so a
    chain needs logarithmically many rounds. The links left and each round's moves
    are tables in the shared folder; nothing is collected.
    """
    edges = scratch(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        salt = len(moves)
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("n"))
        move = (both.groupBy("a").agg(F.min(rank("b")).alias("m"))
                .select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("to")))
        move = scratch(move, "moves")
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        edges = scratch(edges.join(left, "a").join(right, "b").where("a2 <> b2")
                        .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), "to")
        found = found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return found
