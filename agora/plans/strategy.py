"""Physical-strategy helpers a Spark user applies by hand.

``bounded_broadcast`` broadcasts a side only after checking that it really is
small: a ``limit(max_rows + 1).count()`` stops as soon as the bound is
exceeded, and beyond the bound the plain join is kept (sort-merge, or a
runtime broadcast chosen by AQE from measured shuffle sizes).
"""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

DEFAULT_MAX_ROWS = 200_000


_decisions: contextvars.ContextVar[dict | None] = contextvars.ContextVar("agora_broadcast_decisions", default=None)


@contextlib.contextmanager
def decision_scope():
    """Within one query build, the same side (same semantic plan) is checked once."""
    token = _decisions.set({})
    try:
        yield
    finally:
        _decisions.reset(token)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    return bounded_broadcasts(df, max_rows=max_rows)[0]


def bounded_broadcasts(*dfs: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> list[DataFrame]:
    """``bounded_broadcast`` for several sides; their checks run as concurrent jobs."""
    return [F.broadcast(d) if small else d for d, small in zip(dfs, are_small(*dfs, max_rows=max_rows))]


def are_small(*dfs: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> list[bool]:
    """Whether each side has at most ``max_rows`` rows."""
    memo = _decisions.get()
    keys = [(d.semanticHash(), max_rows) if memo is not None else None for d in dfs]
    todo = [i for i, k in enumerate(keys) if k is None or k not in memo]

    def small(d: DataFrame) -> bool:
        return d.limit(max_rows + 1).count() <= max_rows

    if len(todo) > 1:
        with ThreadPoolExecutor(len(todo)) as ex:
            found = dict(zip(todo, ex.map(small, [dfs[i] for i in todo])))
    else:
        found = {i: small(dfs[i]) for i in todo}
    out = []
    for i, k in enumerate(keys):
        if i in found and k is not None:
            memo[k] = found[i]
        out.append(found[i] if i in found else memo[k])
    return out


def joins_known(rows: DataFrame, known: list[DataFrame], keys: list[str], seen: DataFrame | None = None,
                max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """``rows`` joined (inner, fan-out kept) to each key table of ``known``.

    A small key table is broadcast. Of a large one, the keys that ``seen`` holds and it
    lacks or repeats are looked up first, from the keys alone: where those are few they
    are broadcast with their number, and ``rows``, many times wider, aren't shuffled.
    ``seen`` must hold every key of ``rows``. Where they are many, it is the plain join.
    """
    for key, side, small in zip(keys, known, are_small(*known, max_rows=max_rows)):
        if small or seen is None:
            rows = rows.join(F.broadcast(side) if small else side, key)
            continue
        held = side.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        odd = (seen.select(key).filter(F.col(key).isNotNull()).distinct().join(held, key, "left").filter(F.col("_n").isNull() | (F.col("_n") > 1))
               .select(key, F.coalesce("_n", F.lit(0)).cast("int").alias("_n")))
        odd = written_table(odd, f"odd_{key}")
        if odd.limit(max_rows + 1).count() > max_rows:
            rows = rows.join(side, key)
            continue
        repeats = not odd.filter("_n > 1").isEmpty()
        columns = rows.columns
        rows = rows.filter(F.col(key).isNotNull()).join(F.broadcast(odd), key, "left").filter("_n IS NULL OR _n > 0")
        if repeats:
            rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))))
        rows = rows.select(*columns)
    return rows


def written_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared ``spark.checkpoint.dir`` and
    read it back: a built table that later steps scan instead of recomputing
    the lineage (and that survives executor loss)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/agora/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return spark.read.parquet(path)
