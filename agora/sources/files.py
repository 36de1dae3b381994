"""File and database readers/writers: contract scans, CSV imports, lake
writes, by-name copies, chunked appends and partition reloads.

A1 contract_scan, A2 csv_import, A4 load_full, A8 lake_write, A9 copy_by_name,
A11 csv_stage_load, A15 chunked_append and append_chunks, A18 load_partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import running_totals
from ..plans.strategy import written_table
from .contracts import Contract

CSV_NULLS = ("NULL", "null", "")


def contract_scan(spark: SparkSession, path: str, contract: Contract, fmt: str = "parquet",
                  options: dict | None = None) -> DataFrame:
    """A1: read with the contract's explicit schema and project exactly its
    columns in contract order (no inference, no drift).  ``fmt='jdbc'`` reads
    ``dbtable=path`` with partitioned reads when ``options`` name
    ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``."""
    if fmt == "jdbc":
        r = spark.read.format("jdbc").option("dbtable", path)
        for k, v in (options or {}).items():
            r = r.option(k, v)
        df = r.load()
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.struct.fields])
    r = spark.read.format(fmt)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    if fmt == "parquet":
        # Parquet carries types; project and cast so that the contract wins.
        df = r.load(path)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.struct.fields])
    return r.schema(contract.struct).load(path).select(*contract.names)


def _clean(c: str, blank_to_null: bool, trim: bool) -> F.Column:
    x = F.col(c)
    if trim:
        x = F.trim(x)
    return F.nullif(x, F.lit("")) if blank_to_null else x


def csv_import(spark: SparkSession, path: str, contract: Contract, trim_blanks: bool = True,
               newline_columns: Sequence[str] = ()) -> DataFrame:
    """A2: CSV with a header, '"' quotes and doubled quotes as escape, records
    may span lines (CRLF or LF).  Blank (after trim when ``trim_blanks``)
    becomes NULL; newlines inside ``newline_columns`` become spaces; text that
    does not fit a column type becomes NULL (``try_cast``)."""
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in contract.names])
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", True).schema(text_schema).csv(path))
    cols = []
    for f in contract.struct.fields:
        x = _clean(f.name, True, trim_blanks)
        if f.name in newline_columns:
            x = F.regexp_replace(x, r"\r?\n", " ")
        if not isinstance(f.dataType, T.StringType):
            x = x.try_cast(f.dataType)
        cols.append(x.alias(f.name))
    return raw.select(*cols)


def csv_stage_load(spark: SparkSession, path: str, contract: Contract, null_if: Sequence[str] = CSV_NULLS,
                   corrupt_col: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """CSV load that skips bad rows: returns (loaded, rejected).

    PERMISSIVE parsing keeps malformed lines in ``corrupt_col``; values in
    ``null_if`` become NULL before typing.
    """
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", corrupt_col).option("nullValue", "\u0000")
           .schema(T.StructType([T.StructField(f.name, T.StringType()) for f in contract.struct.fields]
                                + [T.StructField(corrupt_col, T.StringType())]))
           .csv(path))
    typed = raw.select(*[
        F.when(F.col(f.name).isin(list(null_if)), F.lit(None)).otherwise(F.col(f.name)).try_cast(f.dataType)
        .alias(f.name) for f in contract.struct.fields], corrupt_col,
        *[F.col(f.name).alias(f"_raw_{f.name}") for f in contract.struct.fields])
    bad_cast = F.lit(False)
    for f in contract.struct.fields:
        raw_v = F.col(f"_raw_{f.name}")
        bad_cast = bad_cast | (raw_v.isNotNull() & ~raw_v.isin(list(null_if)) & F.col(f.name).isNull())
    bad = F.col(corrupt_col).isNotNull() | bad_cast
    loaded = typed.filter(~bad).select(*contract.names)
    rejected = typed.filter(bad).select(F.coalesce(F.col(corrupt_col), F.concat_ws(
        ",", *[F.coalesce(F.col(f"_raw_{n}"), F.lit("")) for n in contract.names])).alias("raw_record"))
    return loaded, rejected


def lake_write(df: DataFrame, base: str, table: str, run_ts: str) -> tuple[str | None, int]:
    """Parquet + snappy, one folder per table and run; returns (path, rows).

    The row count comes from ``Observation`` during the write itself (no
    second pass); an empty input leaves no folder behind and returns 0.
    """
    obs = Observation(f"lake_{table}_{uuid.uuid4().hex[:8]}")
    path = f"{base.rstrip('/')}/{table}/run_ts={run_ts}"
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    observed.write.mode("errorifexists").option("compression", "snappy").parquet(path)
    rows = int(obs.get["rows"])
    if rows == 0:
        _delete(df.sparkSession, path)
        return None, 0
    return path, rows


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def load_full(df: DataFrame, path: str) -> None:
    """A4: truncate-and-load = overwrite of the target folder."""
    df.write.mode("overwrite").parquet(path)


def copy_by_name(staged: DataFrame, target_schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Match staged columns to the target by name, case-insensitively;
    values are ``try_cast`` to the target types; a row with a value that does
    not cast goes to the rejected side (ON_ERROR = CONTINUE). Missing target
    columns are NULL, extra staged columns are ignored."""
    by_lower = {c.lower(): c for c in staged.columns}
    cols, bad = [], F.lit(False)
    for f in target_schema.fields:
        src = by_lower.get(f.name.lower())
        if src is None:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        v = F.col(f"`{src}`")
        casted = v.try_cast(f.dataType)
        bad = bad | (v.isNotNull() & casted.isNull())
        cols.append(casted.alias(f.name))
    t = staged.select(*cols, bad.alias("_bad"))
    return t.filter(~F.col("_bad")).drop("_bad"), t.filter(F.col("_bad")).drop("_bad")


def chunked_append(df: DataFrame, write_chunk: Callable[[pd.DataFrame, str], None], chunk_rows: int = 1000
                   ) -> DataFrame:
    """Append in chunks from every partition; a failed chunk is reported
    and the others continue.  Returns one status row per chunk
    (chunk_id, rows, status, error); nothing goes through the driver.

    ``write_chunk(pdf, chunk_id)`` runs on the executors.  Chunk ids are
    ``<partition>-<chunk>``: a task retried after an executor loss produces
    the same ids, so a writer keyed by them (file name, upsert key) rewrites
    instead of appending twice.
    """
    out_schema = "chunk_id string, rows long, status string, error string"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        status = []

        def flush(part: pd.DataFrame, k: int):
            cid = f"{pid:05d}-{k:06d}"
            try:
                write_chunk(part, cid)
                status.append((cid, len(part), "ok", None))
            except Exception as e:  # keep going with the next chunk
                status.append((cid, len(part), "failed", str(e)))

        buf: list[pd.DataFrame] = []
        n = k = 0
        for pdf in it:
            buf.append(pdf)
            n += len(pdf)
            while n >= chunk_rows:
                allrows = pd.concat(buf, ignore_index=True)
                flush(allrows.iloc[:chunk_rows], k)
                k += 1
                rest = allrows.iloc[chunk_rows:]
                buf, n = [rest], len(rest)
        if n:
            flush(pd.concat(buf, ignore_index=True), k)
        yield pd.DataFrame(status, columns=["chunk_id", "rows", "status", "error"])

    return df.mapInPandas(run, out_schema)


def append_chunks(df: DataFrame, path: str, append_id: str, order: Sequence[str], violations: dict[str, Column],
                  chunk_rows: int = 1000) -> DataFrame:
    """A15 into a Parquet table: append in chunks of ``chunk_rows`` rows by ``order``.

    A chunk with a row that breaks one of ``violations`` (message -> condition) fails as a
    whole, as one insert would; the others go on. Rows are numbered over ranges of the
    order, staged once, and written under ``append_id``: good chunks to ``rows``, failed
    ones with their message to ``rejected``, and at last one row per chunk to
    ``manifest``. Readers (``appended``) take only what a manifest names, and an append that
    is run again replaces its own folders. Returns the chunk rows (chunk, rows, status, error).
    """
    spark = df.sparkSession
    numbered = running_totals(df.withColumn("_one", F.lit(1)), [], order, "_one")
    staged = written_table(numbered.select(*df.columns, F.floor((F.col("run_n") - 1) / chunk_rows).alias("chunk"),
                                           F.coalesce(*[F.when(c, F.lit(m)) for m, c in violations.items()]).alias("error")), "append")
    chunks = written_table(staged.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.min("error").alias("error")).select(
        "chunk", "rows", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error"), "chunks")
    rows = staged.drop("error").join(chunks.select("chunk", "error"), "chunk")
    parts = {"rows": rows.filter(F.col("error").isNull()).drop("error"), "rejected": rows.filter(F.col("error").isNotNull()), "manifest": chunks}
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/append_id={append_id}")
    return spark.read.parquet(f"{path.rstrip('/')}/manifest/append_id={append_id}")


def appended(spark: SparkSession, path: str, what: str = "rows") -> DataFrame:
    """Rows (or ``rejected`` rows) of the finished appends to the table at ``path``."""
    done = spark.read.parquet(f"{path.rstrip('/')}/manifest").select("append_id").distinct()
    return spark.read.parquet(f"{path.rstrip('/')}/{what}").join(done, "append_id", "left_semi")


def load_partition(df: DataFrame, path: str, partition_col: str) -> None:
    """Overwrite only the partitions present in ``df`` (dynamic
    partition overwrite); other partitions of the table stay as they are. Rows are
    rebalanced by partition, so that a small one is one file and a large one several."""
    (df.hint("rebalance", partition_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))
