"""Document chunking, exact nearest-neighbour retrieval and conversation jobs
(R1-R7).

Retrieval is exact: blocks of queries meet blocks of vectors in tasks of their
own, each task keeps its top-k per query, and a final window picks the global
top-k from those few rows.  No pair table is materialised, no vector dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHUNK_OVERLAP, CHUNK_SIZE, chunk_spans

BATCH_BYTES = 4 << 20           # of texts that reach a task at once
OUT_CHARS = 4 << 20             # of chunks that leave it at once
MAX_DISTANCE = 10.0            # results at or beyond this distance are dropped


# ------------------------------------------------------------------ R1 / R2

def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    text_col: str = "text", id_col: str = "doc_id",
                    meta: Sequence[str] = ("source", "lang")) -> DataFrame:
    """One row per chunk (doc_id, chunk_no, chunk_start, chunk_end, chunk_text, chunk_chars, meta...).

    Documents stay where Spark put them; each task splits its own documents
    (whole texts), so the work spreads with the number of partitions. What a task holds
    is bounded by bytes: batches going in by the setting, chunks going out here.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    meta = [m for m in meta if m in docs.columns]
    schema = (f"{id_col} long, chunk_no int, chunk_start int, chunk_end int, chunk_text string, chunk_chars int"
              + "".join(f", {m} string" for m in meta))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [id_col, "chunk_no", "chunk_start", "chunk_end", "chunk_text", "chunk_chars", *meta]
        for pdf in it:
            rows, held = [], 0
            for key, text, *more in pdf.itertuples(index=False, name=None):
                text = text or ""
                for i, (a, b) in enumerate(chunk_spans(text, size, overlap)):
                    rows.append((key, i, a, b, text[a:b], b - a, *more))
                    held += b - a
                    if held >= OUT_CHARS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(id_col, text_col, *meta).mapInPandas(run, schema)


def index_rebuild(chunks: DataFrame, path: str) -> int:
    """R2: drop and reload the chunk index; returns its row count."""
    chunks.write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.parquet(path).count()


def index_append(chunks: DataFrame, path: str) -> int:
    """R2: add chunks that the index lacks (by document and chunk number), so a
    repeated append adds nothing; returns the new total."""
    spark = chunks.sparkSession
    held = spark.read.parquet(path).select("doc_id", "chunk_no")
    chunks.join(held, ["doc_id", "chunk_no"], "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def chunk_coverage(chunks: DataFrame) -> DataFrame:
    """Per document: longest chunk, largest overlap of neighbours, and the
    characters other than blanks that the chunks hold, overlaps once."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    before = F.coalesce(F.lag("chunk_end").over(w), F.lit(0))
    shared = F.greatest(before - F.col("chunk_start"), F.lit(0))
    new = F.expr("substring(chunk_text, shared + 1)")
    return (chunks.withColumn("shared", shared)
            .withColumn("new_chars", F.length(F.regexp_replace(new, r"[\x20\x09-\x0D]+", "")))
            .groupBy("doc_id").agg(F.sum("new_chars").alias("covered_chars"),
                                   (F.max("chunk_chars") <= CHUNK_SIZE).alias("sizes_hold"),
                                   (F.max("shared") <= CHUNK_OVERLAP).alias("overlaps_hold")))


# ------------------------------------------------------------------ R3 / R4

QUERY_BLOCK = 1_024            # queries and vectors that one task compares;
VECTOR_BLOCK = 16_384          # they bound memory, not the input


def _in_blocks(df: DataFrame, key: str, block_rows: int, name: str) -> tuple[DataFrame, int]:
    """Deal rows to as many blocks as keep a block near ``block_rows`` rows."""
    blocks = max(1, -(-df.count() // block_rows))
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), blocks


def topk_similar(queries: DataFrame, vectors: DataFrame, k: int = 4, max_distance: float = MAX_DISTANCE,
                 query_id: str = "query_id", query_vec: str = "query_vec", vec_id: str = "vec_id",
                 vec: str = "embedding", query_filter: str | None = None, vector_filter: str | None = None
                 ) -> DataFrame:
    """Exact k nearest vectors per query by squared L2 distance.

    ``similarity = max(0, 2 - distance)``; results with distance >= 10 are
    dropped.  With ``query_filter``/``vector_filter`` (R4) a vector is a
    candidate of a query only when the two filter values are equal, applied
    before ranking.  Ties are broken by the smaller vector id.

    Queries and vectors are dealt to blocks; each pair of blocks meets in one
    task, which returns its own top k per query.  Any number of queries works.
    """
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("qv"),
                       (F.col(query_filter) if query_filter else F.lit(None).cast("int")).alias("qf"))
    v = vectors.select(F.col(vec_id).alias("vid"), F.col(vec).alias("vv"),
                       (F.col(vector_filter) if vector_filter else F.lit(None).cast("int")).alias("vf"))
    q, q_blocks = _in_blocks(q, "qid", QUERY_BLOCK, "qb")
    v, v_blocks = _in_blocks(v, "vid", VECTOR_BLOCK, "vb")
    q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    filtered = query_filter is not None

    def block_topk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("vid")  # a stable sort by distance then breaks ties by id
            vm = np.vstack([np.asarray(x, dtype=np.float64) for x in b["vv"]])
            ids, kinds = b["vid"].to_numpy(), b["vf"].to_numpy()
            for qid, qv, qf in zip(a["qid"], a["qv"], a["qf"]):
                diff = vm - np.asarray(qv, dtype=np.float64)
                d = np.einsum("vd,vd->v", diff, diff)
                ok = d < max_distance
                if filtered:
                    ok &= kinds == qf
                at = np.flatnonzero(ok)
                at = at[np.argsort(d[at], kind="stable")[:k]]
                out.append(pd.DataFrame({"qid": qid, "vid": ids[at], "distance": d[at]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "vid": [], "distance": []})

    qtype = queries.schema[query_id].dataType.simpleString()
    vtype = vectors.schema[vec_id].dataType.simpleString()
    partial = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(
        block_topk, f"qid {qtype}, vid {vtype}, distance double")
    w = Window.partitionBy("qid").orderBy("distance", "vid")
    top = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(F.col("qid").alias(query_id), "rank", F.col("vid").alias(vec_id),
                      F.round("distance", 6).alias("distance"),
                      F.round(F.greatest(F.lit(0.0), 2 - F.col("distance")), 6).alias("similarity"))


# ------------------------------------------------------------------ R5 / R6 / R7

# Fixed value: the context of a query that found nothing.
NO_HITS = "No relevant documents found."


def context_format(ranked: DataFrame, query_id: str = "query_id", queries: DataFrame | None = None) -> DataFrame:
    """Per query, '[Document i - source (relevance: x.xx)]\\ncontent\\n'
    blocks joined by newlines in rank order (at most k rows per query).  With
    ``queries``, every query has a row; those without hits say so."""
    block = F.format_string("[Document %d - %s (relevance: %.2f)]\n%s\n", F.col("rank"),
                            F.coalesce(F.col("source"), F.lit("unknown")), F.col("similarity"),
                            F.coalesce(F.col("content"), F.lit("")))
    g = ranked.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    found = g.select(query_id, F.array_join(F.transform("bs", lambda x: x["b"]), "\n").alias("context"))
    if queries is None:
        return found
    return queries.select(query_id).join(found, query_id, "left").select(
        query_id, F.coalesce("context", F.lit(NO_HITS)).alias("context"))


# Fixed keyword lists of the rule-based router.
DOC_KEYWORDS = ("documentation", "document", "docs", "resume", "applicant", "candidate",
                "according to", "pdf", "guide", "manual", "readme")
DATA_KEYWORDS = ("show me", "query", "count", "how many", "list", "display", "get")
JOIN_WORDS = ("then", "also", "and")


def _any_in(text: F.Column, words: Sequence[str]) -> F.Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def route_query(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """Document words -> 'document'; also data words and a connector word
    -> 'hybrid'; otherwise 'model' (left to the model).  Plain substring
    tests on the lower-cased text, as the original ('and' matches inside words)."""
    t = F.lower(F.col(text_col))
    doc = _any_in(t, DOC_KEYWORDS)
    hybrid = doc & _any_in(t, DATA_KEYWORDS) & _any_in(t, JOIN_WORDS)
    return turns.withColumn("route", F.when(hybrid, "hybrid").when(doc, "document").otherwise("model"))


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int, salt_buckets: int = 64,
                    salt_col: str | None = None) -> DataFrame:
    """Exact top-``k`` rows per group in two rounds: first within
    (group, salt) slices, then over the at most ``k * salt_buckets`` survivors
    per group, so a group holding a third of all rows is never one task."""
    salt = F.abs(F.hash(*[F.col(c) for c in ([salt_col] if salt_col else df.columns)])) % salt_buckets
    d = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    d = d.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return d.withColumn("_rank", F.row_number().over(w2)).filter(F.col("_rank") <= k).drop("_salt", "_r1")


TURN_SPAN = 1_024               # turns that one window holds


def recent_exchanges(turns: DataFrame, keep: int = 10, show: int = 3) -> DataFrame:
    """Pair each user turn with the next turn if that is the assistant's,
    keep the last ``keep`` exchanges per conversation and render the last
    ``show`` as 'User: ...' / 'Assistant: ...' lines, oldest first.

    Turn numbers may have gaps.  The next turn is found inside spans of turns,
    and for a span's last turn in the first turn of the span after it, so a
    long conversation is no single task.
    """
    t = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / TURN_SPAN).alias("span"))
    one = F.struct("turn", "role", "text")
    inside = Window.partitionBy("conv_id", "span").orderBy("turn")
    firsts = t.groupBy("conv_id", "span").agg(F.min(one).alias("first"))
    later = firsts.select("conv_id", "span", F.lead("first").over(
        Window.partitionBy("conv_id").orderBy("span")).alias("later"))
    ex = (t.withColumn("next", F.lead(one).over(inside)).join(later, ["conv_id", "span"])
          .withColumn("next", F.coalesce("next", "later"))
          .filter("role = 'user' AND next.role = 'assistant'")
          .select("conv_id", "turn", "role", "text", F.col("next.text").alias("next_text")))
    ex = top_k_per_group(ex, ["conv_id"], [F.desc("turn")], keep, salt_col="turn").withColumnRenamed("_rank", "k")
    pair = F.concat(F.lit("User: "), F.col("text"), F.lit("\nAssistant: "), F.col("next_text"))
    g = ex.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("exchanges_kept"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= show, F.struct("turn", pair.alias("p"))))).alias("ps"))
    return g.select("conv_id", "exchanges_kept",
                    F.array_join(F.transform("ps", lambda x: x["p"]), "\n").alias("context"))


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label (element-wise), as the query set of a topic search."""
    e = vectors.select(label, F.posexplode(vec).alias("i", "x"))
    m = e.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs")).select(
        F.col(label).alias("query_id"), F.transform("xs", lambda s: s["x"]).alias("query_vec"))
