"""Registered queries: documents, retrieval, conversations (R1-R7) and
pipeline / stream metrics (L1-L7)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import runmetrics as L
from ..session import checkpoint_dir
from ..sources.changes import run_log_from_orders
from ..sources.tables import read_table
from .catalog import register
from .models import Warehouse
from .oracle import enc


@register("R1_chunk_documents", None)
def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents split into <= 1000-character chunks with 200 overlap."""
    return R.chunk_documents(read_table(spark, sf_dir, "documents"))


COVERAGE_SQL = r"""SELECT doc_id, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT)
    AS covered_chars, true AS sizes_hold, true AS overlaps_hold FROM documents
  WHERE regexp_matches(text, '[^\x20\x09-\x0D]')"""


@register("R1_chunk_coverage", COVERAGE_SQL)
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every document hold all its text, within the limits."""
    return R.chunk_coverage(R.chunk_documents(read_table(spark, sf_dir, "documents")))


@register("R2_index_coverage", COVERAGE_SQL)
def q_index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As R1_chunk_coverage, over an index whose append ran twice."""
    docs = read_table(spark, sf_dir, "documents")
    path = f"{checkpoint_dir(spark).rstrip('/')}/agora/index/{uuid.uuid4().hex}"
    R.index_rebuild(R.chunk_documents(docs.filter(F.col("lang") == "en")), path)
    for _ in range(2):
        R.index_append(R.chunk_documents(docs.filter(F.col("lang") != "en")), path)
    return R.chunk_coverage(spark.read.parquet(path))


@register("R2_index_rebuild_append", None)
def q_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rebuilt from English documents, then the others appended; read back."""
    docs = read_table(spark, sf_dir, "documents")
    path = f"{checkpoint_dir(spark).rstrip('/')}/agora/index/{uuid.uuid4().hex}"
    R.index_rebuild(R.chunk_documents(docs.filter(F.col("lang") == "en")), path)
    R.index_append(R.chunk_documents(docs.filter(F.col("lang") != "en")), path)
    return spark.read.parquet(path)


CENTROIDS_SQL = """e AS (SELECT vec_id, label, embedding FROM embeddings),
  ex AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM e),
  c AS (SELECT label AS query_id, i, avg(CAST(x AS DOUBLE)) AS q FROM ex GROUP BY 1, 2)"""


def _topk_sql(filtered: bool) -> str:
    filt = "AND ex.label = c.query_id" if filtered else ""
    return f"""WITH {CENTROIDS_SQL},
  d AS (SELECT c.query_id, ex.vec_id, sum((CAST(ex.x AS DOUBLE) - c.q) * (CAST(ex.x AS DOUBLE) - c.q)) AS distance
        FROM c JOIN ex ON c.i = ex.i {filt} GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
        FROM d WHERE distance < 10)
  SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(distance, 6) AS distance,
    round(greatest(0.0, 2 - distance), 6) AS similarity FROM r WHERE rank <= 4"""


@register("R3_topk_similar", _topk_sql(False))
def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 nearest vectors to each label centroid (exact, squared L2)."""
    v = read_table(spark, sf_dir, "embeddings")
    return R.topk_similar(R.label_centroids(v), v, k=4)


@register("R4_filtered_topk", _topk_sql(True))
def q_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same search restricted by metadata: only vectors of the centroid's label."""
    v = read_table(spark, sf_dir, "embeddings")
    q = R.label_centroids(v).withColumn("qlabel", F.col("query_id"))
    return R.topk_similar(q, v, k=4, query_filter="qlabel", vector_filter="label")


@register("R5_context_format", f"""WITH r AS ({_topk_sql(False)})
  SELECT r.query_id, string_agg(printf('[Document %d - %s (relevance: %.2f)]\n%s\n', r.rank,
      coalesce(d.source, 'unknown'), r.similarity, coalesce(d.text, '')), '\n' ORDER BY r.rank) AS context
  FROM r LEFT JOIN documents d ON d.doc_id = r.vec_id GROUP BY r.query_id""")
def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context text of each centroid search; vector ids name documents."""
    v = read_table(spark, sf_dir, "embeddings")
    queries = R.label_centroids(v)
    ranked = R.topk_similar(queries, v, k=4)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source",
                                                         F.col("text").alias("content"))
    return R.context_format(ranked.join(docs, "vec_id", "left"), queries=queries)


def _contains_any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@register("R6_route_query", f"""SELECT conv_id, turn, role, text,
    CASE WHEN {_contains_any(R.DOC_KEYWORDS)} AND {_contains_any(R.DATA_KEYWORDS)} AND {_contains_any(R.JOIN_WORDS)}
         THEN 'hybrid' WHEN {_contains_any(R.DOC_KEYWORDS)} THEN 'document' ELSE 'model' END AS route
    FROM conversations WHERE role = 'user'""")
def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return R.route_query(c)


@register("R7_recent_exchanges", """WITH t AS (SELECT conv_id, turn, role, text,
      lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
      lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations),
  ex AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k
         FROM t WHERE role = 'user' AND next_role = 'assistant')
  SELECT conv_id, count(*) AS exchanges_kept,
    coalesce(string_agg(CASE WHEN k <= 3 THEN 'User: ' || text || '\nAssistant: ' || next_text END, '\n'
                        ORDER BY turn), '') AS context
  FROM ex WHERE k <= 10 GROUP BY conv_id""")
def q_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent_exchanges(read_table(spark, sf_dir, "conversations"))


# ---------------------------------------------------------------- L

RUNLOG_SQL = """WITH s AS (SELECT *, CASE WHEN order_delivered_customer_date IS NOT NULL THEN
      CAST(date_diff('day', CAST(order_purchase_timestamp AS DATE), CAST(order_delivered_customer_date AS DATE)) AS INT)
    END AS delivery_days FROM raw_orders),
  log AS (SELECT 'load_' || order_status || '_' || CAST(year(order_purchase_timestamp) AS VARCHAR) AS operation,
      count(*) AS records, round(coalesce(sum(delivery_days), 0) / 1000.0, 3) AS duration_seconds,
      CASE WHEN order_status = 'processing' THEN 'failed' ELSE 'ok' END AS status
    FROM s GROUP BY order_status, year(order_purchase_timestamp))"""


def _log_sql(body: str) -> str:
    from .oracle import with_ctes
    return with_ctes(f"SELECT * FROM ({RUNLOG_SQL} {body})")


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log_from_orders(Warehouse(spark, sf_dir).stg_orders)


@register("L1_op_throughput", _log_sql("""SELECT *, CASE WHEN duration_seconds > 0
    THEN round(records / duration_seconds, 2) ELSE 0.0 END AS records_per_second FROM log"""))
def q_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.op_throughput(_run_log(spark, sf_dir))


@register("L2_pipeline_summary", _log_sql("""SELECT count(*) AS operations, sum(records) AS total_records,
    round(sum(duration_seconds), 6) AS total_duration_seconds,
    arg_min(operation, (duration_seconds, operation)) AS fastest_operation,
    arg_max(operation, (duration_seconds, operation)) AS slowest_operation,
    CASE WHEN round(sum(duration_seconds), 6) > 0 THEN round(sum(records) / round(sum(duration_seconds), 6), 2)
         ELSE 0.0 END AS overall_records_per_second FROM log"""))
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pipeline_summary(_run_log(spark, sf_dir))


@register("L3_batch_success_rate", _log_sql("""SELECT count(*) FILTER (WHERE status = 'ok') AS succeeded,
    count(*) FILTER (WHERE status = 'failed') AS failed,
    CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE status = 'ok') * 100.0 / count(*), 2)
         ELSE 100.0 END AS success_rate FROM log"""))
def q_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.batch_success_rate(_run_log(spark, sf_dir))


@register("L4_stream_throughput_60s", f"""SELECT event_id, {enc('t:ts')}, events_in_window,
    round(events_in_window / 60.0, 6) AS events_per_second FROM (
    SELECT event_id, ts, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)
      AS events_in_window FROM events)""")
def q_stream_tp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stream_throughput(read_table(spark, sf_dir, "events"))


@register("L5_stream_latency_avg", f"""SELECT event_id, {enc('t:ts')}, CAST(g_rank AS BIGINT) AS g_rank,
    round(avg_latency_ms, 6) AS avg_latency_ms FROM (
    SELECT event_id, ts, row_number() OVER w AS g_rank,
      avg(CAST(json_extract(props, '$.k') AS DOUBLE)) OVER (w ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)
        AS avg_latency_ms FROM events WINDOW w AS (ORDER BY epoch_us(ts), event_id))""")
def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of an event = the ``k`` value of its props (ms)."""
    e = read_table(spark, sf_dir, "events").withColumn(
        "latency_ms", F.get_json_object("props", "$.k").cast("double"))
    return L.stream_latency_avg(e)


@register("L6_stream_error_rate", """SELECT count(*) FILTER (WHERE event_type = 'error') AS failed,
    count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
    CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*), 2)
         ELSE 0.0 END AS error_rate FROM events""")
def q_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stream_error_rate(read_table(spark, sf_dir, "events"), F.col("event_type") == "error")


@register("L6_error_type_counts", """SELECT 'E' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) // 20 AS VARCHAR)
    AS error_type, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1""")
def q_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    et = F.concat(F.lit("E"), F.floor(F.get_json_object("props", "$.k").cast("long") / 20).cast("string"))
    return L.error_type_counts(e, F.col("event_type") == "error", et)


def _backlog_sql(as_written: bool) -> str:
    level = ("CASE WHEN pct > 80 THEN 'warning' WHEN pct > 95 THEN 'critical' ELSE 'ok' END" if as_written else
             "CASE WHEN pct > 95 THEN 'critical' WHEN pct > 80 THEN 'warning' ELSE 'ok' END")
    return f"""SELECT {enc('t:minute')}, events, pct AS backlog_pct, {level} AS level FROM (
      SELECT minute, events, round(events * 100.0 / max(events) OVER (), 6) AS pct FROM (
        SELECT date_trunc('minute', ts) AS minute, count(*) AS events FROM events GROUP BY 1))"""


@register("L7_backlog_level", _backlog_sql(False))
def q_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.backlog_by_minute(read_table(spark, sf_dir, "events"))


@register("L7_backlog_level_as_written", _backlog_sql(True))
def q_backlog_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.backlog_by_minute(read_table(spark, sf_dir, "events"), as_written=True)
