"""Operator 9: mix sources to target weights by systematic sampling.

Native: DataFrame functions only. Every document of a source expects
``target / source_size`` copies. Documents of a source are ordered by size; the
prefix sum of expected copies plus one random offset per source is walked, and a
document is emitted once for each integer boundary inside its own step. Ordering by
size spreads the emitted copies evenly over sizes, so taken words come near the
target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.plans.strategy import bounded_broadcast

from .shared import WORDS, prefix_offsets, scratch

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source, and a document, is used at most so many times its size.
MOST = 3
#: Documents of equal size in a source are counted in slices by so many hex digits of their id's md5 (2: 256 slices).
DIGITS = 2


def source_targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """Targets per source from (sk, source, source_size): water-filling by weight.

    Sources are numbered by code point, null last, and weigh 1, 2, 3, repeating.
    Shares above ``MOST`` times the source's size stop there and the excess goes to
    the others by weight, until none is above. One row per source, so the windows
    over all sources see a row per source and no documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    rows = sizes.withColumn("w", weigh.cast("double")).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = (rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("used", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("rest", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", (F.col("total") - F.col("used")) / F.col("rest"))
            .withColumn("full", F.col("cap") <= F.col("w") * F.col("level")))
    # The level that holds is that of the first source that is not full.
    held = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("k"), F.col("level").alias("v"))))
    rows = rows.withColumn("at", held.over(everything))
    return rows.select("sk", "source", "source_size", F.when(
        F.col("at").isNull() | F.col("full"), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("w") * F.col("at.v"))).alias("target"))


def mix_sources(docs: DataFrame, share: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """Copies of each document in a mix of sources by weight.

    Size is the number of words (null or empty text: 0; such documents expect copies
    like the others and take no words). Returns every input row: doc_id, source,
    size, source_size, target, copies, taken (= copies * size). The offset of a
    source depends on ``seed`` and its name, so reruns agree. A source of size 0 has
    target 0 and no copies. Null ``source`` is a source of its own, last in order;
    repeated rows are rows of their own; an empty table gives no rows.
    """
    return _copies(_sized(docs, []), share, seed)


def mixed_documents(docs: DataFrame, share: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    names = docs.columns
    clash = {c: f"_doc_{i}" for i, c in enumerate(names)}
    kept = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.struct(
        *[F.col(f"`{c}`").alias(clash[c]) for c in names]).alias("_row"))
    rows = _copies(_sized(kept, ["_row"]), share, seed).where("copies > 0")
    return (rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(*[F.col(f"_row.{clash[c]}").alias(c) for c in names]))


def _sized(docs: DataFrame, more: list[str]) -> DataFrame:
    return scratch(docs.select(
        "doc_id", "source", *more, F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        # Keys of joins and windows have no nulls: s + the name, or n.
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("sk"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, DIGITS).alias("part"), F.lit(1).cast("long").alias("one")), "sized")


def _copies(sized: DataFrame, share: float, seed: str) -> DataFrame:
    sizes = sized.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, share).select("sk", "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("sk"))), 1, 8), 16, 10).cast("double") / 2.0**32
    # A row per source: sent to all tasks where they are few, as a hot source would gather all its slices in a join by source.
    rates = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                               .otherwise(0.0)).withColumn("u", offset)
    starts = prefix_offsets(sized, ["sk"], [["size"], ["part"]], "one").join(bounded_broadcast(rates), "sk")
    inside = Window.partitionBy("sk", "size", "part").orderBy(F.col("doc_id").asc_nulls_first())
    rank = F.col("offset") + F.row_number().over(inside) - 1
    step = lambda k: F.floor(F.col("rate") * k + F.col("u"))
    rows = (sized.join(starts, ["sk", "size", "part"]).withColumn("k", rank)
            .withColumn("copies", (step(F.col("k") + 1) - step(F.col("k"))).cast("long")))
    more = [c for c in sized.columns if c not in ("doc_id", "source", "size", "sk", "part", "one")]
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).alias("taken"), *more)


#: The same mix in DuckDB: order by size, slice and id, offsets from md5, targets by the level that fills 100%.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS sk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS part
  FROM documents),
sources AS (
  SELECT sk, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY sk, source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w,
         (3 * source_size)::DOUBLE AS cap FROM sources),
filled AS (
  SELECT *, (SELECT sum(source_size) FROM sources)::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS used,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
levels AS (
  SELECT *, (total - used) / rest AS level FROM filled),
held AS (
  SELECT arg_min(level, cap / w) AS v FROM levels WHERE cap > w * level),
targets AS (
  SELECT sk, source_size, CASE WHEN held.v IS NULL OR cap <= w * level THEN cap ELSE least(cap, w * held.v) END AS target
  FROM levels, held),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1/' || sk), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, rate, u,
         row_number() OVER (PARTITION BY sk ORDER BY size, part, doc_id NULLS FIRST) - 1 AS k
  FROM sized JOIN rates USING (sk))
SELECT doc_id, size, source_size, target,
       ((floor(rate * (k + 1) + u) - floor(rate * k + u))::BIGINT * size)::BIGINT AS taken
FROM placed
"""
