"""Operator 11: Merkle manifest of a dataset, with a proof for every row.

Rows become leaves, each source a tree of runs of ``ARITY`` nodes, the sources' roots a
tree over them. A task never holds more than an aligned block of ``BLOCK`` nodes: the
block keeps each of its levels as one string of concatenated hex digests, in which a
parent's input is a substring of fixed width and a proof's siblings are the substrings
on both sides of a node. The roots of the blocks are the nodes of the next round, which
is made the same way, until every tree is one block; proofs are then put together on
the way down. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch

#: Nodes that share a parent.
ARITY = 16
#: Levels inside a block, and its nodes.
LEVELS = 2
BLOCK = ARITY**LEVELS
#: Hex characters of a digest.
WIDTH = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_PATH = "cast(array() as array<struct<l:string,r:string>>)"


def field(c: Column) -> Column:
    """A value inside a leaf's input: ``-`` for null, else byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> Column:
    """Digest of a row."""
    return F.sha2(F.concat(field(F.col(doc_id)), field(F.col(source)), field(F.col(lang)), field(F.col(n_chars)), field(text)), 256)


def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0, gapless in ``group`` by ``order``) and ``total`` (rows of the group).

    The rows are dealt out by ranges of (group, order, row), so that neither a hot group
    nor equal rows meet in one task; numbers inside a range and the totals of the ranges
    before it add up to the position. ``group`` must be free of nulls.
    """
    keys = [*group, *[F.col(c).asc_nulls_first() for c in order], "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = scratch(dealt.drop("_tie").withColumn("_part", F.spark_partition_id())
                    .withColumn("_row", F.monotonically_increasing_id()), "ordered")
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .select(*group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                      F.sum("_n").over(whole).alias("total")))
    return (dealt.join(starts, [*group, "_part"]).withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first"))
            .drop("_part", "_row", "_first", "_n", "_before"))


def _parents(level: str) -> Column:
    """The next level of a block's level: a digest of every run's substring, as one string."""
    return F.expr(f"""cast(array_join(transform(sequence(0, (octet_length({level}) - 1) div {ARITY * WIDTH}),
        i -> sha2(substring({level}, cast(i * {ARITY * WIDTH} + 1 as int), {ARITY * WIDTH}), 256)), '') as binary)""")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, pos, total, digest, data) to blocks: g, block, total, items, levels l0.. (null above the root), digest."""
    found = (nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "data"))).alias("items"), F.max("total").alias("total"))
             .withColumn("l0", F.expr("cast(array_join(transform(items, x -> x.digest), '') as binary)")))
    for i in range(LEVELS):
        # A tree of several blocks goes up whole levels; in a single block, the root ends it.
        found = found.withColumn(f"l{i + 1}", F.when((F.col("total") > BLOCK) | (F.octet_length(f"l{i}") > WIDTH), _parents(f"l{i}")))
    return found.withColumn("digest", F.coalesce(*[F.col(f"l{i}") for i in range(LEVELS, -1, -1)]).cast("string"))


def _siblings(level: int) -> str:
    """The substrings before and after node i of a level inside its run; null on the root's level."""
    n, width = f"(i div {ARITY**level})", ARITY * WIDTH
    run = f"({n} div {ARITY})"
    return f"""if(l{level + 1} is null, null, named_struct(
        'l', cast(substring(l{level}, cast({run} * {width} + 1 as int), cast(({n} - {run} * {ARITY}) * {WIDTH} as int)) as string),
        'r', cast(substring(l{level}, cast(({n} + 1) * {WIDTH} + 1 as int),
                            cast((({run} + 1) * {ARITY} - {n} - 1) * {WIDTH} as int)) as string)))"""


def proofs(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Trees over (g, pos, total, digest, data): for every node its path to the top.

    ``above`` takes (g, digest) of the trees' roots and returns g, path, and whatever
    else every node shall carry. Returns g, digest, data, those, and path: per level, the
    joined digests left (l) and right (r) of the node in its run.
    """
    rounds = []
    while True:
        blocks = scratch(_blocks(nodes), "blocks")
        rounds.append(blocks)
        if (blocks.agg(F.max("total")).first()[0] or 0) <= BLOCK:
            break
        nodes = blocks.select("g", F.col("block").alias("pos"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"),
                              "digest", F.lit(0).alias("data"))
    found = above(rounds[-1].select("g", "digest")).withColumn("pos", F.lit(0).cast("long"))
    carried = [c for c in found.columns if c not in ("g", "pos")]
    own = ", ".join(_siblings(i) for i in range(LEVELS))
    for blocks in reversed(rounds):
        found = (blocks.drop("digest").join(found.select("g", F.col("pos").alias("block"), *carried), ["g", "block"])
                 .select("g", *carried, F.expr(f"""inline(transform(items, (x, i) -> named_struct(
                     'pos', x.pos, 'digest', x.digest, 'data', x.data, 'own', filter(array({own}), s -> s is not null))))"""))
                 .withColumn("path", F.concat("own", "path")).select("g", "pos", "digest", "data", *carried))
    return found.drop("pos")


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(F.col(path), start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaf, source root, root and proof of every row, and the root that a tampered row gives.

    ``tampered`` is a condition on the columns of ``docs``: there, A-Z of the text are
    lower-cased before the row is checked against its proof. Returns doc_id, leaf,
    subroot, root, path (array of l, r), proof_sha256, folded_root, verified.

    Leaves ascend by doc_id within a source; null ids come first, equal ids follow their
    leaves, equal rows stay each a leaf of its own. Null values count as ``-``, a null
    source is a source of its own, before the others. An undecided (null) ``tampered``
    is no tampering. An empty table gives no rows. Texts of any length are hashed whole;
    other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        # '0' and '1' put the null source first and keep the bytewise order of the others.
        F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("g"), "doc_id",
        leaf(text).alias("digest"),
        F.when(tampered, leaf(F.translate(text, UPPER, LOWER))).alias("other"))
    rows = positions(scratch(rows, "leaves"), ["g"], ["doc_id", "digest"])
    nodes = rows.select("g", "pos", "total", "digest", F.struct("doc_id", "other").alias("data"))

    def over_sources(roots: DataFrame) -> DataFrame:
        sources = positions(roots.select(F.lit("").alias("one"), "g", "digest"), ["one"], ["g"])
        tree = proofs(sources.select(F.col("one").alias("g"), "pos", "total", "digest", F.col("g").alias("data")),
                      lambda top: top.select("g", F.expr(NO_PATH).alias("path"), F.col("digest").alias("root")))
        return scratch(tree.select(F.col("data").alias("g"), F.col("digest").alias("subroot"), "root", "path"), "sources")

    found = proofs(nodes, over_sources).select(F.col("data.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "path",
                                               F.coalesce("data.other", "digest").alias("_start"))
    found = found.select("doc_id", "leaf", "subroot", "root", "path",
                         F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256).alias("proof_sha256"),
                         folded(F.col("_start")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def one_in_five() -> Column:
    """Rows whose decimal doc_id has a checksum that 5 divides."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _oracle(leaf_levels: int = 6, source_levels: int = 4) -> str:
    """DuckDB SQL of the query: level by level, with windows for siblings (up to 16**6 rows in a source)."""

    def f(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def digest(text: str) -> str:
        return f"sha256({f('doc_id')} || {f('source')} || {f('lang')} || {f('n_chars')} || {f(text)})"

    def level(name: str, before: str, group: str) -> str:
        part = f"PARTITION BY {group}, pos // {ARITY} ORDER BY pos ROWS BETWEEN"
        return f"""{name} AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS n,
          coalesce(string_agg(h, '') OVER ({part} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
          coalesce(string_agg(h, '') OVER ({part} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {before})"""

    def up(name: str, before: str, group: str) -> str:
        return f"""{name} AS (SELECT {group}, pos // {ARITY} AS pos, CASE WHEN max(n) = 1 THEN max(h)
          ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {before} GROUP BY {group}, pos // {ARITY})"""

    parts = [f"""d AS (SELECT *, coalesce('1' || source, '0') AS g, {digest('text')} AS leaf,
        {digest("translate(text, '" + UPPER + "', '" + LOWER + "')")} AS other,
        xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
          lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
            lambda z, k: xor(z >> 1, 3988292384 * (z & 1)), xor(c, b)), 4294967295), 4294967295) AS crc FROM documents)""",
             "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
             "a0 AS (SELECT g, pos, leaf AS h FROM p)"]
    for i in range(leaf_levels):
        parts += [level(f"b{i}", f"a{i}", "g"), up(f"a{i + 1}", f"b{i}", "g")]
    parts.append(f"s0 AS (SELECT 1 AS one, g, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM a{leaf_levels})")
    for i in range(source_levels):
        parts += [level(f"t{i}", f"s{i}", "one"), up(f"s{i + 1}", f"t{i}", "one")]
    steps = [(f"b{i}", f"b{i}.g = p.g AND b{i}.pos = p.pos // {ARITY**i}") for i in range(leaf_levels)]
    steps += [(f"t{i}", f"t{i}.pos = s0.pos // {ARITY**i}") for i in range(source_levels)]
    fold, proof = "CASE WHEN crc % 5 = 0 THEN other ELSE leaf END", []
    folds = []
    for k, (t, _) in enumerate(steps):
        folds.append(f"f{k} AS (SELECT *, CASE WHEN n{k} = 1 THEN {fold} ELSE sha256(l{k} || {fold} || r{k}) END AS h{k} "
                     f"FROM {'j' if not k else f'f{k - 1}'})")
        fold = f"h{k}"
        proof.append(f"l{k} || r{k}")
    picked = ", ".join(f"{t}.n AS n{k}, {t}.l AS l{k}, {t}.r AS r{k}" for k, (t, _) in enumerate(steps))
    joins = " ".join(f"JOIN {t} ON {on}" for t, on in steps)
    parts.append(f"j AS (SELECT p.doc_id, p.leaf, p.other, p.crc, s0.h AS subroot, top.h AS root, {picked} FROM p "
                 f"JOIN s0 ON s0.g = p.g JOIN s{source_levels} top ON true {joins})")
    return f"""WITH {', '.join(parts + folds)}
      SELECT doc_id, leaf, subroot, root, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS folded_root,
        {fold} = root AS verified FROM f{len(steps) - 1}"""


ORACLE = _oracle()
