"""Operator 8: n-gram Jaccard join by rare-first prefix filtering.

A document is the set of its distinct word n-grams (64-bit hashes). Documents with
equal sets form a class from the start: (sum of the set's hashes, its size) stands for
the set everywhere, so copies cost one row each. Two sets that are similar enough share
an n-gram among the rarest of each (the prefix). Classes that share a prefix n-gram
meet if length, position and suffix filters let them, and each pair of classes is
verified once on the whole sets.

Links are wanted as components, so a prefix group of near copies is not expanded into
pairs: every member meets one leader of its group (a pair per row), the links found join
components, and the leader, who has met all, leaves the group. After some such meetings
only members that are still in different components meet one another. Every pair of
different components that passes the filters is verified; no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, encoded, keyed_chunks, packed, prepare, scratch, texts_of, to_arrow, unpacked, words_of

#: Share of all n-grams from which an n-gram is known as frequent and put last in the order.
FREQUENT = 5e-7
#: The suffix filter: bits of parity and ranges of counts in the join, and finer ranges once per pair.
PARITY, RANGES, FINE = 512, 16, 256
#: Sizes from which a count of a range may not fit 16 bits; such sets skip the coarse counts.
HUGE = 60_000
#: Text bytes whose sets and sketches a task holds at once: some 100 bytes of arrays for a byte pair of text.
PREFIX_BYTES = 2 << 20
#: Meetings with a leader before all members that are left meet. More only cost time; none loses a link.
MEETINGS = 2
#: Classes to verify up to which their ids are sent to the texts; beyond, the texts are shuffled by id.
SENT = 500_000


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of every word n-gram in order of the text, repeats too.

    Fewer than ``n`` words make one n-gram of them all; no words make none.
    """
    rows, values = words_of(texts)
    codes, words = encoded(values)
    if not len(rows):
        return rows, np.zeros(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in words), np.uint64, len(words))[codes]
    count = np.bincount(rows, minlength=len(texts))
    with np.errstate(over="ignore"):
        grams = np.full(len(hashes), n, dtype=np.uint64)
        for k in range(n):
            # Past the end of a text stands nothing, also for short texts, whose one n-gram this is.
            later = np.full(len(hashes), k, np.uint64)
            same = rows[:len(rows) - k] == rows[k:]
            later[:len(rows) - k][same] = hashes[k:][same]
            grams = _mixed(grams * np.uint64(0x9E3779B97F4A7C15) + later)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    full = np.arange(len(rows)) - first[rows] <= np.maximum(count - n, 0)[rows]
    return rows[full], grams[full]


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes), sorted by row and hash, distinct: every text's set of word n-grams."""
    rows, grams = shingles(texts, n)
    grams = grams.copy()
    ends = np.cumsum(np.bincount(rows, minlength=len(texts))).tolist()
    start = 0
    for end in ends:
        grams[start:end].sort()
        start = end
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _set_facts(rows: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and class hash of each row's set."""
    sizes = np.bincount(rows, minlength=n)
    sums = np.zeros(n, np.uint64)
    if len(rows):
        with np.errstate(over="ignore"):
            at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            sums[rows[at]] = np.add.reduceat(_mixed(grams), at)
    return sizes, _mixed(sums ^ sizes.astype(np.uint64))


def frequent_grams(docs: DataFrame, n: int) -> pa.Table:
    """(gram, rank): frequent n-grams, sorted, with their rank by count.

    A chunk reports the n-grams that it holds at least twice and in at least half of
    ``FREQUENT`` of its own n-grams; reports are summed. Those with at least half of
    ``FREQUENT`` of all n-grams are kept: 2 / FREQUENT at most, whatever the input.
    Where an n-gram stands in the order only changes how many candidates there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in keyed_chunks(batches):
            grams = shingles(texts_of(part), n)[1]
            found, count = np.unique(grams, return_counts=True)
            often = count >= max(2, FREQUENT / 2 * len(grams))
            # The chunk's number of n-grams goes with a null.
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(_signed(found[often])), pa.nulls(1, pa.int64())]),
                 pa.array(np.append(count[often], len(grams)).astype(np.int64))], names=["gram", "n"])

    counted = scratch(docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = counted.where("gram IS NULL").agg(F.sum("n").alias("n")).first()["n"] or 0
    kept = to_arrow(counted.where((F.col("n") >= max(2.0, FREQUENT / 2 * total)) & F.col("gram").isNotNull()))
    grams, count = kept["gram"].to_numpy(), kept["n"].to_numpy()
    rank = np.empty(len(grams), np.int32)
    rank[np.lexsort((grams, count))] = np.arange(1, len(grams) + 1)
    order = np.argsort(grams)
    return pa.table({"gram": grams[order], "rank": rank[order]})


class _Ranks:
    """Rank of frequent n-grams, 0 for others; a bit table of their low bits spares most searches."""

    def __init__(self, frequent: pa.Table):
        self.grams, self.ranks = frequent["gram"].to_numpy(), frequent["rank"].to_numpy()
        self.low = np.zeros(1 << 22, dtype=bool)
        self.low[self.grams & 0x3FFFFF] = True

    def __call__(self, signed: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(signed), np.int32)
        maybe = np.flatnonzero(self.low[signed & 0x3FFFFF])
        if len(maybe) and len(self.grams):
            asked = signed[maybe]
            at = np.minimum(np.searchsorted(self.grams, asked), len(self.grams) - 1)
            rank[maybe] = np.where(self.grams[at] == asked, self.ranks[at], 0)
        return rank


def class_rows(docs: DataFrame, n: int) -> DataFrame:
    """A row per document: doc_id, class, size, sketch, fine.

    ``sketch`` holds the set's parity by hash and packed counts by hash range, ``fine`` packs finer counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in keyed_chunks(batches, limit=PREFIX_BYTES):
            m = part.num_rows
            rows, grams = shingle_sets(texts_of(part), n)
            sizes, classes = _set_facts(rows, grams, m)
            fine = np.bincount(rows * FINE + (grams >> np.uint64(56)).astype(np.int64), minlength=m * FINE)
            ranges = np.minimum(fine.reshape(m, RANGES, FINE // RANGES).sum(2), 65_535).astype("<u2").view("<i8")
            odd = np.bincount(rows * PARITY + (grams >> np.uint64(55)).astype(np.int64), minlength=m * PARITY) & 1
            odd = np.packbits(odd.astype(np.uint8).reshape(m, PARITY), axis=1, bitorder="little").view("<i8")
            sketch = np.concatenate([odd, ranges], axis=1)
            fine = np.minimum(fine, 65_535).astype("<u2").reshape(m, FINE)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").cast(pa.int64()), pa.array(_signed(classes)), pa.array(sizes.astype(np.int32)),
                pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), sketch.shape[1]).cast(pa.list_(pa.int64())),
                pa.array([f.tobytes() for f in fine], pa.binary())], names=["doc_id", "c", "size", "sketch", "fine"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, c long, size int, sketch array<long>, fine binary")


def prefix_rows(docs: DataFrame, n: int, percent: int, frequent: pa.Table) -> DataFrame:
    """A row per prefix n-gram: gram, place, class, size. A chunk's copies of a set give rows once.

    The order is rare first: n-grams that are not frequent by hash, then frequent ones
    by count. The prefix of a set of ``s`` n-grams has s - ceil(s * t) + 1 of them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(packed(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = _Ranks(unpacked(sent.value))
        for _, part in keyed_chunks(batches, limit=PREFIX_BYTES):
            m = part.num_rows
            rows, grams = shingle_sets(texts_of(part), n)
            sizes, classes = _set_facts(rows, grams, m)
            signed = _signed(grams)
            rank = rank_of(signed)
            often = rank > 0
            # Place in the order: the others first, sorted by hash already, then frequent ones.
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            seen = np.cumsum(~often)
            before = np.concatenate([[0], seen])[first] if len(rows) else first
            place = seen - 1 - before[rows] if len(rows) else rows
            at = np.flatnonzero(often)
            at = at[np.lexsort((grams[at], rank[at], rows[at]))]
            if len(at):
                kinds = np.bincount(rows[at], minlength=m)
                start = np.concatenate([[0], np.cumsum(kinds)])[:-1]
                place[at] = (sizes - kinds)[rows[at]] + np.arange(len(at)) - start[rows[at]]
            length = sizes - (sizes * percent + 99) // 100 + 1
            once = np.zeros(m, dtype=bool)
            once[np.unique(np.stack([_signed(classes), sizes]), axis=1, return_index=True)[1]] = True
            kept = (place < length[rows]) & once[rows] if len(rows) else np.zeros(0, dtype=bool)
            rows, signed, place = rows[kept], signed[kept], place[kept]
            for a in range(0, len(rows), 100_000):
                one = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed[one]), pa.array(place[one].astype(np.int32)), pa.array(_signed(classes)[rows[one]]),
                    pa.array(sizes[rows[one]].astype(np.int32))], names=["gram", "place", "c", "size"])

    return docs.select("text").mapInArrow(run, "gram long, place int, c long, size int")


def _least_overlap(size_a: Column, size_b: Column, percent: int) -> Column:
    """Smallest overlap with which sets of these sizes are similar enough (as a double, to compare with)."""
    return (size_a + size_b) * (percent / (100.0 + percent)) - 1e-6


def _may_meet(size_a: Column, place_a: Column, size_b: Column, place_b: Column, percent: int) -> Column:
    """Length and position filters of two sets with a prefix n-gram at these places."""
    length = F.lit(100).cast("long") * F.least(size_a, size_b) >= F.lit(percent).cast("long") * F.greatest(size_a, size_b)
    after = F.least(size_a - place_a, size_b - place_b)
    return length & (F.least(place_a, place_b) + after >= _least_overlap(size_a, size_b, percent))


def _sketches_allow(size_a: Column, sketch_a: Column, size_b: Column, sketch_b: Column, percent: int) -> Column:
    """(Coarse) suffix filter of two sets, the smaller one first or both alike in size."""
    least = _least_overlap(size_a, size_b, percent)
    # A differing n-gram flips one bit of parity and moves one count by one.
    words = PARITY // 64
    flips = sum((F.bit_count(sketch_a[k].bitwiseXOR(sketch_b[k])) for k in range(1, words)), F.bit_count(sketch_a[0].bitwiseXOR(sketch_b[0])))
    count = lambda x, k: F.shiftrightunsigned(x[words + k // 4], 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))
    common = sum((F.least(count(sketch_a, k), count(sketch_b, k)) for k in range(1, RANGES)), F.least(count(sketch_a, 0), count(sketch_b, 0)))
    return (size_a + size_b - 2 * least >= flips) & ((F.greatest(size_a, size_b) >= HUGE) | (common >= least))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length, position and (coarse) suffix filters; each only rules out pairs below the threshold."""
    of = lambda x, c: F.col(f"{x}.{c}")
    return (_may_meet(of(a, "size"), of(a, "place"), of(b, "size"), of(b, "place"), percent)
            & _sketches_allow(of(a, "size"), of(a, "sketch"), of(b, "size"), of(b, "sketch"), percent))


def _coarse_filtered(pairs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, size_a, b, size_b) that their sketches don't rule out."""
    x = shape.select(F.col("c").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("x"))
    y = shape.select(F.col("c").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("y"))
    held = _sketches_allow(F.col("size_a"), F.col("x"), F.col("size_b"), F.col("y"), percent)
    return pairs.join(x, ["a", "size_a"]).join(y, ["b", "size_b"]).where(held).select("a", "size_a", "b", "size_b")


def _suffix_filtered(pairs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, size_a, b, size_b) that the counts by fine hash range don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, FINE) for c in ("x", "y"))
            # A count at its top may stand for more; the size bounds it.
            common = np.where((x == 65_535) & (y == 65_535), 1 << 30, np.minimum(x, y).astype(np.int64)).sum(1)
            sizes = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            held = common * (100 + percent) >= sizes * percent
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "size_a", "b", "size_b"]).filter(pa.array(held))

    x = shape.select(F.col("c").alias("a"), F.col("size").alias("size_a"), F.col("fine").alias("x"))
    y = shape.select(F.col("c").alias("b"), F.col("size").alias("size_b"), F.col("fine").alias("y"))
    return pairs.join(x, ["a", "size_a"]).join(y, ["b", "size_b"]).select("a", "size_a", "b", "size_b", "x", "y").mapInArrow(
        run, "a long, size_a int, b long, size_b int")


def _class_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(c, size, grams): the whole set of every wanted class (c, size, doc_id of one member), as packed sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in keyed_chunks(batches, limit=PREFIX_BYTES):
            rows, grams = shingle_sets(texts_of(part), n)
            sizes, classes = _set_facts(rows, grams, part.num_rows)
            ends = np.cumsum(sizes)
            data = grams.astype("<u8").tobytes()
            sets = [data[8 * (e - s):8 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("c"), part.column("size"), pa.array(_signed(classes)), pa.array(sizes.astype(np.int32)), pa.array(sets, pa.binary())],
                names=["c", "size", "c2", "size2", "grams"])

    wanted = scratch(wanted, "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    texts = docs.select("doc_id", "text").alias("d").join(ids.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select(
        "w.c", "w.size", "d.text")
    found = texts.mapInArrow(run, "c long, size int, c2 long, size2 int, grams binary")
    # An id may stand for several texts; only the one that has the set counts, once.
    return (found.where("c = c2 AND size = size2").groupBy("c", "size").agg(F.first("grams").alias("grams")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, size_a, b, size_b) of classes whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                held.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], names=["a", "size_a", "b", "size_b"]).filter(pa.array(held, pa.bool_()))

    x = sets.select(F.col("c").alias("a"), F.col("size").alias("size_a"), F.col("grams").alias("x"))
    y = sets.select(F.col("c").alias("b"), F.col("size").alias("size_b"), F.col("grams").alias("y"))
    full = pairs.join(x, ["a", "size_a"]).join(y, ["b", "size_b"]).select("a", "size_a", "b", "size_b", "x", "y")
    return full.mapInArrow(run, "a long, size_a int, b long, size_b int")


def _node(c: str, size: str) -> Column:
    """A class as one value for the component search."""
    return F.struct(F.col(c).alias("c"), F.col(size).alias("size"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_class (documents with the same set).

    Documents link when 100 * intersection >= ``percent`` * union of their sets of word
    n-grams; component_id is the smallest doc_id reachable by links, itself included.
    Documents without words (null or empty text) have an empty set and link with
    nothing, not even each other. Repeated rows and equal texts link by their equal
    sets. A null doc_id links like others but is never a component's id, unless the
    component has no other: then it is null. An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    heads = scratch(class_rows(docs, n), "heads")
    # One shuffle deals the prefix rows by n-gram; copies, group sizes and leaders are found where they are.
    group = Window.partitionBy("gram")
    met = (prefix_rows(docs, n, percent, frequent_grams(docs, n)).repartition("gram").groupBy("gram", "c", "size")
           .agg(F.min("place").alias("place"))
           .withColumns({"k": F.count("*").over(group), "leader": F.min(F.struct("c", "size", "place")).over(group)})
           .where("k > 1"))
    met = scratch(met, "met")
    classes = (heads.where("size > 0").groupBy("c", "size")
               .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_class"),
                    F.first("sketch").alias("sketch"), F.first("fine").alias("fine")))
    # Sets in large groups are good leaders: most of what they hold, others hold too.
    weights = met.groupBy("c", "size").agg(F.sum("k").alias("weight"))
    facts = scratch(classes.join(weights, ["c", "size"]), "facts")
    # First meeting: each member with its group's leader, each pair once.
    led = met.select("gram", "c", "size", "place", "leader")
    links = _checked(docs, _coarse_filtered(_stars(led, percent), facts, percent), facts, n, percent)
    roots = _rooted(links)
    root = F.coalesce("root", _node("c", "size"))
    # The leader has met all of its group and leaves; groups of one component have no more to find.
    left = led.where(~_leads()).drop("leader").join(facts.select("c", "size", "weight"), ["c", "size"])
    left = scratch(_of_several(left.join(roots, ["c", "size"], "left").withColumn("root", root)), "left")
    # Further meetings, led by the heaviest member.
    heaviest = F.max(F.struct("weight", "c", "size", "place", "root")).over(group)
    for _ in range(1, MEETINGS):
        led = left.withColumn("leader", heaviest)
        found = _checked(docs, _coarse_filtered(_stars(led.where("root <> leader.root"), percent), facts, percent), facts, n, percent)
        if found.isEmpty():
            break
        links = links.union(found)
        roots = _rooted(links)
        left = led.where(~_leads()).drop("leader", "root").join(roots, ["c", "size"], "left").withColumn("root", root)
        left = scratch(_of_several(left), "left")
    # Last meeting: all members of different components, in groups that hold several.
    placed = scratch(left.drop("weight").join(facts.select("c", "size", "sketch"), ["c", "size"]), "placed")
    x, y = placed.alias("x"), placed.alias("y")
    # The smaller set first, equal sizes by class: each pair once a group.
    ordered = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.c") < F.col("y.c")))
    rest = x.join(y, (F.col("x.gram") == F.col("y.gram")) & ordered & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", percent))
    rest = rest.select(F.col("x.c").alias("a"), F.col("x.size").alias("size_a"), F.col("y.c").alias("b"),
                       F.col("y.size").alias("size_b")).distinct()
    links = links.union(_checked(docs, rest, facts, n, percent))
    return _labelled(heads, classes, _rooted(links))


def _leads() -> Column:
    """Whether a row is its group's leader."""
    return (F.col("c") == F.col("leader.c")) & (F.col("size") == F.col("leader.size"))


def _stars(led: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, size_a, b, size_b) of a leader and a member that may meet, each once."""
    of = lambda c: F.col(f"leader.{c}")
    met = led.where(~_leads() & _may_meet(of("size"), of("place"), F.col("size"), F.col("place"), percent))
    return met.select(of("c").alias("a"), of("size").alias("size_a"), F.col("c").alias("b"), F.col("size").alias("size_b")).distinct()


def _of_several(rows: DataFrame) -> DataFrame:
    """Rows of n-grams whose rows are of several components (column ``root``)."""
    group = Window.partitionBy("gram")
    return (rows.repartition("gram").withColumns({"r0": F.min("root").over(group), "r1": F.max("root").over(group)})
            .where("r0 <> r1").drop("r0", "r1"))


def _checked(docs: DataFrame, pairs: DataFrame, facts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough; sets are made only for pairs that pass the suffix filter."""
    pairs = scratch(_suffix_filtered(pairs, facts.select("c", "size", "fine"), percent), "pairs")
    both = pairs.select(F.col("a").alias("c"), F.col("size_a").alias("size")).union(pairs.select("b", "size_b")).distinct()
    wanted = facts.select("c", "size", "doc_id").join(both, ["c", "size"], "left_semi")
    sets = scratch(_class_sets(docs, wanted, n), "sets")
    return scratch(_verified(pairs, sets, percent), "links")


def _rooted(links: DataFrame) -> DataFrame:
    """(c, size, root) of every class that has a link."""
    nodes = links.select(_node("a", "size_a").alias("a"), _node("b", "size_b").alias("b"))
    return components(nodes).select("node.c", "node.size", "root")


def _labelled(heads: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every document with the smallest id of its component."""
    member = classes.select("c", "size", "doc_id", "n_class").join(roots, ["c", "size"], "left").withColumn(
        "root", F.coalesce("root", _node("c", "size")))
    smallest = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = member.join(smallest, "root").select("c", "size", "component_id", "n_class")
    # A class with many copies is one row on this side; the copies' side may be split.
    full = heads.where("size > 0").join(by_class, ["c", "size"]).select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id", "n_class")
    empty = heads.where("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"),
                                           F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_class"))
    return full.union(empty)


def one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one document of each, with its columns.

    That is the row of the component's smallest doc_id. Where several rows have that
    id, one of each different text stays. Documents without words link with nothing
    and all stay; rows with a null doc_id can't be told apart by it and stay too.
    """
    kept = jaccard_components(docs, n, percent).where("doc_id = component_id").groupBy("doc_id").agg(
        F.max("n_shingles").alias("_size"), F.count("*").alias("_rows"))
    names = docs.columns
    short = [f"_{i}" for i in range(len(names))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(s) for c, s in zip(names, short)]).alias("_row"), F.col("doc_id").alias("_id"),
                       F.col("text").alias("_text"))
    rows = rows.join(kept.select(F.col("doc_id").alias("_id"), "_size", "_rows"), "_id", "left")
    plain = rows.where("_id IS NULL OR _size = 0 OR _rows = 1").select("_row")
    repeated = rows.where("_size > 0 AND _rows > 1").groupBy("_id", "_text").agg(F.first("_row").alias("_row")).select("_row")
    return plain.union(repeated).select(*[F.col(f"_row.{s}").alias(c) for c, s in zip(names, short)])


#: The components of 3-word shingles at 90 % in DuckDB, by counting the shingles that two documents share.
ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded),
shingles AS (
  SELECT r, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.r AS a, b.r AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
edges AS (
  SELECT a, b FROM shared JOIN sets x ON x.r = a JOIN sets y ON y.r = b WHERE 100 * k >= 90 * (len(x.s) + len(y.s) - k)),
reach AS (
  SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least_ AS (
  SELECT reach.a AS r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON reach.b = sets.r GROUP BY reach.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least_ USING (r)
"""
