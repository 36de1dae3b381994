"""Operator 5: Brown class-based bigram language model.

Words get classes; a text's probability is the product of class-transition and
word-emission probabilities. Every word that training has at least ``LEAST`` times is
assigned by exchange clustering:

- Frequent words (``CORE`` of all training tokens, so 1 / ``CORE`` words at most) are
  exchanged by their neighbours on both sides, in turns until it settles.
- All other words are exchanged by the classes of the words before them. A pass moves
  every word to its best class under the class counts of the pass before, which never
  lowers the training likelihood while a word's context is fixed; passes end when it
  settles. The classes of a pass follow from the class counts of the pass before, so
  a pass reads the contexts once, shuffles nothing but class counts, and the table of
  classes, which grows with the corpus, is written once at the end.

As the word *before* another, a frequent word stands for its class and any other for
the class of its ending: a bounded map that every task can hold, so contexts are fixed.
Words seen less than ``LEAST`` times, and unseen ones, have the class of their ending.
Counts of all words, classes and transitions cover all training texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import encoded, keyed_chunks, packed, prepare, scratch, texts_of, unpacked, words_of
from .terms import count_terms, document_sums, heavy_terms

#: Share of all training tokens from which a word takes part in exchange clustering.
CORE = 1e-4
#: Classes that exchange clustering fills, classes by ending, and all with that of the end.
CLASSES, ENDINGS = 64, 32
TOTAL = CLASSES + ENDINGS + 1
#: Occurrences in training from which a word is clustered.
LEAST = 3
#: Exchange ends when a turn of all words raises the likelihood by less than this, in nats a token.
SETTLED = 1e-3
#: The most rounds that a turn of all frequent words is spread over.
SLOWEST = 16
#: Weight of a class's share of all tokens in its transitions, as tokens; and what is added to the tokens of a class for it.
PRIOR, ALPHA = 10.0, 0.1
#: The end of a text; no word holds a line feed.
END = "\n"


def ending_class(word: Column) -> Column:
    """Class of a rare word: a checksum of its last three characters."""
    return (F.crc32(F.right(word, F.lit(3))) % ENDINGS + CLASSES).cast("int")


def ending_class_of(word: str) -> int:
    return zlib.crc32(word[-3:].encode()) % ENDINGS + CLASSES


def held_out(doc_id: Column) -> Column:
    """Documents that the model doesn't learn from (null id: learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7, F.lit(0)) == 2


def with_end(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words in order and one end after each text's last."""
    rows, words = words_of(texts)
    order = np.argsort(np.concatenate([rows, np.arange(len(texts))]), kind="stable")
    ends = pa.array([END] * len(texts), pa.string())
    return (np.concatenate([rows, np.arange(len(texts))])[order],
            pa.concat_arrays([words.cast(pa.string()), ends]).take(pa.array(order)))


@dataclass
class ClassModel:
    """What every task needs; its size does not grow with the corpus, the table of words and classes does."""

    core: dict[str, int]     # classes of frequent words, also as the word before
    transitions: np.ndarray  # log10 P(class | class of the word before), the end's class is the last
    emissions: np.ndarray    # log10 of what a word's count is divided by, by class
    tokens: int              # N
    vocabulary: int          # V
    likelihoods: list[list[float]]  # by round of frequent words, then by pass of all others

    @property
    def end(self) -> int:
        return TOTAL - 1


def _bigrams(train: DataFrame, core: list[str]) -> DataFrame:
    """(a, b, n): neighbours as symbols: a core word's number, or a class by ending, or the end."""
    sent = train.sparkSession.sparkContext.broadcast(packed(pa.table({"w": pa.array(core, pa.string())})))
    first_ending, symbols = len(core), len(core) + ENDINGS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(sent.value)["w"].combine_chunks()
        for _, part in keyed_chunks(batches):
            rows, values = with_end(texts_of(part))
            codes, words = encoded(values)
            found = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in np.flatnonzero(found < 0).tolist():
                w = words[i].as_py()
                found[i] = symbols - 1 if w == END else first_ending + ending_class_of(w) - CLASSES
            s = found[codes]
            # The token before a text's first is an end.
            before = np.concatenate([[symbols - 1], s[:-1]]) if len(s) else s
            pairs, n = np.unique(before * symbols + s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs // symbols), pa.array(pairs % symbols), pa.array(n)],
                                             names=["a", "b", "n"])

    return train.select("text").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _likelihood(g: np.ndarray) -> float:
    """Class part of the bigram log likelihood."""
    return float(_xlogx(g).sum() - _xlogx(g.sum(0)).sum() - _xlogx(g.sum(1)).sum())


def _best_class(g: np.ndarray, right: np.ndarray, left: np.ndarray, itself: float) -> int:
    """The class that raises the likelihood most for a word with these contexts; ``g`` holds all pairs without it.

    ``right``/``left``: counts of classes after and before the word; ``itself``: how often it follows itself.
    """
    n, k = CLASSES, np.arange(CLASSES)
    # Neighbours' own totals have the word's pairs wherever it goes.
    rows, columns = (g.sum(1) + left)[:n], (g.sum(0) + right)[:n]
    outer, inner, own = right.sum() + itself, left.sum() + itself, g[k, k]
    after, before = _xlogx(g[:n] + right) - _xlogx(g[:n]), _xlogx(g[:, :n].T + left) - _xlogx(g[:, :n].T)
    # Pairs of the class with itself take both sides at once.
    after[k, k], before[k, k] = _xlogx(own + right[:n] + left[:n] + itself) - _xlogx(own), 0.0
    gain = (after.sum(1) + before.sum(1) - (_xlogx(rows + outer) - _xlogx(rows)) - (_xlogx(columns + inner) - _xlogx(columns)))
    return int(np.argmax(gain))


def exchange(bigrams: DataFrame, n_core: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the frequent words, the class bigram counts, and the likelihood by accepted round.

    Each round joins the bigram table with the classes and sums contexts per word, by
    class (1 / CORE words of 2 * TOTAL + 1 counts at most). One task moves these words one
    after another to their best class and keeps the class counts up to date: words that
    move side by side flock (8 tasks ended at -12.36 a token on sf0.01, one at -12.26).
    Contexts are those of the round's start, so a round may lower the likelihood; it is
    taken back, and from then on twice as many rounds make up a turn of all words. It
    ends when a turn raises the likelihood by less than ``SETTLED`` a token, or beyond
    ``SLOWEST`` rounds a turn. The driver holds the classes and the class matrix.
    """
    spark = bigrams.sparkSession
    fixed = np.arange(CLASSES, TOTAL)
    # By descending frequency, words start in the classes in turn.
    assigned = np.concatenate([np.arange(n_core) % CLASSES, fixed])
    best, seen, since, rounds, turn = None, [], 0, 1, 0
    while True:
        # A row per symbol: 1 / CORE at most.
        classes = spark.createDataFrame(pd.DataFrame({"s": np.arange(len(assigned)), "c": assigned}), "s long, c int")
        of = lambda side, classes=classes: F.broadcast(classes.select(F.col("s").alias(side), F.col("c").alias(f"c{side}")))
        joined = bigrams.join(of("a"), "a").join(of("b"), "b")
        matrix = np.zeros((TOTAL, TOTAL))
        for r in joined.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect():  # TOTAL**2 rows at most
            matrix[r["ca"], r["cb"]] = r["n"]
        value = _likelihood(matrix)
        if best is None or value > best[2]:
            best = (assigned, matrix, value)
            seen.append(value)
        else:
            rounds *= 2
            since = len(seen)
        if n_core == 0 or rounds > SLOWEST or (len(seen) - since > rounds and seen[-1] - seen[-1 - rounds] < SETTLED * matrix.sum()):
            return best[0], best[1], seen
        now, matrix = best[0], best[1]
        both = joined if now is assigned else None
        if both is None:
            classes = spark.createDataFrame(pd.DataFrame({"s": np.arange(len(now)), "c": now}), "s long, c int")
            both = bigrams.join(of("a", classes), "a").join(of("b", classes), "b")
        # Side 0: what follows a word, 1: what it follows, 2: itself.
        sides = both.select(F.col("a").alias("s"), F.when(F.col("a") == F.col("b"), 2).otherwise(0).alias("d"), F.col("cb").alias("c"), "n").union(
            both.where("a <> b").select(F.col("b").alias("s"), F.lit(1).alias("d"), F.col("ca").alias("c"), "n"))

        def move(group: pd.DataFrame) -> pd.DataFrame:
            g, to = matrix.copy(), []
            for s, own in (words := group.sort_values("s")).groupby("s"):
                counts = np.zeros((3, TOTAL))
                np.add.at(counts, (own["d"].to_numpy(), own["c"].to_numpy()), own["n"].to_numpy())
                (right, left), itself, c = counts[:2], counts[2].sum(), now[s]
                g[c, :] -= right
                g[:, c] -= left
                g[c, c] -= itself
                # Neighbours that moved before it in this round are counted under their last class.
                np.maximum(g, 0, out=g)
                to.append(c := _best_class(g, right, left, itself))
                g[c, :] += right
                g[:, c] += left
                g[c, c] += itself
            return pd.DataFrame({"s": words["s"].unique(), "c": to})

        mine = F.pmod(F.pmod(F.xxhash64("s"), F.lit(rounds)) + turn, F.lit(rounds)) == 0
        counted = sides.where((F.col("s") < n_core) & mine).groupBy("s", "d", "c").agg(F.sum("n").alias("n"))
        turn += 1
        assigned = now.copy()
        for r in counted.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(move, "s long, c int").collect():  # 1 / CORE rows at most
            assigned[r["s"]] = r["c"]


def _core_classes(values: pa.Array, known: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(codes, words, class as the word before, whether frequent) of the distinct words among ``values``."""
    codes, words = encoded(values)
    words = words.cast(pa.string())
    at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    found = classes[at] if len(classes) else at.copy()
    for i in np.flatnonzero(at < 0).tolist():
        found[i] = TOTAL - 1 if (w := words[i].as_py()) == END else ending_class_of(w)
    return codes, words, found, at >= 0


def contexts(train: DataFrame, core: dict[str, int]) -> DataFrame:
    """(term, n, own, before, counts) of every word but the frequent: how often it follows each class.

    ``own`` is the class of a word that is too rare to be clustered, else null. A word
    has at most ``TOTAL`` entries, whatever its count.
    """
    sent = train.sparkSession.sparkContext.broadcast(packed(pa.table({
        "w": pa.array(list(core), pa.string()), "c": pa.array(list(core.values()), pa.int64())})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpacked(sent.value)
        known, classes = table["w"].combine_chunks(), table["c"].combine_chunks().to_numpy(zero_copy_only=False)
        for _, part in keyed_chunks(batches):
            codes, words, symbols, frequent = _core_classes(with_end(texts_of(part))[1], known, classes)
            before = np.concatenate([[TOTAL - 1], symbols[codes][:-1]]) if len(codes) else codes
            wanted = (~frequent & (symbols != TOTAL - 1))[codes]
            pairs, n = np.unique(codes[wanted] * TOTAL + before[wanted], return_counts=True)
            for at in range(0, len(pairs), 200_000):
                p = pairs[at:at + 200_000]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(p // TOTAL)), pa.array((p % TOTAL).astype(np.int32)),
                                                  pa.array(n[at:at + 200_000])], names=["term", "h", "n"])

    # Dealt by word, so both groupings share the one shuffle.
    counted = train.select("text").mapInArrow(run, "term string, h int, n long").repartition("term").groupBy("term", "h").agg(F.sum("n").alias("n"))
    found = counted.groupBy("term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("h", "n")).alias("x"))
    return found.select("term", "n", F.when(F.col("n") < LEAST, ending_class(F.col("term"))).alias("own"),
                        F.col("x.h").alias("before"), F.col("x.n").alias("counts"))


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """Counts by word and class before it."""
    before, counts = batch.column("before"), batch.column("counts")
    offsets = before.offsets.to_numpy()
    rows = np.repeat(np.arange(len(before)), np.diff(offsets))
    at = rows * TOTAL + before.flatten().to_numpy(zero_copy_only=False)
    return np.bincount(at, weights=counts.flatten().to_numpy(zero_copy_only=False), minlength=len(before) * TOTAL).reshape(-1, TOTAL)


def _best(x: np.ndarray, matrix: np.ndarray | None) -> np.ndarray:
    """Each word's best class under these class counts; at the start, a class by what the word follows most."""
    if matrix is None:
        return x.argmax(1) % CLASSES
    own = matrix[:, :CLASSES]
    # What a class has never followed counts a little.
    return (x @ np.log((own + 1e-3) / (own.sum(0) + 1e-3 * TOTAL))).argmax(1)


def place(words: DataFrame, fixed: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, list[float]]:
    """Exchange all words but the frequent: (class counts that decide, those that follow, likelihood by pass).

    ``fixed`` has the class counts of everything that doesn't move. A word's class is the
    best under the deciding counts, so the classes need no table while passes run.
    """
    deciding, former, matrix, seen = None, None, None, []
    while True:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((TOTAL, CLASSES))
            for batch in batches:
                for at in range(0, batch.num_rows, 10_000):
                    x = _entries(batch.slice(at, 10_000))
                    c = _best(x, deciding)
                    for k in np.unique(c).tolist():
                        sums[:, k] += x[c == k].sum(0)
            h, c = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int32)), pa.array(c.astype(np.int32)),
                                              pa.array(sums[h, c].astype(np.int64))], names=["h", "c", "n"])

        following = fixed.copy()
        # TOTAL * CLASSES rows at most.
        for r in words.select("before", "counts").mapInArrow(run, "h int, c int, n long").groupBy("h", "c").agg(F.sum("n").alias("n")).collect():
            following[r["h"], r["c"]] += r["n"]
        own = following[:, :CLASSES]
        value = float(_xlogx(own).sum() - _xlogx(own.sum(0)).sum())
        if seen and value <= seen[-1]:
            return former, matrix, seen
        seen.append(value)
        former, matrix, deciding = deciding, following, following
        if len(seen) > 1 and value - seen[-2] < SETTLED * own.sum():
            return former, matrix, seen


def classes_of(words: DataFrame, deciding: np.ndarray | None) -> DataFrame:
    """(term, class, n): every word but the frequent, by the deciding class counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                c = _best(_entries(part), deciding).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("term"), pc.coalesce(part.column("own"), pa.array(c)),
                                                  part.column("n")], names=["term", "class", "n"])

    return words.select("term", "own", "before", "counts", "n").mapInArrow(run, "term string, class int, n long")


def train_classes(train: DataFrame, table: DataFrame) -> tuple[ClassModel, DataFrame]:
    """Cluster, and count what emission and transition probabilities need: the model, and (term, class, n) of all words."""
    row = table.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, vocabulary = row["n"] or 0, row["v"]
    core = table.where((F.col("n") >= max(CORE * total, LEAST)) & (F.col("term") != END)).orderBy(F.desc("n"), "term").select("term", "n")
    words = core.collect()  # 1 / CORE rows at most
    bigrams = scratch(_bigrams(train, [r["term"] for r in words]), "bigrams")
    assigned, matrix, rounds = exchange(bigrams, len(words))
    found = {r["term"]: int(assigned[i]) for i, r in enumerate(words)}
    rest = scratch(contexts(train, found), "contexts")
    # Frequent words and the end keep their counts; words by ending are counted again, now that most have classes.
    fixed = matrix.copy()
    fixed[:, CLASSES:TOTAL - 1] = 0
    each = rest.where("own IS NOT NULL").select("own", F.explode(F.arrays_zip("before", "counts")).alias("x"))
    for r in each.groupBy("own", F.col("x.before").alias("h")).agg(F.sum("x.counts").alias("n")).collect():  # TOTAL * ENDINGS at most
        fixed[r["h"], r["own"]] = r["n"]
    deciding, matrix, passes = place(rest.where("own IS NULL"), fixed)
    spark = train.sparkSession
    frequent = spark.createDataFrame(pd.DataFrame({"term": list(found), "class": list(found.values()), "n": [r["n"] for r in words]}),
                                     "term string, class int, n long")
    end = table.where(F.col("term") == END).select("term", F.lit(TOTAL - 1).alias("class"), "n")
    classes = scratch(classes_of(rest, deciding).union(frequent).union(end), "classes")
    sizes = matrix.sum(0)
    # A class of clustered words has no unseen word; one by ending has one, and its counts have one added.
    divisors = np.maximum(sizes, 1.0)
    for r in classes.where(F.col("class").between(CLASSES, TOTAL - 2)).groupBy("class").count().collect():  # ENDINGS rows at most
        divisors[r["class"]] += r["count"]
    share = (sizes + ALPHA) / (sizes.sum() + ALPHA * TOTAL)
    log = np.log10((matrix + PRIOR * share) / (matrix.sum(1, keepdims=True) + PRIOR))
    return ClassModel(found, log, np.log10(divisors), total, vocabulary, [rounds, passes]), classes


def score_documents(docs: DataFrame) -> DataFrame:
    """Score every whole text with the model learned from the documents not held out.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in
    training), train_tokens, base_score (add-one unigram), score (class model, log10),
    perplexity. A clustered word's emission is its share of its class's tokens; a word
    by ending has (c + 1) / (tokens + distinct words of its class), unseen words too.

    Null or empty text: one token, the end. Null ``doc_id``: learned from, not held
    out. Repeated rows count and are scored each. Very long texts are a chunk of their
    own. Without training rows every count is 0. An empty table gives no rows; other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    train = docs.where(~F.col("held_out"))
    table = scratch(count_terms(train, with_end), "words")
    model, classes = train_classes(train, table)
    heavy = heavy_terms(classes, model.tokens, "n", "class")
    held = docs.sparkSession.sparkContext.broadcast(model)
    head = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                         T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                         T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    base = float(np.log10(model.tokens + model.vocabulary + 1))

    def before_of(codes: np.ndarray, terms: pa.Array) -> np.ndarray:
        """Each token's class of the token before it; before a text's first is an end."""
        core, end = held.value.core, held.value.end
        symbols = np.fromiter((end if w == END else k if (k := core.get(w)) is not None else ending_class_of(w)
                               for w in terms.to_pylist()), np.int64, len(terms))
        return np.concatenate([[end], symbols[codes][:-1]]) if len(codes) else codes

    def inside(part, rows, codes, terms, found, known):
        m = held.value
        counts = known["n"].combine_chunks().to_numpy(zero_copy_only=False)
        class_ = known["class"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        # Rare words come with the join.
        here = found >= 0
        c = np.where(here, counts[found], 1) if len(counts) else np.ones(len(found), np.int64)
        k = np.where(here, class_[found], 0) if len(counts) else np.zeros(len(found), np.int64)
        by_ending = (k >= CLASSES) & (k < m.end)
        emit = np.where(k == m.end, 0.0, np.log10(c + by_ending) - m.emissions[k])
        plain = np.where(here, np.log10(c + 1.0) - base, 0.0)
        moves = m.transitions[before_of(codes, terms), k[codes]]
        n = part.num_rows
        add = lambda w: np.bincount(rows, weights=w, minlength=n)
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": np.bincount(rows, minlength=n),
                "n_known": add(here[codes]).astype(np.int64), "base_score": add(plain[codes]),
                "score": add(np.where(here[codes], emit[codes] + moves, 0.0))}

    seen, end = F.coalesce(F.col("n"), F.lit(0)), F.col("term") == END
    class_ = F.when(end, model.end).otherwise(F.coalesce(F.col("class"), ending_class(F.col("term"))))
    emit = F.when(end, 0.0).otherwise(
        F.log10(seen + F.when(class_ >= CLASSES, 1.0).otherwise(0.0)) - F.get(_numbers(model.emissions), class_))
    moves = F.aggregate("before", F.lit(0.0), lambda s, h: s + F.get(_numbers(model.transitions), h * TOTAL + class_))
    found = document_sums(docs, classes, model.tokens, heavy, with_end, head, inside, {
        "n_known": F.when(seen > 0, F.col("freq")).otherwise(0),
        "base_score": F.col("freq") * (F.log10(seen + 1.0) - F.lit(base)),
        "score": F.col("freq") * emit + moves}, before_of)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _numbers(values: np.ndarray) -> Column:
    """A table of numbers as one constant."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values.ravel())), ",").cast("array<double>")
