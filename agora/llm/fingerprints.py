"""Operator 12: document fingerprints by consistent weighted sampling.

A text is its words with their counts as weights. For every word and each of
``SAMPLES`` draws a worker derives two gamma variables and a uniform one from the
word's hash; the word whose weighted draw is least is the sample, together with the
step that its weight reaches. Two texts agree in a sample with probability equal to
their generalised Jaccard similarity (sum of the lesser over sum of the greater counts).

Texts are dealt out by ranges of descending doc_id and streamed through each task in
that order; only the two rows at the ends of each range meet rows of another one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import encoded, prepare, scratch, slices, texts_of, words_of

#: Samples of a fingerprint; a likeness has a standard error of at most 1 / (2 * sqrt(SAMPLES)).
SAMPLES = 128
#: Weighted words whose draws a worker keeps: the first that several documents of a slice have.
KEPT_TERMS = 49_152
#: Weighted words of documents that are looked at together.
SLICE = 16_384
#: Text bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 20
#: Draws expected below a document's first threshold, per sample.
EXPECTED = 10
#: Thresholds: one for every power of two of a document's total weight.
CLASSES = 32
STEP = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def gamma_quantiles() -> np.ndarray:
    """A gamma variable of shape 2 at the middles of 2**16 equal shares: its inverse distribution."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(share)), np.full(len(share), 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = -np.expm1(-middle) - middle * np.exp(-middle) < share
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low.astype(np.float32)


def ordered(x: np.ndarray) -> np.ndarray:
    """32-bit numbers that compare like the given floats."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)


#: A draw of weight w is below x with probability 1 - exp(-w * x): of a document's draws, EXPECTED are below its threshold.
THRESHOLDS = ordered(np.array([math.log(EXPECTED) - c * math.log(2) for c in range(CLASSES)])) << np.uint64(32)


class Sampler:
    """Fingerprints of texts; draws of weighted words that come again are kept.

    Only draws below a threshold by the document's total weight are compared; a
    document in which a sample has none below is done again with all its draws.
    ``quantiles`` and their logs are made once, on the driver, so that all tasks draw alike.
    """

    def __init__(self, quantiles: np.ndarray, logs: np.ndarray):
        self.quantiles, self.logs = quantiles, logs
        self.at: dict[int, int] = {}
        self.kept = np.empty((KEPT_TERMS, SAMPLES), dtype=np.uint64)
        self.below = np.empty((KEPT_TERMS, CLASSES), dtype=np.uint8)

    def draws(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Per weighted word and sample its draw, as a number that compares like it.

        r and c are gamma variables of shape 2 and beta is uniform, by 16, 16 and 32 bits
        of a hash of word and sample. The weight reaches the step t = floor(ln w / r +
        beta), and the draw is ln a = ln c - r * (t - beta + 1): the upper 32 bits. Then come
        16 bits of the hash of word and step, then the sample's number.
        """
        found = np.empty((len(hashes), SAMPLES), dtype=np.uint64)
        log_w = np.array([math.log(w) for w in weights.tolist()], dtype=np.float32)
        for start in range(0, len(hashes), 512):
            part = slice(start, start + 512)
            own = hashes[part, None]
            bits = mixed(own + (np.arange(1, SAMPLES + 1, dtype=np.uint64) * STEP)[None, :])
            r = self.quantiles[(bits & np.uint64(0xFFFF)).astype(np.int64)]
            log_c = self.logs[((bits >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
            beta = (bits >> np.uint64(32)).astype(np.float32) * np.float32(2.0 ** -32)
            t = np.floor(log_w[part, None] / r + beta)
            out = ordered(log_c - r * (t - beta + np.float32(1))) << np.uint64(32)
            out |= (mixed(own + t.astype(np.int64).astype(np.uint64) * STEP) >> np.uint64(48)) << np.uint64(8)
            found[part] = out | np.arange(SAMPLES, dtype=np.uint64)[None, :]
        return found

    def compare(self, best: np.ndarray, docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, classes: np.ndarray | None) -> None:
        """Take the draws of (document, word, weight) rows into ``best``; of all samples where ``classes`` is None."""
        terms, first, place, often = np.unique(mixed(hashes) + weights.astype(np.uint64) * STEP, return_index=True, return_inverse=True,
                                               return_counts=True)
        at = np.array([self.at.get(k, -1) for k in terms.tolist()], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        fresh = self.draws(hashes[first[new]], weights[first[new]])
        again = np.flatnonzero(often[new] > 1)[:KEPT_TERMS - len(self.at)]
        if len(again):
            start, drawn = len(self.at), fresh[again]
            stop = start + len(again)
            self.kept[start:stop] = np.sort(drawn, axis=1)
            for c in range(CLASSES):
                self.below[start:stop, c] = (drawn < THRESHOLDS[c]).sum(axis=1)
            at[new[again]] = np.arange(start, stop)
            self.at.update(zip(terms[new[again]].tolist(), range(start, stop)))
        number = np.full(len(terms), -1, dtype=np.int64)
        number[new] = np.arange(len(new))
        slot = at[place]
        known, other = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        if len(known):
            # The draws kept are sorted: those below a threshold come first.
            slot, d = slot[known], docs[known]
            count = np.full(len(d), SAMPLES, dtype=np.int64) if classes is None else self.below[slot, classes[d]].astype(np.int64)
            ends = np.cumsum(count)
            self.take(best, np.repeat(d, count), self.kept.ravel()[np.arange(ends[-1]) + np.repeat(slot * SAMPLES - (ends - count), count)])
        if len(other):
            d, table = docs[other], fresh[number[place[other]]]
            low = table <= NONE if classes is None else table < THRESHOLDS[classes[d]][:, None]
            self.take(best, np.repeat(d, low.sum(axis=1)), table[low])

    @staticmethod
    def take(best: np.ndarray, docs: np.ndarray, found: np.ndarray) -> None:
        np.minimum.at(best.ravel(), docs * SAMPLES + (found & np.uint64(0xFF)).astype(np.int64), found)

    def sign(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (SAMPLES 16-bit numbers a row) and whether a text has words at all."""
        n = len(texts)
        best = np.full((n, SAMPLES), NONE, dtype=np.uint64)
        rows, words = words_of(texts)
        codes, distinct = encoded(words)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        size = max(len(hashes), 1)
        pairs, weights = np.unique(rows * size + codes, return_counts=True)
        docs, words = pairs // size, pairs % size
        total = np.bincount(docs, weights=weights, minlength=n)
        classes = np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), CLASSES - 1)

        def all_of(rows: np.ndarray, classes: np.ndarray | None, step: int) -> None:
            for start in range(0, len(rows), step):
                part = rows[start:start + step]
                self.compare(best, docs[part], hashes[words[part]], weights[part], classes)

        all_of(np.arange(len(pairs)), classes, SLICE)
        open_docs = (best == NONE).any(axis=1)
        all_of(np.flatnonzero(open_docs[docs]), None, SLICE // 16)
        return ((best >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16), total > 0


def likeness(a: np.ndarray, full_a: np.ndarray, b: np.ndarray, full_b: np.ndarray) -> np.ndarray:
    """Share of equal samples; texts without words are like one another and like no other."""
    return np.where(full_a & full_b, (a == b).mean(axis=1), (full_a == full_b).astype(np.float64))


def packed(values: np.ndarray, full: np.ndarray) -> pa.Array:
    data = values.astype(">u2")
    return pa.array([data[i].tobytes() if f else b"" for i, f in enumerate(full.tolist())], pa.binary())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the beginning of the next text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


RESULT = ["n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next"]


def changed_texts(own: pa.Array, following: pa.Array) -> pa.Array:
    return pa.array([edited(a, b) for a, b in zip(own.to_pylist(), following.to_pylist())], pa.string())


def row_columns(own: pa.Array, changed: pa.Array, prints: tuple, prints_next: tuple, prints_changed: tuple) -> dict[str, pa.Array]:
    """The columns ``RESULT`` of texts, by their prints, those of the next texts and of the edited ones."""
    return {"n_chars": pa.array([len(x) for x in own.to_pylist()], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in changed.cast(pa.binary()).to_pylist()], pa.string()),
            "print": packed(*prints), "edited_print": packed(*prints_changed),
            "near_edited": pa.array(likeness(*prints, *prints_changed), pa.float64()),
            "near_next": pa.array(likeness(*prints, *prints_next), pa.float64())}


def cut(prints: tuple, start: int, stop: int | None = None) -> tuple:
    return tuple(x[start:stop] for x in prints)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex, 4
    digits a sample; empty for a text without words), near_edited, near_next. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. The next document is that of the next
    smaller doc_id; null ids come last, equal ids by a hash of their texts, repeated rows
    one after another; the last document is followed by the first, a single one by
    itself. Null text counts as empty. An empty table gives no rows; other columns are
    ignored. A very long text is held once with its edited text; its words are drawn for
    ``SLICE`` at a time.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind, part = T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType())
    doc_id = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    types = [T.LongType(), T.StringType(), T.BinaryType(), T.BinaryType(), T.DoubleType(), T.DoubleType()]
    result = [T.StructField(n, t) for n, t in zip(RESULT, types)]
    schema = T.StructType([kind, part, doc_id, T.StructField("text", T.StringType()), *result])
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("_tie")]
    dealt = (docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_tie", F.monotonically_increasing_id())
             .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text"))

    def batch(number: int, part: int, ids: pa.Array, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(ids)
        fixed = {"kind": pa.array([number] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "doc_id": ids} | columns
        empty = {"text": pa.string(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "print": pa.binary(),
                 "edited_print": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
        return pa.RecordBatch.from_arrays([fixed[f.name] if f.name in fixed else pa.nulls(n, empty[f.name]) for f in schema.fields],
                                          names=schema.names)

    quantiles = gamma_quantiles()
    logs = np.log(quantiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(quantiles, logs), None
        number = TaskContext.get().partitionId()
        for b in batches:
            for start, length in slices(b, limit=CHUNK):
                ids, texts = b.column("doc_id").slice(start, length), texts_of(b.slice(start, length))
                known = 0
                if held is None:
                    yield batch(1, number, ids[:1], {"text": texts[:1]})
                else:
                    ids, texts, known = pa.concat_arrays([held[0], ids]), pa.concat_arrays([held[1], texts]), 1
                n = len(ids) - 1
                changed = changed_texts(texts[:n], texts[1:])
                made = sampler.sign(pa.concat_arrays([texts[known:], changed]))
                prints = cut(made, 0, n + 1 - known)
                if known:
                    prints = tuple(np.concatenate(x) for x in zip(held[2], prints))
                if n:
                    yield batch(0, number, ids[:n], row_columns(texts[:n], changed, cut(prints, 0, n), cut(prints, 1), cut(made, n + 1 - known)))
                held = ids[n:], texts[n:], cut(prints, n)
        if held is not None:
            yield batch(2, number, held[0], {"text": held[1]})

    found = scratch(dealt.mapInArrow(run, schema), "fingerprints")
    # Ends of ranges: the last row of each is followed by the first row of the next one.
    first = found.where("kind = 1").select(F.col("part").alias("to"), F.col("text").alias("following"))
    ends = found.where("kind = 1").select("part", F.coalesce(
        F.lead("part").over(Window.orderBy("part")),
        F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    last = found.where("kind = 2").select("part", "doc_id", "text").join(ends, "part").join(first, "to").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(quantiles, logs)
        for b in batches:
            for start, length in slices(b, limit=CHUNK):
                c = b.slice(start, length)
                texts, following = texts_of(c), texts_of(c, "following")
                changed = changed_texts(texts, following)
                made = sampler.sign(pa.concat_arrays([texts, following, changed]))
                done = row_columns(texts, changed, cut(made, 0, length), cut(made, length, 2 * length), cut(made, 2 * length))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), *[done[n] for n in RESULT]], names=["doc_id", *RESULT])

    last = last.mapInArrow(finish, T.StructType([doc_id, *result]))
    return found.where("kind = 0").select("doc_id", *RESULT).union(last).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")
