"""Operator 4: toxicity by a classifier chain.

Categories are predicted one after another: the linear model of a category sees the
words of the text, their beginnings (so that forms of a word that training never saw
count too) and the probabilities of all earlier categories. In training, those
probabilities are out-of-fold predictions, so later models learn from probabilities of
the quality that they meet on new texts. Fitting runs in one task on a bounded sample
of labelled rows; scoring reads every whole text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import encoded, flat_tokens, keyed_chunks, packed, prepare, texts_of, to_arrow, unpacked

#: Labelled rows that the chain is fitted on at most, drawn by a hash of the id.
SAMPLE = 8_000
#: Folds of the out-of-fold predictions.
FOLDS = 4
#: Documents of the sample in which a word or beginning must occur to be a feature.
LEAST_DOCS = 5
#: Lengths of the beginnings of words that are features, in characters.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Features that a model is fitted on: those that part its training rows' classes best, one by one.
FEATURES = 3_000
#: Strength of the L1 and L2 penalties, and steps of the solver.
L1, L2, STEPS = 2e-4, 1e-4, 150
#: Probability of the last category from which a document is toxic.
THRESHOLD = 0.5
#: Marks that are cut from both ends of a word.
MARKS = ".,;:!?\"'()[]{}<>*_-|/\\…«»„“”‘’¡¿"

# Words that put a toxic-labelled document into a category of the chain.
CATEGORY_WORDS = {
    "insult": ("clown", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "stupid"),
    "contempt": ("disgusting", "filth", "garbage", "pathetic", "scum", "trash", "vermin", "worthless"),
}
#: Order of the chain; the last category is the label itself.
CHAIN = (*CATEGORY_WORDS, "toxic")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each key's counts."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found))


def value_of(counts: np.ndarray) -> np.ndarray:
    """A feature's value in a text, by its occurrences there."""
    return np.log2(1.0 + counts)


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(rows, codes, counts, words): each text's distinct lower-case words without marks at their ends."""
    rows, values = flat_tokens(pc.ascii_split_whitespace(pc.utf8_lower(texts)))
    codes, words = encoded(values)
    again, words = encoded(pc.utf8_trim(words.cast(pa.string()), characters=MARKS))
    codes = again[codes] if len(codes) else codes
    pairs, counts = np.unique(rows * max(1, len(words)) + codes, return_counts=True)
    rows, codes = np.divmod(pairs, max(1, len(words)))
    return rows, codes, counts, words


def beginnings(words: pa.Array, length: int) -> pa.Array:
    """Each word's first ``length`` characters and a star, null for shorter words; no word ends in a star (``MARKS``)."""
    cut = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, length), "*", "")
    return pc.if_else(pc.greater_equal(pc.utf8_length(words), length), cut, pa.scalar(None, pa.string()))


def forms(words: pa.Array) -> Iterator[pa.Array]:
    """The words, then their beginnings of every length."""
    yield words
    for length in BEGINNINGS:
        yield beginnings(words, length)


def features_of(texts: pa.Array, least: int) -> tuple[Sparse, pa.Array]:
    """Values of the words and beginnings that occur in at least ``least`` of the texts, and those words and beginnings."""
    rows, codes, counts, words = word_counts(texts)
    all_rows, all_codes, all_values, names, start = [], [], [], [pa.array([], pa.string())], 0
    for form in forms(words):
        has = form.is_valid().to_numpy(zero_copy_only=False)
        of, found = encoded(form.filter(pa.array(has)))
        at = np.full(len(words), -1)
        at[has] = of
        mask = at[codes] >= 0
        pairs, n = summed(rows[mask] * max(1, len(found)) + at[codes[mask]], counts[mask])
        r, f = np.divmod(pairs, max(1, len(found)))
        kept = np.bincount(f, minlength=len(found)) >= least
        held = kept[f]
        # A sample's rows and features fit 32 bits; the table is the largest thing that the fitting task holds.
        all_rows.append(r[held].astype(np.int32))
        all_codes.append((start + np.cumsum(kept) - 1).astype(np.int32)[f[held]])
        all_values.append(value_of(n[held]))
        names.append(found.filter(pa.array(kept)).cast(pa.string()))
        start += int(kept.sum())
    return Sparse(np.concatenate(all_rows), np.concatenate(all_codes), np.concatenate(all_values), len(texts), start), pa.concat_arrays(names)


@dataclass
class Sparse:
    """Rows of features as flat indices and values."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    n: int
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols] * self.values, minlength=self.n)

    def dot_t(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=r[self.rows] * self.values, minlength=self.width)

    def squared_t(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=r[self.rows] * self.values ** 2, minlength=self.width)

    def take(self, mask: np.ndarray) -> Sparse:
        at = (np.cumsum(mask) - 1).astype(self.rows.dtype)
        held = mask[self.rows]
        return Sparse(at[self.rows[held]], self.cols[held], self.values[held], int(mask.sum()), self.width)

    def only(self, cols: np.ndarray) -> Sparse:
        at = np.full(self.width, -1, self.cols.dtype)
        at[cols] = np.arange(len(cols))
        held = (at >= 0)[self.cols]
        return Sparse(self.rows[held], at[self.cols[held]], self.values[held], self.n, len(cols))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Sparse, dense: np.ndarray, y: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """Logistic regression with L1 and L2 penalties by accelerated proximal steps, on the rows of the mask ``learnt``.

    Classes weigh the same. Of wide ``x``, only the ``FEATURES`` columns take part that
    part the classes best by themselves. Returns weights of ``x``, then of dense features, then the bias.
    """
    known = y[learnt]
    if not len(known) or known.min() == known.max():
        w = np.zeros(x.width + dense.shape[1] + 1)
        w[-1] = -6.0 if not len(known) or known.max() == 0 else 6.0
        return w
    if x.width > FEATURES:
        # Rows that are not learnt from weigh nothing here, so that no fold needs a copy of the wide table.
        share = np.where(learnt, np.where(y == 1, 1 / known.sum(), 1 / (1 - known).sum()), 0.0)
        score = np.abs(x.dot_t(np.where(y == 1, share, -share))) / np.sqrt(np.maximum(x.squared_t(share * share), 1e-300))
        best = np.sort(np.argsort(-score, kind="stable")[:FEATURES])
        found = fit_linear(x.only(best), dense, y, learnt)
        w = np.zeros(x.width)
        w[best] = found[:FEATURES]
        return np.concatenate([w, found[FEATURES:]])
    x, dense, y = x.take(learnt), dense[learnt], known
    d, m = x.width, dense.shape[1]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / x.n
    # Bound of the curvature, by power iteration.
    v = np.ones(d + m + 1)
    for _ in range(12):
        u = x.dot(v[:d]) + dense @ v[d:-1] + v[-1]
        r = weight * u
        v = np.concatenate([x.dot_t(r), dense.T @ r, [r.sum()]])
        size = np.linalg.norm(v)
        v /= size
    step = 1.0 / (0.25 * size * 1.2 + L2)
    w = z = np.zeros(d + m + 1)
    t = 1.0
    for _ in range(STEPS):
        r = weight * (sigmoid(x.dot(z[:d]) + dense @ z[d:-1] + z[-1]) - y)
        new = z - step * (np.concatenate([x.dot_t(r), dense.T @ r, [r.sum()]]) + L2 * np.append(z[:-1], 0.0))
        new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * L1, 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def fit_chain(x: Sparse, labels: dict[str, np.ndarray], folds: np.ndarray) -> list[np.ndarray]:
    """Weights of each category's model, in the order of ``labels``."""
    models, earlier = [], np.zeros((x.n, 0))
    for y in labels.values():
        models.append(fit_linear(x, earlier, y, np.ones(x.n, dtype=bool)))
        out = np.zeros(x.n)
        for k in range(FOLDS):
            test = folds == k
            if test.any():
                w = fit_linear(x, earlier, y, ~test)
                used = np.flatnonzero(w[:x.width])
                out[test] = sigmoid(x.only(used).dot(w[used])[test] + earlier[test] @ w[x.width:-1] + w[-1])
        earlier = np.column_stack([earlier, out])
    return models


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """The sample's rows (doc order by hash) to one row per word that has a weight, and one for the rest."""
    group = group.sort_values(["h", "doc_id"]).reset_index(drop=True)
    texts = pa.array(group["text"].fillna(""), pa.string())
    x, names = features_of(texts, min(LEAST_DOCS, max(1, len(group) // 50)))
    rows, codes, _, words = word_counts(texts)
    toxic = group["toxic"].to_numpy().astype(float)
    labels = {}
    for name, listed in CATEGORY_WORDS.items():
        inside = pc.index_in(words, value_set=pa.array(listed, pa.string())).is_valid().to_numpy(zero_copy_only=False)
        has = np.zeros(len(group), dtype=bool)
        has[rows[inside[codes]] if len(codes) else []] = True
        labels[name] = toxic * has
    labels["toxic"] = toxic
    models = fit_chain(x, labels, np.arange(len(group)) % FOLDS)
    used = np.flatnonzero(np.any([m[:x.width] != 0 for m in models], axis=0)) if x.width else np.zeros(0, np.int64)
    out = {"word": [*names.take(pa.array(used)).to_pylist(), None],
           "weights": [*[[float(m[j]) for m in models] for j in used],
                       [float(v) for m in models for v in m[x.width:]]]}
    return pd.DataFrame(out)


def train_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pa.Table:
    """(word or beginning, weights by category), and a row without word: each model's weights of earlier categories and bias.

    The sample is the ``sample`` labelled documents of smallest id hash, a bound on
    rows that does not depend on the table. The model has ``FEATURES`` rows
    per category at most.
    """
    named = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample))
    # SAMPLE rows at most; repeated documents of one id count once.
    rows = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id").groupBy("doc_id", "h", "toxic").agg(
        F.max("text").alias("text"))
    # SAMPLE rows at most, so one task may hold them.
    model = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit, "word string, weights array<double>")
    return to_arrow(model)


def score_toxicity(docs: DataFrame, model: pa.Table, name: str = "_toxicity") -> DataFrame:
    """``docs`` with a list ``name`` of a probability for each category of the chain.

    Null and empty texts have no words and get the probabilities of the biases. All
    columns and rows are kept as they are, nulls and repeated rows too.
    """
    prepare(docs.sparkSession)
    rest = next((r["weights"] for r in model.to_pylist() if r["word"] is None), None)
    words = model.filter(pc.is_valid(model["word"]))
    sent = docs.sparkSession.sparkContext.broadcast(packed(words))

    def probabilities(texts: pa.Array) -> np.ndarray:
        known = unpacked(sent.value)
        out = np.zeros((len(texts), len(CHAIN)))
        if rest is None:
            return out
        weights = np.array(known["weights"].to_pylist()).reshape(-1, len(CHAIN))
        rows, codes, counts, found = word_counts(texts)
        value_set = known["word"].combine_chunks()
        pairs, n = [np.zeros(0, np.int64)], [np.zeros(0)]
        for form in forms(found):
            at = pc.fill_null(pc.index_in(form, value_set=value_set, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
            at = at.astype(np.int64)[codes]
            pairs.append(rows[at >= 0] * len(value_set) + at[at >= 0])
            n.append(counts[at >= 0])
        pairs, n = summed(np.concatenate(pairs), np.concatenate(n))
        rows, at = np.divmod(pairs, max(1, len(value_set)))
        values = value_of(n)
        place = 0
        for k in range(len(CHAIN)):
            z = np.bincount(rows, weights=weights[at, k] * values, minlength=len(texts)) if len(at) else np.zeros(len(texts))
            # Weights of the earlier categories, then the bias.
            z = z + out[:, :k] @ np.array(rest[place:place + k]) + rest[place + k]
            place += k + 1
            out[:, k] = sigmoid(z)
        return out

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in keyed_chunks(batches):
            p = probabilities(texts_of(part))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(CHAIN)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*names, name])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, a probability p_<category> for each of the chain, toxic.

    A document is toxic if the probability of the chain's last category is at least
    ``threshold``. Without any labelled row no document is toxic. Empty tables give no
    rows; null ids stay null; repeated rows are scored each.
    """
    scored = score_toxicity(docs.select("doc_id", "text"), train_chain(docs, labels))
    return scored.select("doc_id", *[F.col("_toxicity")[k].alias(f"p_{c}") for k, c in enumerate(CHAIN)],
                         (F.col("_toxicity")[len(CHAIN) - 1] >= threshold).alias("toxic"))


def clean_documents(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    scored = score_toxicity(docs, train_chain(all_docs, labels), name)
    return scored.where(F.col(name)[len(CHAIN) - 1] < threshold).drop(name)
