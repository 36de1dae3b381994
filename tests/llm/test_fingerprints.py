"""Operator 12: exact columns against Python, likeness against the exact generalised Jaccard similarity."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, SF_SMALL, odd_documents, words

from agora.llm import fingerprints


def jaccard(a, b):
    a, b = collections.Counter(words(a)), collections.Counter(words(b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def edited(text, following):
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


@pytest.fixture(scope="module")
def sampler():
    q = fingerprints.gamma_quantiles()
    return fingerprints.Sampler(q, np.log(q))


def test_rows_against_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(7)
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    errors, prints = [], {}
    for r, after in zip(rows, rows[1:] + rows[:1]):
        g, text, following = got[r.doc_id], r.text or "", after.text or ""
        assert g.n_chars == len(text)
        assert g.edited_sha256 == hashlib.sha256(edited(text, following).encode()).hexdigest()
        assert prints.setdefault(text, g.fingerprint) == g.fingerprint
        errors += [abs(g.near_edited - jaccard(text, edited(text, following))), abs(g.near_next - jaccard(text, following))]
        assert 0 <= g.near_next <= 1 and 0 <= g.near_edited <= 1
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


def test_samples_collide_as_often_as_the_similarity(sampler):
    """Over many made-up pairs with counts, the mean error is that of chance."""
    r = np.random.default_rng(3)
    a, b, true = [], [], []
    for i in range(300):
        shared, own = r.integers(0, 30), r.integers(1, 30)
        x = [f"p{i}w{w}" for w in range(shared) for _ in range(r.integers(1, 9))]
        y = [f"p{i}w{w}" for w in range(shared) for _ in range(r.integers(1, 9))] + [f"p{i}y{w}" for w in range(own)]
        a.append(" ".join(x) or "z")
        b.append(" ".join(y))
        true.append(jaccard(a[-1], b[-1]))
    near = fingerprints.likeness(*sampler.sign(pa.array(a)), *sampler.sign(pa.array(b)))
    assert abs(np.mean(near - true)) < 0.01
    assert np.mean(np.abs(near - true)) < 0.045


def test_same_text_same_print_whatever_stands_beside_it(sampler):
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(r.choice(vocabulary, n)) for n in (1, 2, 5, 50, 400, 3_000, 40_000)]
    together, _ = sampler.sign(pa.array(texts))
    again, _ = sampler.sign(pa.array(texts[::-1]))
    q = fingerprints.gamma_quantiles()
    for i, t in enumerate(texts):
        alone, _ = fingerprints.Sampler(q, np.log(q)).sign(pa.array([t]))
        assert (alone[0] == together[i]).all() and (again[len(texts) - 1 - i] == together[i]).all()


def test_odd_rows(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = fingerprints.fingerprint_documents(df).collect()
    assert len(got) == len(rows)
    source = collections.Counter((r[0], len(r[1] or "")) for r in rows)
    assert collections.Counter((g.doc_id, g.n_chars) for g in got) == source
    prints = collections.defaultdict(set)
    text_of = {r[0]: r[1] for r in rows if r[0] not in (None, rows[12][0])}
    for g in got:
        if g.doc_id in text_of:
            prints[text_of[g.doc_id] or ""].add(g.fingerprint)
            assert (g.fingerprint == "") == (not words(text_of[g.doc_id]))
            assert len(g.fingerprint) in (0, 4 * fingerprints.SAMPLES)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_single_row_follows_itself_and_rows_of_one_id_are_dealt_out(spark):
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    same = spark.range(3_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one text here").alias("text"))
    got = fingerprints.fingerprint_documents(same)
    assert got.count() == 3_000 and got.where("near_next < 1").count() == 0 and got.select("fingerprint").distinct().count() == 1
