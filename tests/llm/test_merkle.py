"""Operator 11 against a Merkle tree built by hand in Python."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, odd_documents

from agora.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Root, and for each leaf its (left, right) joined siblings by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for leaf, n in enumerate(at):
            run = n // 16 * 16
            paths[leaf].append(("".join(level[run:n]), "".join(level[n + 1:run + 16])))
        at = [n // 16 for n in at]
        level = [sha(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def expected(rows):
    """Counter of result rows for (doc_id, text, lang, source, n_chars) rows."""
    by = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        digest = lambda t: sha(field(doc_id), field(source), field(lang), field(n_chars), field(t))  # noqa: B023, E731
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        low = text.translate({i: i + 32 for i in range(65, 91)}) if text is not None else None
        leaf = digest(text)
        by[source].append((doc_id is not None, doc_id or 0, leaf, digest(low) if hit else leaf, doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    roots, out = [], []
    for s in sources:
        by[s].sort()
        roots.append(tree([x[2] for x in by[s]]))
    root, above = tree([r for r, _ in roots])
    for s, (subroot, paths), up in zip(sources, roots, above):
        for (_, _, leaf, start, doc_id), path in zip(by[s], paths):
            h = start
            for left, right in path + up:
                h = sha(left, h, right)
            proof = sha(*[left + right for left, right in path + up])
            out.append((doc_id, leaf, subroot, root, proof, h, h == root))
    return collections.Counter(out)


def got(df):
    return collections.Counter(tuple(r) for r in merkle.manifest(df, merkle.one_in_five()).drop("path").collect())


def test_odd_rows(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df) == expected([r[:5] for r in rows])


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 272, 273, 4_400])
def test_sizes_of_a_source(spark, n):
    """A lone leaf is its root; a last run of one is hashed; more leaves than a block make further rounds."""
    rows = [(i * 3, f"Text {i}", "en", "only", None) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert got(df) == expected(rows)


def test_many_sources_and_a_hot_one(spark):
    rows = [(i, f"T{i}", None, "hot" if i % 3 == 0 else f"s{i}", i) for i in range(1_500)]
    rows += [(None, "Same Row", "en", "hot", 1)] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert got(df) == expected(rows)


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), merkle.one_in_five()).count() == 0


def test_path_gives_the_root(spark):
    df = spark.createDataFrame([(i, "x", "en", "a", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.manifest(df, F.lit(False))
    assert found.where(merkle.folded(F.col("leaf")) != F.col("root")).count() == 0
    assert found.where("not verified").count() == 0
