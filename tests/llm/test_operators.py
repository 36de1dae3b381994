"""The training-data operators against brute force, on hand-made rows with every odd case."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from agora.llm import bpe, embedding_dedup, jaccard, lm, mixing, neighbours, quotation, sharding, token_counts, toxicity
from agora.llm.queries import BPE_RANKS, PIECE_MODEL
from agora.llm.shared import components

SF_SMALL = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, term string, head string, c long, size int"


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def odd_documents(seed=1):
    """Nulls, empties, copies, near copies, repeated rows, one long text, and columns named like inner ones."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["The", "of", "É x", "id<s>", "▁y", "a b"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = [text(r.randint(1, 120)) for _ in range(60)]
    near = [b + " " + r.choice(vocabulary) for b in base if len(b.split()) > 60]
    texts = [None, "", " \t\n", "one", "one two", "One  two", " lead", "trail ", "a\r\n\r\nb\x0bc", "😀 ok", "  two   gaps ",
             *base, *base[:15], *near, text(20_000), "x" * 3_000]
    rows = [(i, t, "en", [None, "", "a", "b", "z", "é"][i % 6], None) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "no id here " * 4, "en", "a", None), (None, None, None, None, None)]
    return [(*x, "k", "t", "h", 1, 2) for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i):
    return zlib.crc32(str(i).encode()) if i is not None else 0


# ---- 1


def test_shards_are_even_and_gapless(docs, none):
    rows = sharding.shard_by_bytes(docs, 8).collect()
    source = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == source
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(sizes.values()), max(r["size"] for r in rows)
    assert all(abs(sizes[s] - total / 8) <= largest for s in range(8))
    assert sharding.shard_by_bytes(none, 8).count() == 0


def test_copies_stay_in_one_shard(spark):
    rows = [(i, "text %d" % (i % 400)) for i in range(4_000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("text_crc32").agg(
        F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert got == 0


# ---- 2


def brute_links(rows, cosine):
    vectors = [(i, r[0], r[2], np.array(r[1], dtype=np.float64)) for i, r in enumerate(rows)
               if r[1] and r[2] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and any(r[1])]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = collections.Counter()
    for a, (i, _, li, x) in enumerate(vectors):
        for j, _, lj, y in vectors[a + 1:]:
            if li == lj and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    least = {}
    for i, r in enumerate(rows):
        ids = [r[0], least.get(find(i))]
        least[find(i)] = min((v for v in ids if v is not None), default=None)
    return sorted(((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("part", [2_048, 16])
def test_embedding_links_match_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", part)
    r = np.random.RandomState(3)
    centres = r.normal(size=(6, 20))
    near = [(c + r.normal(size=20) * s).tolist() for c in centres for s in (0.05, 0.2, 0.25, 0.27, 0.3) for _ in range(12)]
    rows = [(i, v, i % 2) for i, v in enumerate(near)] + [
        (900, None, 0), (901, [], 0), (902, [0.0] * 20, 0), (903, [float("nan")] * 20, 0), (904, [None] * 20, 0),
        (905, near[0], None), (906, near[0], 0), (906, near[0], 0), (907, [2 * v for v in near[0]], 0), (908, near[0][:7], 0)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit(1))
    got = sorted((tuple(x) for x in embedding_dedup.near_duplicates(df, 0.93).collect()), key=str)
    assert got == brute_links(rows, 0.93)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = components(chain).collect()
    roots = {r.node: r.root for r in got}
    assert len({roots[i] for i in range(201)}) == 1 and roots[1000] == roots[1001] != roots[0]


# ---- 3


def test_quotations_are_linked_and_left_out(spark):
    rows = [(1, 0, "user", "First line.\n\nA question  about Spark?"), (1, 1, "assistant", "> a question about spark?\nAn answer."),
            (1, 2, "user", "New topic."), (1, 3, "user", ">> A question about Spark?\n> An answer.\n\nThanks"),
            (1, 4, "user", "> never said\nso"), (2, 5, "user", "> An answer.\nother talk"), (None, 0, "user", None),
            (1, None, "user", "> New topic.\nlate"), (2, 5, "user", "> An answer.\nother talk")]
    got = quotation.reply_order(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert by[1, 1].parent_turn == 0 and by[1, 1].body == "An answer." and by[1, 1].thread_turn == 0
    assert by[1, 3].parent_turn == 1 and by[1, 3].thread_turn == 0 and by[1, 3].max_level == 2 and by[1, 3].n_linked == 2
    assert by[1, 4].parent_turn is None and by[1, 4].n_quotes == 1 and by[2, 5].parent_turn is None
    assert by[1, None].parent_turn is None and by[1, None].thread_turn is None
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [0, 1, 3, 2, 4, None]
    assert sorted(r.position for r in got if r.conv_id == 2) == [0, 1]


def test_trimmed_quotations_are_linked(spark):
    long = "Line one of it\nline two here\nline three there\nline four.\n\nSecond paragraph.\n\nThird one!"
    rows = [(1, 0, "user", long), (1, 1, "user", "> line two here\n> line three there\nlines"),
            (1, 2, "user", "> Second paragraph.\n>\n> Third one!\nparagraphs"),
            (1, 3, "user", "Title\nWe met on Monday. It rained (a lot!) all day. Then we left."),
            (1, 4, "user", "> It rained (a lot!)  all day.\na sentence"), (1, 5, "user", "> we met on Monday. It rained (a lot!)\n> all day.\nwrapped"),
            # Three have parts of a passage, and a later one all of it among others.
            (2, 0, "user", "a\nb\nx"), (2, 1, "user", "b\nc\ny"), (2, 2, "user", "a\nz"), (2, 3, "user", "q\na\nb\nc\nr"),
            (2, 4, "user", "a\nb\nc\nr\nagain"), (2, 5, "user", "> a\n> b\n> c\nso"), (2, 6, "user", "> a\n> never said\nso"),
            (2, 7, "user", "> never\n> said\nso")]
    got = quotation.reply_order(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    by = {(r.conv_id, r.turn): (r.parent_turn, r.n_linked) for r in got}
    assert [by[1, i] for i in (1, 2, 4, 5)] == [(0, 1), (0, 1), (3, 1), (3, 1)]
    assert [by[2, i] for i in (5, 6, 7)] == [(3, 1), (0, 1), (None, 0)]


def test_originals_have_most_units_of_a_passage(spark):
    r = random.Random(4)
    rows = [(c, t, "user", "\n".join(r.choices("abcdefgh", [9, 5, 3, 2, 1, 1, 1, 1], k=3))) for c in range(20) for t in range(12)]
    rows += [(c, 12 + t, "user", "\n".join("> " + x for x in r.choices("abcdefghi", k=4))) for c in range(20) for t in range(3)]
    got = quotation.reply_order(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    lines = {(c, t): text.split("\n") for c, t, _, text in rows}
    for g in (g for g in got if g.turn >= 12):
        quoted = {x[2:] for x in lines[g.conv_id, g.turn]}
        found = [(-len(quoted & set(lines[g.conv_id, t])), t) for t in range(12)]
        assert g.parent_turn == (min(found)[1] if min(found)[0] else None)


# ---- 4


@pytest.fixture(scope="module")
def unseen(spark):
    """(flag, label) of labelled documents that the chain was not fitted on."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rest = labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("y"))
    found = toxicity.toxicity(docs, labels.where("doc_id % 3 <> 0")).join(rest, "doc_id")
    return [(r.toxic, bool(r.y)) for r in found.select("toxic", "y").collect()]


def test_toxicity_on_labels_not_seen(unseen):
    assert sum(f == y for f, y in unseen) >= 0.9 * len(unseen)


def test_toxicity_finds_most_toxic_documents_not_seen(unseen):
    # Of 147 toxic documents, 10 share no form of a toxic word with any other.
    assert sum(f for f, y in unseen if y) >= 0.9 * sum(y for _, y in unseen)
    assert sum(f for f, y in unseen if not y) <= 0.01 * len(unseen)


def test_toxicity_counts_forms_of_a_word(spark):
    r = random.Random(3)
    plain = lambda: ["w%d" % r.randint(0, 60) for _ in range(30)]
    rows = []
    for i in range(400):
        w = plain()
        if i % 8 == 0:
            w[5] = "schimpf" + "".join(r.choice("aeiourst") for _ in range(5))
        rows.append((i, " ".join(w), int(i % 8 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.toxicity(table, table.where("doc_id < 240").select("doc_id", "toxic")).where("doc_id >= 240").collect()
    assert all(f.toxic == (f.doc_id % 8 == 0) for f in found) and len(found) == 160


def test_toxicity_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (11, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count() and got.where("toxic IS NULL").count() == 0
    kept = toxicity.clean_documents(docs, docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.toxicity(none, labels).count() == 0


def test_chain_feeds_earlier_probabilities():
    r = np.random.RandomState(0)
    n, width = 400, 30
    rows, cols = np.nonzero(r.rand(n, width) < 0.3)
    has = np.zeros((n, width), bool)
    has[rows, cols] = True
    labels = {"a": has[:, 0].astype(float), "b": (has[:, 0] & has[:, 1]).astype(float)}
    models = toxicity.fit_chain(toxicity.Sparse(rows, cols, np.ones(len(rows)), n, width), labels, np.arange(n) % toxicity.FOLDS)
    assert [len(m) for m in models] == [width + 1, width + 2] and models[1][width] > 0


def test_folds_do_not_copy_a_wide_table(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 2)
    r = np.random.RandomState(0)
    n, width, each = 400, 4 * toxicity.FEATURES, 1_000
    rows, cols = np.repeat(np.arange(n, dtype=np.int32), each), r.randint(0, width, n * each).astype(np.int32)
    x = toxicity.Sparse(rows, cols, np.ones(n * each), n, width)
    tracemalloc.start()
    toxicity.fit_chain(x, {"a": (np.arange(n) % 3 == 0).astype(float)}, np.arange(n) % toxicity.FOLDS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Room for products of the whole table; a copy for each fold took 1.75 times the table.
    assert peak < 1.4 * (rows.nbytes + cols.nbytes + x.values.nbytes), peak


# ---- 5


def test_class_model_counts_and_scores(docs, none):
    got = lm.score_documents(docs).collect()
    source = docs.collect()
    counts = collections.Counter()
    for d in source:
        if crc(d.doc_id) % 7 != 2:
            counts.update([*words(d.text), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d in source:
        tokens = [*words(d.text), "\n"]
        base = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        want[d.doc_id, crc(d.doc_id) % 7 == 2, len(tokens), sum(t in counts for t in tokens), total, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score_documents(none).count() == 0


def clustered_corpus(spark, n=400):
    """Texts of a noun after each article and a verb after each noun, all with rare forms of their own."""
    r = random.Random(5)
    nouns, verbs = ["n%dxyz" % i for i in range(150)], ["v%dxyz" % i for i in range(150)]
    rows = [(i, " ".join(w for _ in range(r.randint(1, 12)) for w in ("the", r.choice(nouns), "does", r.choice(verbs)))) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "the n1xyz"), (n, None), (n + 1, ""), (n + 2, "only unseen words")], "doc_id long, text string")


def test_class_model_probabilities(spark, docs, monkeypatch):
    for table, core in ((docs, lm.CORE), (clustered_corpus(spark), 0.05)):
        monkeypatch.setattr(lm, "CORE", core)
        train = table.select("text")
        model, classes = lm.train_classes(train, lm.count_terms(train, lm.with_end).cache())
        assert np.allclose((10.0 ** model.transitions).sum(1), 1.0)
        assert all(x == sorted(x) for x in model.likelihoods)
        # Every word seen often enough is clustered; emissions of such a class add up to 1, others leave a share to unseen words.
        want = collections.Counter(t for d in table.collect() for t in (*words(d.text), lm.END))
        got = {r.term: (r["class"], r.n) for r in classes.collect()}
        assert {t: n for t, (_, n) in got.items()} == want and classes.count() == len(want)
        sums = collections.Counter()
        for term, (c, n) in got.items():
            assert c == model.end if term == lm.END else (c < lm.CLASSES) == (n >= lm.LEAST)
            sums[c] += (n + (lm.CLASSES <= c < model.end)) / 10.0 ** model.emissions[c]
        assert all(abs(v - 1) < 1e-9 for v in sums.values())


def test_a_word_moves_to_the_class_of_the_highest_likelihood():
    r = np.random.RandomState(1)
    words = 120
    pairs = r.poisson(0.2 + 3.0 * ((np.arange(words)[:, None] % 3 + 1) % 3 == np.arange(words) % 3)).astype(float)
    classes = r.randint(0, lm.CLASSES, words)

    def matrix(classes):
        g = np.zeros((lm.TOTAL, lm.TOTAL))
        np.add.at(g, (classes[:, None].repeat(words, 1), classes[None].repeat(words, 0)), pairs)
        return g

    for w in range(0, words, 8):
        others = np.arange(words) != w
        right = np.bincount(classes[others], weights=pairs[w, others], minlength=lm.TOTAL)
        left = np.bincount(classes[others], weights=pairs[others, w], minlength=lm.TOTAL)
        g = matrix(classes)
        g[classes[w]] -= right
        g[:, classes[w]] -= left
        g[classes[w], classes[w]] -= pairs[w, w]
        values = [lm._likelihood(matrix(np.where(others, classes, c))) for c in range(lm.CLASSES)]
        assert values[lm._best_class(g, right, left, pairs[w, w])] >= max(values) - 1e-6


def test_rare_words_find_their_class(spark, monkeypatch):
    monkeypatch.setattr(lm, "CORE", 0.05)
    train = clustered_corpus(spark).select("text")
    model, classes = lm.train_classes(train, lm.count_terms(train, lm.with_end).cache())
    assert set(model.core) == {"the", "does"}
    found = {r.term: r["class"] for r in classes.collect() if r.n >= lm.LEAST}
    nouns, verbs = {c for t, c in found.items() if t.startswith("n")}, {c for t, c in found.items() if t.startswith("v")}
    assert nouns and verbs and not nouns & verbs


@pytest.mark.parametrize("heavy", [1e-2, 1.1])
def test_class_model_scores_by_brute_force(spark, monkeypatch, heavy):
    """Some words are looked up in tasks and some joined, or all are joined."""
    monkeypatch.setattr(lm, "CORE", 0.05)
    monkeypatch.setattr("agora.llm.terms.HEAVY", heavy)
    table = clustered_corpus(spark).cache()
    source = table.collect()
    learned = [d for d in source if d.doc_id is None or crc(d.doc_id) % 7 != 2]
    train = spark.createDataFrame(learned, table.schema).select("text")
    model, classes = lm.train_classes(train, lm.count_terms(train, lm.with_end).cache())
    by_term = {r.term: (r["class"], r.n) for r in classes.collect()}
    class_of = lambda t: by_term.get(t, (lm.ending_class_of(t), 0))[0]
    before_of = lambda t: model.end if t == lm.END else model.core.get(t, lm.ending_class_of(t))
    tokens = [[*words(d.text), lm.END] for d in learned]
    moves = collections.Counter((before_of(a), class_of(b)) for t in tokens for a, b in zip([lm.END, *t], t))
    into, out_of, sizes, kinds = (collections.Counter() for _ in range(4))
    for (h, c), n in moves.items():
        into[c] += n
        out_of[h] += n
    for t, (c, n) in by_term.items():
        sizes[c] += n
        kinds[c] += 1
    total = sum(sizes.values())

    def score(text):
        value, last = 0.0, lm.END
        for t in [*words(text), lm.END]:
            c, n = class_of(t), by_term.get(t, (0, 0))[1]
            share = (into[c] + lm.ALPHA) / (total + lm.ALPHA * lm.TOTAL)
            value += math.log10((moves[before_of(last), c] + lm.PRIOR * share) / (out_of[before_of(last)] + lm.PRIOR))
            if t != lm.END:
                value += math.log10(n / sizes[c] if c < lm.CLASSES else (n + 1) / (max(1, sizes[c]) + kinds[c]))
            last = t
        return value

    want = collections.Counter((d.doc_id, round(score(d.text), 6)) for d in source)
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in lm.score_documents(table).collect()) == want


def test_class_model_without_training_rows(spark):
    held = [i for i in range(100) if crc(i) % 7 == 2][:3]
    table = spark.createDataFrame(list(zip(held, ["a b c", None, "x " * 5])), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(table).collect()}
    # Nothing is known, so every class is as likely.
    assert [got[i].n_tokens for i in held] == [4, 1, 6]
    assert all(r.train_tokens == r.n_known == 0 and r.base_score == 0 and abs(r.perplexity - lm.TOTAL) < 1e-6 for r in got.values())


# ---- 6


def test_bpe_matches_the_library(docs, none):
    import tiktoken
    path = public_tokenizers.path(BPE_RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()
    want = collections.Counter()
    for d in docs.collect():
        ids = np.array(library.encode_ordinary(d.text or ""), "<u4").tobytes()
        want[d.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [b"k%d" % i for i in range(5_000)]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h, keys)) == list(range(5_000))


# ---- 7


def test_neighbours_against_brute_force(spark):
    r = np.random.RandomState(5)
    x = r.normal(size=(3_000, 16)).astype(np.float32)
    x[1000:1040] = x[1000]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))] + [(-100, [0.0] * 16), (None, [1.0] * 16), (99_000, None), (98_000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(0))
    got = neighbours.nearest_neighbours(df).orderBy("query_id", "rank").collect()
    hits = 0
    for q in range(0, 3_000, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        own = [g for g in got if g.query_id == q]
        assert [g.rank for g in own] == list(range(1, 11)) and all(abs(d[g.vec_id] - g.score) < 1e-12 for g in own)
        hits += sum(g.score <= np.sort(d)[9] for g in own)
    assert hits >= 0.9 * 300
    assert [g.vec_id for g in got if g.query_id == 1000] == list(range(1001, 1011))


def recall(spark, x, every=100):
    """Share of the 10 nearest of every 100th row that are found."""
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for g in neighbours.nearest_neighbours(df, 10, every).collect():
        got[g.query_id].append(g)
    hits = []
    for q in range(0, len(x), every):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        assert len(got[q]) == 10 and all(abs(d[g.vec_id] - g.score) <= 1e-12 * max(1.0, g.score) for g in got[q])
        hits += [g.score <= np.sort(d)[9] for g in got[q]]
    return np.mean(hits)


@pytest.mark.parametrize("times", [100, 1_000, 1e9])
def test_neighbours_beside_a_long_vector(spark, times):
    x = np.random.RandomState(6).normal(size=(2_001, 16)).astype(np.float32)
    x[7] *= times
    assert recall(spark, x) >= 0.9


def test_neighbours_in_groups_of_near_copies(spark):
    r = np.random.RandomState(8)
    x = np.repeat(r.normal(size=(4, 16)), 500, axis=0) + 1e-4 * r.normal(size=(2_000, 16))
    assert recall(spark, x[r.permutation(2_000)].astype(np.float32)) >= 0.9


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(g.rank, g.vec_id, round(g.score, 6)) for g in neighbours.nearest_neighbours(df).orderBy("rank").collect()]
    assert got == [(1, 1, 0.0), (2, 2, 1.414214)]
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0


def test_neighbours_of_several_lengths(spark):
    r = np.random.RandomState(9)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)] + [(1_000 + i, r.normal(size=4).tolist()) for i in range(101)]
    rows += [(2_000 + i, r.normal(size=3).tolist()) for i in range(4)] + [(3_000, r.normal(size=2_000).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("sides", F.lit(None).cast("int"))
    got = collections.defaultdict(list)
    for g in neighbours.nearest_neighbours(df).orderBy("rank").collect():
        got[g.query_id].append((g.vec_id, round(g.score, 9)))
    hits = []
    for q, x in rows:
        if q % 100 == 0:
            want = sorted((round(math.dist(x, y), 9), i) for i, y in rows if i != q and len(y) == len(x))[:10]
            assert len(got[q]) == len(want)
            hits += [s <= want[-1][0] for _, s in got[q]]
    assert [i for i, _ in got[2_000]] == [i for _, i in sorted((math.dist(rows[401][1], y), i) for i, y in rows[402:405])]
    assert not got[3_000] and np.mean(hits) >= 0.9


# ---- 8


def brute_jaccard(source, n, percent):
    sets = []
    for d in source:
        w = words(d.text)
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    least = {}
    for i, d in enumerate(source):
        least[find(i)] = min((v for v in (d.doc_id, least.get(find(i))) if v is not None), default=None)
    return collections.Counter((d.doc_id, len(sets[i]), least[find(i)]) for i, d in enumerate(source))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_components_match_brute_force(docs, none, n, percent):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, n, percent).collect())
    assert got == brute_jaccard(docs.collect(), n, percent)
    assert jaccard.jaccard_components(none, n, percent).count() == 0


def test_many_near_copies_are_one_component(spark):
    r = random.Random(2)
    base = ["b%d" % i for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = "e%d" % r.randrange(10_000)
        rows.append(Row(doc_id=i, text=" ".join(w)))
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows), 3, 90).collect())
    assert got == brute_jaccard(rows, 3, 90)


@pytest.mark.parametrize("n,percent,edits", [(5, 80, 14)])
def test_near_copies_that_rarely_link_are_not_expanded_into_pairs(spark, monkeypatch, n, percent, edits):
    r = random.Random(7)
    base = ["b%d" % i for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
        rows.append(Row(doc_id=i, text=" ".join(w)))
    pairs, checked = [], jaccard._checked

    def counted(docs, found, *more):
        pairs.append(found.count())
        return checked(docs, found, *more)

    monkeypatch.setattr(jaccard, "_checked", counted)
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows), n, percent).collect())
    assert got == brute_jaccard(rows, n, percent)
    assert sum(pairs) < len(rows), pairs


def test_sets_to_verify_are_made_from_bounded_texts(spark, monkeypatch):
    chunks, most = jaccard.keyed_chunks, jaccard.PREFIX_BYTES

    def bounded(batches, column="text", limit=1 << 40):
        assert limit <= most
        return chunks(batches, column, limit)

    monkeypatch.setattr(jaccard, "keyed_chunks", bounded)
    docs = spark.createDataFrame([Row(doc_id=1, text="a b c d"), Row(doc_id=2, text="e")])
    heads = jaccard.class_rows(docs, 3).select("c", "size", "doc_id")
    assert sorted((x.size, len(x.grams)) for x in jaccard._class_sets(docs, heads, 3).collect()) == [(1, 8), (2, 16)]


def test_one_of_each_component_stays(docs):
    kept = jaccard.one_per_component(docs, 5, 80)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute_jaccard(docs.collect(), 5, 80) if i == c and i is not None}
    assert {r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()} == want


# ---- 9


def test_mix_meets_targets(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in rows if r.doc_id is not None) == sorted(
        (d.doc_id, len(words(d.text))) for d in docs.collect() if d.doc_id is not None)
    assert all(r.taken == r.copies * r["size"] and r.taken <= 3 * r["size"] for r in rows)
    sizes = {r.source: r.source_size for r in rows}
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else share * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) for r in rows)
    assert [tuple(r) for r in sorted(mixing.mix_sources(docs).collect(), key=str)] == [tuple(r) for r in sorted(rows, key=str)]
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


# ---- 10


def test_token_counts_match_the_library(docs, none):
    import sentencepiece
    path = public_tokenizers.path(PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(docs, path).collect()
    want = collections.Counter()
    for d in docs.collect():
        n = len(library.encode(d.text or ""))
        want[d.doc_id, len((d.text or "").encode()), n, n > 4096] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(none, path).count() == 0


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "mix", "encode"]
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.count() > 0 and "ids" in got.columns
