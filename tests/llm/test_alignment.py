"""Operator 13 against the two libraries and a plain count of overlapping tokens."""

import collections
import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_operators import SCHEMA, odd_documents

from agora.llm import alignment
from agora.llm.queries import BPE_FILE, PIECE_MODEL

PATHS = public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, public_tokenizers.path(PIECE_MODEL)
ODD = ["a\nb\n\n c \n", "\n", " \n \n", "tab\tnul\x00bell\x07", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ sign", "naïve café 東京 한국어 😀😀", "x" * 500,
       "a" + " " * 300 + "b", "\r\n\r\n", "́́", "'s 're I'll", "123456 7.8,9", "‘quote’ — dash", "  lead", "trail  ", "﷽ ﬁ ①"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def expected(rows, libraries):
    """Result rows by walking over both token sequences."""
    a, b = libraries
    at = alignment.byte_characters()
    vocab = {i: bytes(at[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in at for c in t)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        links, n_groups, written, ids_a, ids_b = [], 0, "", [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if not b"".join(vocab[i] for i in ids_a) == b"".join(map(piece, ids_b)) == (" " + text).encode():
                ids_a, ids_b = [], []
        ends_a, ends_b = np.cumsum([len(vocab[i]) for i in ids_a]).tolist(), np.cumsum([len(piece(i)) for i in ids_b]).tolist()
        i = j = first_i = first_j = 0
        groups = []
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, ids_a[first_i:i])) + "|" + ",".join(map(str, ids_b[first_j:j])))
                first_i, first_j = i, j
        n_groups = len(groups)
        written = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        counts.update(links)
        docs.append((doc_id, len(ids_a), len(ids_b), n_groups, links, written))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return collections.Counter((d, n_a, n_b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), w)
                               for d, n_a, n_b, g, links, w in docs)


def got(df):
    return collections.Counter(tuple(r) for r in alignment.align_documents(df, *PATHS).collect())


def test_odd_rows(spark, libraries):
    rows = [*odd_documents(), *[(1_000 + i, t, "en", "a", None, "k", "t", "h", 1, 2) for i, t in enumerate(ODD)]]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == expected([r[:2] for r in rows], libraries)


def test_many_runs_blocks_and_slices(spark, libraries, monkeypatch):
    """Small limits: several runs a task, several blocks a run, several slices a partition, one hot pair."""
    monkeypatch.setattr(alignment, "RUN_LINKS", 3_000)
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 40)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(alignment, "CHUNK", 4_000)
    rows = [(i, " ".join(["the"] * (i % 50) + [f"word{i % 97} of {i}"] * 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == expected(rows, libraries)


def test_no_tokens_at_all(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == collections.Counter()
    assert got(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")) == collections.Counter(
        {(i, 0, 0, 0, 0, 0, 0, ""): 1 for i in (1, 2, 3)})


def test_packed_blocks_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    counts = np.arange(1, len(keys) + 1)
    back = alignment.unpack(alignment.pack(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()


def slice_of(links, part):
    """Runs of one partition as a task of the merge gets them; links: (row keys, A ids, B ids) of each run."""
    values = []
    for task, (rows, a, b) in enumerate(links):
        runs = alignment.Runs(16, 15)
        found = [x for i in range(0, len(rows), 10_000) for x in runs.add(rows[i:i + 10_000], a[i:i + 10_000], b[i:i + 10_000])]
        for p, run, blocks in [*found, *runs.flush()]:
            values += [(task * 100 + run, i, *block) for i, block in enumerate(blocks) if p == part]
    names = ["run", "block", "first", "base", "data"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    order = np.random.default_rng(2).permutation(len(values))
    return pa.RecordBatch.from_arrays([pa.array([values[i][k] for i in order], t) for k, t in enumerate(types)], names=names)


def test_merge_in_pieces_is_a_plain_count(monkeypatch):
    """Tiny blocks and steps, and a pair that fills many of them."""
    for name, value in (("RUN_LINKS", 15_000), ("BLOCK_LINKS", 16), ("MERGE_LINKS", 50)):
        monkeypatch.setattr(alignment, name, value)
    rng = np.random.default_rng(3)
    links = []
    for task in range(7):
        rows = np.sort(rng.integers(0, 300, 24_000)) + (task << 40)
        hot = rng.random(24_000) < 0.5
        links.append((rows, np.where(hot, 9, rng.integers(0, 50, 24_000)), np.where(hot, 16, rng.integers(0, 400, 24_000) * 16)))
    pairs = collections.Counter((int(y) << 16) | int(x) for _, a, b in links for x, y in zip(a, b))
    runs, known = alignment.grouped_runs([slice_of(links, 0)])
    assert len(runs) > 7 and not known
    every = sorted(pairs)
    best = {p: i % 2 for i, p in enumerate(every)}
    blocks = [(x[0], pa.py_buffer(alignment.CountedPairs.pack(*(np.array(v) for v in (x, [pairs[p] for p in x], [best[p] for p in x])))))
              for x in (every[i:i + 30] for i in range(0, len(every), 30))]
    counted, got_pairs, got_rows, last, pieces = alignment.CountedPairs(blocks), collections.Counter(), collections.Counter(), 0, 0
    for found, rows, n in alignment.merged(runs, 33):
        assert found[0] >= last and (np.diff(found.astype(np.int64)) >= 0).all()
        last, pieces = found[-1], pieces + 1
        total, high = counted.of(found)
        for key, count in zip(*(x.tolist() for x in alignment.keyed_sums(found, n))):
            got_pairs[key] += count
        for key, count, more in zip(*(x.tolist() for x in alignment.keyed_sums(rows, n * total, n * high))):
            got_rows[key, 0] += count
            got_rows[key, 1] += more
    assert got_pairs == pairs and pieces > 50
    want = collections.Counter()
    for rows, a, b in links:
        for row, x, y in zip(rows.tolist(), a.tolist(), b.tolist()):
            want[row, 0] += pairs[(y << 16) | x]
            want[row, 1] += best[(y << 16) | x]
    assert +got_rows == +want


def test_merge_holds_blocks_and_not_whole_runs():
    """64 runs of 60,000 links, one pair a third of them: a merge needs about a block of each run, not all their links."""
    rng = np.random.default_rng(4)
    links = []
    for task in range(64):
        rows = np.arange(60_000) + (task << 40)
        hot = rng.random(60_000) < 0.33
        links.append((rows, np.where(hot, 9, rng.integers(0, 2_000, 60_000)), np.where(hot, 16, rng.integers(0, 2_000, 60_000) * 16)))
    runs, _ = alignment.grouped_runs([slice_of(links, 0)])
    del links
    tracemalloc.start()
    try:
        total = sum(int(n.sum()) for _, _, n in alignment.merged(runs, 33))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 64 * 60_000
    assert peak < 64 << 20


def test_other_tokenizer_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        alignment.SideA(public_tokenizers.path("word_bpe_49k.json"), PATHS[1])
