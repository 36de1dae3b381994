"""Operator 13: alignment of two tokenizers, and how often their token pairs meet.

Both tokenizers cut the same bytes. Where a cut of one or of both lies, a piece ends
that is covered by one token of each: such pieces are the links, and offsets where both
cut end a group. A task counts the links of its documents by (document, token pair),
sorts them side-major (the B id first, then the A id), and writes them as zstd-packed
runs of small blocks, radix-partitioned by the B id. Runs of a partition are dealt out to
slices of bounded size, so that a token in all documents is counted by many tasks. Each
slice is merged with a heap over its runs: once to count pairs, whose sums give the corpus
counts and the highest count of each B id; and once more, beside those counts in the same
order, to give every document what its links contribute. A merge unpacks a block of each
run and a bounded number of links besides, whatever the input's size and however often a
pair occurs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import encoded, flat_tokens, keyed_chunks, prepare, scratch
from .token_counts import BLANK, processor

#: Text bytes that are tokenized at once; a longer text is handled alone.
CHUNK = 1 << 19
#: Links that a task gathers before it writes a run for each partition.
RUN_LINKS = 2 << 20
#: Links of a block: what a merge holds of each run.
BLOCK_LINKS = 1 << 11
#: Links that a merge unpacks at a time, beside those it holds.
MERGE_LINKS = 1 << 18
#: Bits of the B id by which runs are partitioned.
RADIX_BITS = 4
#: Packed bytes of the runs of a slice; runs are not split, so a slice can exceed it by one run.
SLICE_BYTES = 32 << 20
#: Runs of a slice at most.
SLICE_RUNS = 256
#: B ids of a partition, as bits, whose counted pairs are packed together.
COUNT_BITS = 7
#: Documents that a task gathers sums of before it returns them.
SUM_ROWS = 1 << 19
#: Documents that share one set of runs: the rest of 64 bits beside the ids.
MAX_ROWS = 1 << 31


class TokenTable:
    """Bytes of every token of a tokenizer, and the decimal ids with what can follow them."""

    def __init__(self, tokens: list[bytes], after_last: str):
        self.bytes = pa.array(tokens, pa.large_binary())
        self.sizes = pc.binary_length(self.bytes).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = [str(i) for i in range(len(tokens))]
        #: Written at id: inside a group; at id + number of tokens: as the last of its side.
        self.written = pa.array([i + "," for i in ids] + [i + after_last for i in ids], pa.large_string())


def byte_characters() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, all others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SideA:
    """A byte-level BPE tokenizer file, run by ranks: its merges must be in the order of its ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(vocab) - len(merges)
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not plain or any(vocab["".join(m)] != first + i for i, m in enumerate(merges)):
            raise ValueError(f"{path}: not a byte-level BPE whose merges follow its ids")
        at = byte_characters()
        ranks = {bytes(at[c] for c in token): i for token, i in vocab.items()}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.table = TokenTable(tokens, "|")
        self.bpe = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        found = [self.bpe.encode_to_numpy(t, disallowed_special=()) for t in texts]
        return np.concatenate(found).astype(np.int64), np.array([len(x) for x in found], dtype=np.int64)


class SideB:
    """A sentencepiece model, run once per distinct run of blanks with the word after it."""

    def __init__(self, path: str):
        self.model = processor(path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = TokenTable([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode()
                                 for i, p in enumerate(pieces)], ";")
        self.line_feed = self.model.piece_to_id("<0x0A>")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. The texts begin with the model's
        own blank and hold no ``BLANK`` sign, which here stands for a line feed."""
        marked = pc.replace_substring(texts, "\n", f"\n{BLANK}\n")
        runs = pc.match_substring(marked, "  ")
        marked = pc.if_else(runs, pc.replace_substring_regex(marked, "( +)", "\n\\1"), pc.replace_substring(marked, " ", "\n "))
        rows, terms = flat_tokens(pc.split_pattern(marked, "\n"))
        codes, distinct = encoded(terms)
        words = distinct.to_pylist()
        # The model puts one blank before a text; a line feed keeps it off a word that has none.
        own = [w[0] == " " and w != " " for w in words]
        found = self.model.encode([w[1:] if o else "\n" + w for w, o in zip(words, own)], num_threads=1)
        ids = [[self.line_feed] if w == BLANK else f if o else f[2:] for w, o, f in zip(words, own, found)]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.array([i for x in ids for i in x], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        count = sizes[codes]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.arange(total) + np.repeat(starts[codes] - (ends - count), count)]
        return out, np.bincount(rows, weights=count, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def sides(path_a: str, pattern: str, path_b: str) -> tuple[SideA, SideB]:
    """One pair per Python worker."""
    return SideA(path_a, pattern), SideB(path_b)


def spelled(table: TokenTable, ids: np.ndarray) -> memoryview:
    """The joined bytes of tokens."""
    found = table.bytes.take(pa.array(ids))
    first, last = np.frombuffer(found.buffers()[1], dtype=np.int64)[[found.offset, found.offset + len(found)]]
    return memoryview(found.buffers()[2]).cast("B")[first:last]


class Aligned:
    """The tokens of some texts on one axis of bytes, with their links and groups."""

    def __init__(self, a: SideA, b: SideB, texts: list[str | None]):
        n = len(texts)
        kept = [i for i, t in enumerate(texts) if t and BLANK not in t]
        spaced = [" " + texts[i] for i in kept]
        data = [t.encode() for t in spaced]
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, dtype=np.int64) for _ in range(4))
        self.digests = [""] * n
        self.row = self.a = self.b = np.zeros(0, dtype=np.int64)
        if not kept:
            return
        ids_a, count_a = a.encode(spaced)
        ids_b, count_b = b.encode(pa.array(spaced, pa.large_string()))
        whole_a, whole_b = spelled(a.table, ids_a), spelled(b.table, ids_b)
        size = np.array([len(d) for d in data], dtype=np.int64)
        size_a = sums(a.table.sizes[ids_a], count_a)
        size_b = sums(b.table.sizes[ids_b], count_b)
        at_a, at_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        same = np.array([size_a[k] == size[k] == size_b[k] and whole_a[at_a[k]:at_a[k] + size[k]] == d
                         and whole_b[at_b[k]:at_b[k] + size[k]] == d for k, d in enumerate(data)])
        ids_a, ids_b = ids_a[np.repeat(same, count_a)], ids_b[np.repeat(same, count_b)]
        rows = np.array(kept, dtype=np.int64)[same]
        count_a, count_b = count_a[same], count_b[same]
        if not len(rows):
            return
        doc_ends = np.cumsum(size[same])
        ends_a, ends_b = np.cumsum(a.table.sizes[ids_a]), np.cumsum(b.table.sizes[ids_b])
        cuts = np.union1d(ends_a, ends_b)
        doc = np.searchsorted(doc_ends, cuts)
        link_a, link_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        both = (ends_a[link_a] == cuts) & (ends_b[link_b] == cuts)
        self.n_a[rows], self.n_b[rows] = count_a, count_b
        self.n_links[rows] = np.bincount(doc, minlength=len(rows))
        self.n_groups[rows] = np.bincount(doc[both], minlength=len(rows))
        self.row, self.a, self.b = rows[doc], ids_a[link_a], ids_b[link_b]
        # Groups as text: A's tokens of a group stand before B's; each is written with what follows it.
        last_a, last_b = link_a[both], link_b[both]
        group_a, group_b = (np.searchsorted(last, np.arange(k)) for last, k in ((last_a, len(ids_a)), (last_b, len(ids_b))))
        is_last_a, is_last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        is_last_a[last_a], is_last_b[last_b] = len(a.table.sizes), len(b.table.sizes)
        before_b = np.concatenate([[0], last_b + 1])
        code = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        code[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + is_last_a
        code[np.arange(len(ids_b)) + last_a[group_b] + 1] = ids_b + is_last_b + len(a.table.written)
        words = pa.concat_arrays([a.table.written, b.table.written]).take(pa.array(code))
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
        text = memoryview(words.buffers()[2])
        stops = offsets[np.cumsum(count_a + count_b)]
        starts = np.concatenate([[offsets[0]], stops[:-1]])
        for i, start, stop in zip(rows.tolist(), starts.tolist(), stops.tolist()):
            self.digests[i] = hashlib.sha256(text[start:stop - 1]).hexdigest()  # without the last ';'


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` of the given lengths."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Runs:
    """Links of a task's documents; full, they become a sorted run for each partition."""

    def __init__(self, bits_a: int, bits_b: int):
        self.bits_a, self.bits_b = bits_a, bits_b
        self.bits_row = 64 - bits_a - bits_b
        self.keys: list[np.ndarray] = []
        self.held = self.runs = 0
        self.base: int | None = None

    def add(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, bytes]]]]:
        """Links of rows (keys of documents); yields what is full."""
        if not len(rows):
            return
        if self.base is None:
            self.base = int(rows[0])
        if int(rows[-1]) - self.base >= min(MAX_ROWS, 1 << self.bits_row):
            yield from self.flush()
            self.base = int(rows[0])
        key = b.astype(np.uint64) << np.uint64(64 - self.bits_b)
        key |= a.astype(np.uint64) << np.uint64(self.bits_row)
        key |= (rows - self.base).astype(np.uint64)
        self.keys.append(key)
        self.held += len(key)
        if self.held >= RUN_LINKS:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int, list[tuple[int, int, bytes]]]]:
        """(partition, run, its blocks in order) of all held links; a block is its first pair, the first row key, and packed links."""
        if self.held:
            keys, self.keys = np.concatenate(self.keys), []
            keys.sort()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(starts, append=len(keys))
            keys = keys[starts]
            own = ((keys >> np.uint64(64 - self.bits_b)) & np.uint64((1 << RADIX_BITS) - 1)).astype(np.uint8)
            for p in range(1 << RADIX_BITS):
                at = np.flatnonzero(own == p)
                parts = [at[start:start + BLOCK_LINKS] for start in range(0, len(at), BLOCK_LINKS)]
                if parts:
                    yield p, self.runs, [(int(keys[x[0]]) >> self.bits_row, self.base, pack(keys[x], counts[x])) for x in parts]
            self.runs += 1
        self.keys, self.held, self.base = [], 0, None


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys, by their differences, and counts. The differences' bytes stand by
    their places, so that those that are mostly zero pack well."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps).tobytes() + counts.astype("<u4").tobytes())


def unpack(data: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 12
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)


def merged(runs: list[list[tuple[int, int, pa.Buffer]]], bits_row: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """K-way merge of sorted runs, each a list of blocks: first pair, first row key, packed links.

    A heap holds, for each run, the first pair of the next block. Blocks are unpacked in
    its order, ``MERGE_LINKS`` at a time; then links up to the least pair in the heap leave
    together, so that at most one block of each run stays. Yields pair numbers, row keys,
    counts; pairs ascend, but one that occurs very often comes in several pieces.
    """
    shift, low = np.uint64(bits_row), np.uint64((1 << bits_row) - 1)
    heap = [(blocks[0][0], run, 0) for run, blocks in enumerate(runs)]
    heapq.heapify(heap)
    held = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while heap:
        parts, more = [held], 0
        while heap and more < MERGE_LINKS:
            _, run, block = heap[0]
            _, base, data = runs[run][block]
            keys, counts = unpack(data)
            parts.append((keys >> shift, (keys & low).astype(np.int64) + base, counts))
            more += len(keys)
            if block + 1 < len(runs[run]):
                heapq.heapreplace(heap, (runs[run][block + 1][0], run, block + 1))
            else:
                heapq.heappop(heap)
        values = tuple(np.concatenate(x) for x in zip(*parts))
        del parts
        due = values[0] <= np.uint64(heap[0][0]) if heap else np.ones(len(values[0]), dtype=bool)
        held = tuple(x[~due] for x in values)
        values = tuple(x[due] for x in values)
        order = np.argsort(values[0], kind="stable")
        yield tuple(x[order] for x in values)


def grouped_runs(batches: Iterator[pa.RecordBatch]) -> tuple[list[list[tuple[int, int, pa.Buffer]]], list[tuple[int, pa.Buffer]]]:
    """Of a slice: blocks by run, in order, and the blocks of counted pairs (run -1) by their first pair."""
    by: dict[int, list[tuple[int, int, int, pa.Buffer]]] = {}
    for batch in batches:
        numbers = [batch.column(c).to_pylist() for c in ("run", "block", "first", "base")]
        for run, block, first, base, data in zip(*numbers, batch.column("data")):
            by.setdefault(run, []).append((block, first, base, data.as_buffer()))
    known = sorted(((first, data) for _, first, _, data in by.pop(-1, [])), key=lambda x: x[0])
    # A run's block numbers differ, so that buffers are not compared.
    return [[x[1:] for x in sorted(by[run], key=lambda x: x[0])] for run in sorted(by)], known


def keyed_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *[np.add.reduceat(v[order], starts) for v in values]


class CountedPairs:
    """Counted pairs of a partition in the runs' order, read along with a merge."""

    def __init__(self, blocks: list[tuple[int, pa.Buffer]]):
        self.blocks, self.at = blocks, 0
        self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def pack(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(pairs.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + best.astype(np.uint8).tobytes())

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ascending pairs, and 1 for the best of their B id; the next call's pairs go on from there."""
        parts = [tuple(x[np.searchsorted(self.held[0], pairs[0]):] for x in self.held)]
        while self.at < len(self.blocks) and self.blocks[self.at][0] <= int(pairs[-1]):
            raw = zstandard.ZstdDecompressor().decompress(self.blocks[self.at][1])
            n = len(raw) // 17
            parts.append((np.frombuffer(raw, "<i8", n).astype(np.uint64), np.frombuffer(raw, "<i8", n, 8 * n),
                          np.frombuffer(raw, np.uint8, n, 16 * n).astype(np.int64)))
            self.at += 1
        self.held = tuple(np.concatenate(x) for x in zip(*parts))
        at = np.searchsorted(self.held[0], pairs)
        return self.held[1][at], self.held[2][at]


def align_documents(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """Both tokenizers' tokens of every whole text, their groups and links, and the links' corpus counts.

    A tokenizes a space and the text, B the text (its model adds the space). Returns
    doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A link's count
    is how many links of the corpus hold its pair of ids; n_best counts a document's links
    whose count is the highest of their B id (ties included), count_sum sums the counts.

    Null and empty texts, and texts whose joined token bytes differ from the space and the
    text on either side, have no tokens: zeros and ''. Null ``doc_id`` stays null; repeated
    rows are aligned and counted each; an empty table gives no rows; other columns are
    ignored. A very long text is tokenized alone; its links go to runs like all others.
    ``path_a`` (a byte-level BPE file whose merges follow its ids, with its pre-token
    pattern) and ``path_b`` (a sentencepiece model) are read on every executor.
    """
    prepare(docs.sparkSession)
    doc_id = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([doc_id, T.StructField("key", T.LongType()), *[T.StructField(c, T.LongType()) for c in numbers],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("part", T.IntegerType()),
                           T.StructField("run", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()),
                           T.StructField("base", T.LongType()), T.StructField("data", T.BinaryType())])
    a, b = sides(path_a, pattern, path_b)
    bits_a, bits_b = (max(1, (len(t.sizes) - 1).bit_length()) for t in (a.table, b.table))
    bits_row = 64 - bits_a - bits_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, pattern, path_b)
        runs = Runs(bits_a, bits_b)
        task = 0

        def blocks(found) -> Iterator[pa.RecordBatch]:
            for p, number, own in found:
                n = len(own)
                first, base, data = zip(*own)
                values = {"part": [p] * n, "run": [task + number] * n, "block": range(n), "first": first, "base": base, "data": data}
                yield pa.RecordBatch.from_arrays([pa.array(values.get(f.name, [None] * n), t) for f, t in zip(schema.fields, arrow)], names=schema.names)

        arrow = None
        for keys, part in keyed_chunks(batches, limit=CHUNK):
            if arrow is None:
                # Runs of a task are numbered from its first row key on, so that no two tasks share a number.
                task = int(keys[0])
                arrow = [part.column("doc_id").type, *[pa.int64()] * 5, pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            found = Aligned(a, b, part.column("text").to_pylist())
            n = len(keys)
            columns = [part.column("doc_id"), pa.array(keys), pa.array(found.n_a), pa.array(found.n_b), pa.array(found.n_groups),
                       pa.array(found.n_links), pa.array(found.digests, pa.string()), *[pa.nulls(n, t) for t in arrow[7:]]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            yield from blocks(runs.add(keys[found.row], found.a, found.b))
        yield from blocks(runs.flush())

    made = scratch(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "aligned")
    rows = made.where("data is null").select("doc_id", "key", *numbers, "groups_sha256")
    blocks_of = ["part", "run", "block", "first", "base", "data"]
    runs = made.where("data is not null").select(*blocks_of)

    # Slices: the runs of a partition in order, cut where their packed bytes or their number reach the next multiple.
    sizes = runs.groupBy("part", "run").agg(F.sum(F.octet_length("data")).alias("bytes"))
    order = Window.partitionBy("part").orderBy("run")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by_bytes = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / SLICE_BYTES)
    by_runs = F.floor((F.row_number().over(order) - 1) / SLICE_RUNS)
    sliced = scratch(sizes.select("part", "run", (by_bytes + by_runs).alias("slice")), "slices")
    dealt = runs.join(sliced, ["part", "run"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs, _, n in merged(grouped_runs(batches)[0], bits_row):
            pairs, n = keyed_sums(pairs, n)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    counts = dealt.groupBy("part", "slice").applyInArrow(count, "pair long, n long")
    counts = counts.groupBy("pair").agg(F.sum("n").alias("n"))
    # The highest count of a B id: at most one row per id of the model.
    side = F.shiftrightunsigned("pair", bits_a)
    best = scratch(counts, "pairs")
    top = best.groupBy(side.alias("b")).agg(F.max("n").alias("top"))
    best = best.withColumn("b", side).join(top, "b").select(
        side.bitwiseAND(F.lit((1 << RADIX_BITS) - 1)).cast("int").alias("part"),
        F.shiftrightunsigned("b", COUNT_BITS + RADIX_BITS).alias("ids"), "pair", "n", (F.col("n") == F.col("top")).alias("best"))

    def ordered(table: pa.Table) -> pa.Table:
        """The counts of some B ids of a partition in the runs' order, packed as a block."""
        table = table.sort_by("pair")
        data = CountedPairs.pack(*[table.column(c).to_numpy() for c in ("pair", "n", "best")])
        return pa.table({"part": table.column("part")[:1].combine_chunks(), "first": table.column("pair")[:1].combine_chunks(),
                         "data": pa.array([data], pa.binary())})

    packed = best.groupBy("part", "ids").applyInArrow(ordered, "part int, first long, data binary")
    beside = (sliced.select("part", "slice").distinct().join(packed, "part")
              .select("part", "slice", F.lit(-1).cast("long").alias("run"), F.lit(0).alias("block"), "first", F.lit(0).cast("long").alias("base"), "data"))
    both = dealt.select("part", "slice", *blocks_of[1:]).union(beside)

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, known = grouped_runs(batches)
        counted = CountedPairs(known)
        names, found, held = ["key", "count_sum", "n_best"], [], 0
        for pairs, rows, n in merged(runs, bits_row):
            count, is_best = counted.of(pairs)
            found.append(keyed_sums(rows, n * count, n * is_best))
            held += len(found[-1][0])
            if held > SUM_ROWS:
                found = [keyed_sums(*(np.concatenate(x) for x in zip(*found)))]
                held = len(found[0][0])
                if held > SUM_ROWS // 2:
                    # A document's parts are summed with those of the other slices.
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=names)
                    found, held = [], 0
        if found:
            found = keyed_sums(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    given = both.groupBy("part", "slice").applyInArrow(contribute, "key long, count_sum long, n_best long")
    given = given.groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("long")
    return rows.join(given, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
