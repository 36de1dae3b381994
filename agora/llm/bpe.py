"""Operator 6: byte-level BPE encoding and decoding with a two-tier lookup.

Pre-tokens (matches of the pattern) that are whole vocabulary entries are resolved by
a minimal perfect hash over the vocabulary; all others go through merges held in a
heap over a linked list of their bytes. Spark deals out the documents; a task keeps
one document's ids at a time, and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import prepare, slices, texts_of

#: Distinct pre-tokens a worker remembers; beyond, it starts to remember anew.
REMEMBERED = 400_000


class PerfectHash:
    """Minimal perfect hash of byte strings, by levels of bit arrays.

    On each level every remaining key sets one bit; bits hit once keep their key, the
    rest go to the next level. A key's number is the count of kept bits before its own.
    """

    def __init__(self, keys: list[bytes], gamma: float = 2.0):
        self.sizes: list[int] = []
        self.starts: list[int] = []
        bits, rest = [], list(range(len(keys)))
        total = 0
        while rest:
            size = max(64, int(gamma * len(rest)))
            seed = len(self.sizes)
            at = np.array([xxhash.xxh3_64_intdigest(keys[i], seed) % size for i in rest], dtype=np.int64)
            once = np.bincount(at, minlength=size) == 1
            bits.append(once)
            self.sizes.append(size)
            self.starts.append(total)
            total += size
            rest = [i for i, p in zip(rest, at.tolist()) if not once[p]]
        kept = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
        #: For a kept bit its key's number, else -1.
        self.number = np.where(kept, np.cumsum(kept) - 1, -1).tolist()

    def __call__(self, key: bytes) -> int:
        """The key's number; for strings that are no keys, any number or -1."""
        for seed, (size, start) in enumerate(zip(self.sizes, self.starts)):
            n = self.number[start + xxhash.xxh3_64_intdigest(key, seed) % size]
            if n >= 0:
                return n
        return -1


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slots: list[tuple[bytes, int]] = [(b"", 0)] * len(keys)
        for key in keys:
            self.slots[self.hash(key)] = (key, ranks[key])
        self.known: dict[str, bytes] = {}

    def whole(self, piece: bytes) -> int:
        """First tier: the id of a piece that is a vocabulary entry, else -1."""
        n = self.hash(piece)
        if n >= 0:
            token, rank = self.slots[n]
            if token == piece:
                return rank
        return -1

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: repeatedly join the neighbours of lowest rank, leftmost first."""
        ranks, n = self.ranks, len(piece)
        parts = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            left, j = parts[i], after[i]
            # A pair that has changed since it was put here has another rank or no left part.
            if left is None or j >= n or ranks.get(joined := left + parts[j]) != r:
                continue
            parts[i], parts[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := ranks.get(joined + parts[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := ranks.get(parts[h] + joined)) is not None:
                heapq.heappush(heap, (s, h))
        return [ranks[p] for p in parts if p is not None]

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        data = piece.encode()
        rank = self.whole(data)
        return np.array([rank] if rank >= 0 else self.merged(data), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as by ``piece_ids``."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        pieces = self.pattern.findall(text)
        new = set(pieces).difference(known)
        for p in new:
            known[p] = self.piece_ids(p)
        ids = b"".join([known[p] for p in pieces])
        for p in new:
            if len(p) > 64:  # long pieces hardly come again
                del known[p]
        return ids

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Adds to ``doc_id``: ids (packed little-endian unsigned 32-bit, if ``with_ids``),
    n_tokens, ids_sha256, decoded_sha256, decoded_bytes. Null text counts as empty: no
    tokens and the checksum of no bytes. Null ``doc_id`` stays null; repeated rows are
    encoded each; an empty table gives no rows; other columns are ignored. ``path``
    is read on every executor.
    """
    prepare(docs.sparkSession)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
              T.StructField("decoded_bytes", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for start, length in slices(batch):
                part = batch.slice(start, length)
                counts, digests, decoded, sizes, kept = [], [], [], [], []
                for text in texts_of(part):
                    ids = bpe.encode(text.as_py())
                    data = bpe.decode(ids)
                    counts.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(data).hexdigest())
                    sizes.append(len(data))
                    if with_ids:
                        kept.append(ids)
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                           pa.array(decoded, pa.string()), pa.array(sizes, pa.int64())]
                if with_ids:
                    columns.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
