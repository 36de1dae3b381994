"""Operator 10: token counts of whole texts without making ids.

Pieces are counted once per distinct pre-token; documents send only their pre-token
frequencies. No piece of the model reaches over the end of a word into a blank, and
none holds a line feed, so merges never cross those places: a text falls into line
feeds (a byte token each) and runs of blanks with the word after them, whose counts
add up to the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import flat_tokens, prepare, scratch
from .terms import count_terms, document_sums, heavy_terms

#: The model's sign for a blank; in a text it means the same as a blank.
BLANK = "▁"


@lru_cache(maxsize=2)
def processor(path: str):
    """One per Python worker; refuses models for which pre-tokens don't add up."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(BLANK in p.lstrip(BLANK) for p in pieces) or any("\n" in p for p in pieces):
        raise ValueError(f"{path}: pieces reach over blanks or line feeds")
    if sp.encode("a  b\n", out_type=str) != [f"{BLANK}a", BLANK, f"{BLANK}b", "<0x0A>"]:
        raise ValueError(f"{path}: the model changes blanks or has no byte tokens")
    return sp


def pretokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and pre-tokens: blanks with the word after them, or a word that begins a line.

    The blank that the model puts before a text is there. Line feeds are left out;
    each counts one token.
    """
    texts = pc.replace_substring(texts, BLANK, " ")
    texts = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(" ", texts, ""), texts)
    # A line feed before each run of blanks, then lines; runs of several need the slower way.
    runs = pc.match_substring(texts, "  ")
    texts = pc.if_else(runs, pc.replace_substring_regex(texts, "( +)", "\n\\1"), pc.replace_substring(texts, " ", "\n "))
    return flat_tokens(pc.split_pattern(texts, "\n"))


def piece_counts(path: str):
    """Column function: tokens of a pre-token inside a text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = processor(path)
        for terms in batches:
            # The model itself puts one blank before a text that is not empty; a line feed
            # keeps it off a word that has none and off a blank that stands alone.
            own = [t[0] == " " and t != " " for t in terms]
            found = sp.encode([t[1:] if o else "\n" + t for t, o in zip(terms, own)], num_threads=1)
            yield pd.Series([len(f) - (0 if o else 2) for f, o in zip(found, own)], dtype="int32")

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null text counts as empty: 0 bytes, 0 tokens. Null ``doc_id`` stays null;
    repeated rows are counted each; an empty table gives no rows; other columns are
    ignored. ``path`` (a sentencepiece model with byte fallback and no change of the
    text) is read on every executor.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    counted = count_terms(docs, pretokens)
    # Without the shuffle's spread into tasks again: one row per distinct pre-token.
    table = scratch(counted.withColumn("tokens", piece_counts(path)("term")), "pieces")
    total = table.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = heavy_terms(table, total, "tokens")
    head = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_tokens")])

    def inside(part, rows, codes, terms, found, known):
        tokens = known["tokens"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        texts = pc.fill_null(part.column("text").cast(pa.string()), "")
        if len(tokens):
            weight = np.where(found >= 0, tokens[found], 0)[codes]
        else:
            weight = np.zeros(len(codes), np.int64)
        lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False)
        sums = np.bincount(rows, weights=weight, minlength=len(texts)).astype(np.int64) + lines
        return {"doc_id": part.column("doc_id"), "n_bytes": pc.binary_length(texts), "n_tokens": sums}

    found = document_sums(docs, table, total, heavy, pretokens, head, inside,
                          {"n_tokens": F.col("freq") * F.col("tokens")})
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
