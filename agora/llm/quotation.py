"""Operator 3: conversations in reply order, by linking quotations to their originals.

Native: DataFrame functions only. Lines that begin with ``>`` marks are quotations;
the number of marks is the level. Neighbouring lines of one level are a passage. A
passage is normalised, hashed and joined, inside its conversation, to the first
earlier message that says the same in its own words: as a whole, as a paragraph, as a
line or as a sentence. A passage that no message has as one is joined by its own
paragraphs, lines and sentences, to the earlier message that has most of them.
Threads are followed by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prefix_offsets, scratch

#: Marks at the start of a quoted line, with blanks between them. (No repeated group: such patterns recurse.)
MARKS = r"^([ \t]*+>[> \t]*+)"
#: White space of the contract's words.
SPACE = " \t\n\x0b\x0c\r"
#: Blank lines between paragraphs; what parts sentences in normalised text.
BLANK, SENTENCE = r"\n[\x20\x09-\x0D]*\n", r"(?<=[.!?\u2026]|[.!?\u2026][\"')\]\u201d\u2019]) |(?<=[\u3002\uff01\uff1f])"
#: Turns counted together when messages are numbered.
SPAN = 64


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _lines(text: Column) -> Column:
    """Lines as (level, said) structs."""
    marks = lambda x: F.regexp_extract(x, MARKS, 1)
    return F.transform(F.split(text, "\r?\n"), lambda x: F.struct(
        F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.substring(x, F.length(marks(x)) + 1, F.length(x)).alias("said")))


def _starts(lines: str) -> Column:
    """Numbers of the lines whose level differs from that of the line before."""
    level = lambda i: F.element_at(F.col(lines), i)["level"]
    return F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))


def _passages(lines: str, starts: str) -> Column:
    """Neighbouring lines of one level as one: (level, said); each is cut out of the lines once."""
    return F.transform(F.col(starts), lambda s, k: F.struct(
        F.element_at(F.col(lines), s)["level"].alias("level"),
        F.slice(F.col(lines), s, F.coalesce(F.get(F.col(starts), k + 1), F.size(lines) + 1) - s)["said"].alias("said")))


def _units(text: Column) -> Column:
    """Hashes of the whole text, its paragraphs, its lines, and the sentences of both."""
    parts = F.concat(F.split(text, BLANK), F.split(text, "\n"))
    sentences = F.flatten(F.transform(parts, lambda x: F.split(normalised(x), SENTENCE)))
    full = F.filter(F.transform(F.concat(F.array(text), parts, sentences), normalised), lambda x: x != "")
    return F.array_distinct(F.transform(full, lambda x: F.md5(x)))


def _origins(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """(conv, at, raw, origin): the earlier message of each quoted passage that has one.

    ``quotes`` has (conv, at, raw, hash, units), ``said`` the distinct (conv, at, unit).
    The first message with the whole passage; else the one with most of its units, the
    first of equals. A message with c of the k units that anyone said has one of the
    k - c + 1 rarest, so only their messages are compared: c is what a unit's first
    message reaches at least, and a common line is no candidate where others are found.
    """
    one = ["conv", "at", "raw"]
    passages = quotes.select(*one, "hash", "units").distinct()
    known = scratch(said.groupBy("conv", "unit").agg(F.min("at").alias("origin"), F.count("*").alias("n")), "units")
    whole = scratch(passages.join(known.withColumnRenamed("unit", "hash"), ["conv", "hash"]).where("origin < at").select(*one, "origin"), "whole")
    parts = passages.join(whole, one, "left_anti").select(*one, F.explode("units").alias("unit"))
    parts = scratch(parts.join(known, ["conv", "unit"]).where("origin < at"), "parts")
    reached = (parts.groupBy(*one, "origin").agg(F.count("*").alias("c")).groupBy(*one)
               .agg((F.sum("c") - F.max("c") + 1).alias("rarest")))
    rank = F.row_number().over(Window.partitionBy(*one).orderBy("n", "unit"))
    rare = parts.withColumn("r", rank).join(reached, one).where("r <= rarest").select(*one, "unit")
    there = said.select("conv", "unit", F.col("at").alias("origin"))
    candidates = rare.join(there, ["conv", "unit"]).where("origin < at").select(*one, "origin").distinct()
    most = (candidates.join(parts.select(*one, "unit"), one).join(there, ["conv", "unit", "origin"])
            .groupBy(*one, "origin").agg((-F.count("*")).alias("c"))
            .groupBy(*one).agg(F.min(F.struct("c", "origin"))["origin"].alias("origin")))
    return whole.union(most)


def reply_order(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, parent_turn, thread_turn, position, n_quotes, n_linked, max_level, body.

    ``body`` is the message without quotations (and without blank lines at its ends).
    The original of a passage is the first earlier message that has it as one (whole,
    paragraph, line or sentence), or else the one that has most of its paragraphs, lines
    and sentences. ``parent_turn`` is the turn of the latest original among the passages of level 1,
    or, where none is found, among deeper ones; null where nothing is quoted or no
    original is earlier. ``thread_turn`` is the first message reached by parents, itself
    if it has none. ``position`` (from 0) orders a conversation by thread, then by turn,
    so a reply comes after what it answers.

    Null text has an empty body and no quotations. A null conv_id is a conversation
    of its own; messages with a null turn come last in it and neither reply nor are
    replied to. Repeated rows are messages of their own; they have the same parent.
    An empty table gives no rows; other columns are ignored. Very long texts, lines
    and runs of marks or blanks are handled whole, in time in proportion to their length.
    """
    # Keys of joins have no nulls: c + the id, or n; null turns stand past all others.
    rows = messages.select(
        "conv_id", "turn", "role", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(2**62)).alias("at"),
        _lines(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = rows.withColumn("starts", _starts("lines"))
    rows = rows.select("*", F.filter("lines", lambda x: x["level"] > 0).alias("quoted"),
                       F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["said"]), "\n").alias("own"))
    rows = scratch(rows.select(
        "conv_id", "turn", "role", "conv", "at", F.rtrim(F.regexp_replace("own", r"^[\x20\x09-\x0D]*\n", ""), F.lit(SPACE)).alias("body"),
        # Texts without quotations need no passages.
        F.when(F.size("quoted") > 0, F.filter(_passages("lines", "starts"), lambda p: p["level"] > 0)).alias("passages"),
        F.lit(1).cast("long").alias("one")), "messages")
    real = rows.where(F.col("at") < 2**62)
    quotes = (real.where("passages IS NOT NULL").select("conv", "at", F.explode("passages").alias("p"))
              .select("conv", "at", "p.level", F.array_join("p.said", "\n").alias("text")).where(normalised(F.col("text")) != ""))
    quotes = scratch(quotes.select("conv", "at", "level", F.md5("text").alias("raw"), F.md5(normalised(F.col("text"))).alias("hash"),
                                   _units(F.col("text")).alias("units")), "quotes")
    # Only conversations that quote need an index of what was said in them.
    said = real.join(quotes.select("conv").distinct(), "conv", "left_semi")
    said = scratch(said.select("conv", "at", F.explode(_units(F.col("body"))).alias("unit")).distinct(), "said")
    linked = quotes.join(_origins(quotes, said), ["conv", "at", "raw"], "left")
    by_message = linked.groupBy("conv", "at").agg(
        F.count("origin").alias("_linked"),
        F.coalesce(F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin")).alias("parent"))
    replies = scratch(by_message, "replies")
    top = replies.where("parent IS NOT NULL").select("conv", "at", F.col("parent").alias("top"))
    moved = None
    # Pointer doubling: each round at least doubles how far a message has seen up its thread.
    while moved is None or not moved.isEmpty():
        top = scratch(top, "threads")
        up = top.select("conv", F.col("at").alias("top"), F.col("top").alias("next"))
        moved = top.join(up, ["conv", "top"], "left_semi")
        top = top.join(up, ["conv", "top"], "left").select("conv", "at", F.coalesce("next", "top").alias("top"))
    full = (rows.join(replies.select("conv", "at", "_linked", "parent"), ["conv", "at"], "left").join(top, ["conv", "at"], "left")
            .withColumn("thread", F.coalesce("top", "at")))
    full = full.withColumns({"b0": F.floor(F.col("thread") / SPAN), "b1": F.floor(F.col("at") / SPAN)})
    keys = [["b0"], ["thread", "b1"]]
    starts = prefix_offsets(full.select("conv", "b0", "thread", "b1", "one"), ["conv"], keys, "one")
    inside = Window.partitionBy("conv", "b0", "thread", "b1").orderBy("at", "role", "body")
    full = full.join(starts, ["conv", "b0", "thread", "b1"])
    null_turn = lambda c: F.when(F.col(c) < 2**62, F.col(c))
    return full.select(
        "conv_id", "turn", "role", F.col("parent").alias("parent_turn"), null_turn("thread").alias("thread_turn"),
        (F.col("offset") + F.row_number().over(inside) - 1).alias("position"),
        F.coalesce(F.size("passages"), F.lit(0)).alias("n_quotes"), F.coalesce("_linked", F.lit(0)).alias("n_linked"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("max_level"), "body")
