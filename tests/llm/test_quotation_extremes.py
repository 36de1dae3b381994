"""Operator 3 on texts that are long in every way: it neither fails nor hangs."""

import time

from agora.llm import quotation

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at string, lines int"


def order(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return {(r.conv_id, r.turn): r for r in quotation.reply_order(df).collect()}


def test_very_many_marks_on_a_line(spark):
    rows = [(1, 0, "user", "say it"), (1, 1, "user", ">" * 100_000 + " say it\nfine"), (1, 2, "user", "> " * 50_000 + "say it"), (1, 3, "user", ">" * 100_000)]
    got = order(spark, rows)
    assert (got[1, 1].max_level, got[1, 1].parent_turn, got[1, 1].body) == (100_000, 0, "fine")
    assert (got[1, 2].max_level, got[1, 2].parent_turn) == (50_000, 0)
    assert got[1, 3].body == "" and got[1, 3].parent_turn is None


def test_a_megabyte_of_blanks_and_of_blank_lines(spark):
    rows = [(1, 0, "user", "a" + " " * 1_000_000 + "b"), (1, 1, "user", "\n" * 300_000 + " x y" + " \n" * 300_000),
            (1, 2, "user", " " * 1_000_000), (1, 3, "user", "> x y\nyes")]
    began = time.time()
    got = order(spark, rows)
    assert time.time() - began < 120
    assert got[1, 1].body == " x y" and got[1, 2].body == "" and got[1, 0].body == rows[0][3]
    assert got[1, 3].parent_turn == 1


def test_very_many_quoted_lines(spark):
    said = "\n".join(f"line {i}" for i in range(100_000))
    mixed = "\n".join((">" if i % 2 else ">>") + f" part {i}" for i in range(20_000))
    began = time.time()
    got = order(spark, [(1, 0, "user", said), (1, 1, "user", "\n".join("> " + x for x in said.split("\n")) + "\nread"), (1, 2, "user", mixed)])
    assert time.time() - began < 240
    assert (got[1, 1].parent_turn, got[1, 1].n_quotes, got[1, 1].body) == (0, 1, "read")
    assert (got[1, 2].n_quotes, got[1, 2].max_level) == (20_000, 2)


def test_no_rows_and_null_texts(spark):
    assert quotation.reply_order(spark.createDataFrame([], SCHEMA)).count() == 0
    got = order(spark, [(1, 0, "user", None), (None, 1, "user", "> a"), (1, None, None, "> "), (None, 0, "user", "a")])
    assert got[1, 0].body == "" and got[None, 1].parent_turn == 0 and got[1, None].body == ""
