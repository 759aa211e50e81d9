"""Edits on hand-made grids; every result must be a numbered rectangle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridmill.operators import edits as E
from gridmill.operators.parse import blank_cell


def grid(spark, rows):
    flat = [(1, 0, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    df = spark.createDataFrame(flat, "doc_id long, page_index int, row_index int, col_index int, value string")
    blank = blank_cell(F.col("row_index"), F.col("col_index"))
    ids = F.when(F.col("value") != "", F.array(F.col("value"))).otherwise(F.array().cast("array<string>"))
    return df.select(*E.CELL, "value", *[ids.alias(c) if c == "word_ids" else blank[c].alias(c) for c in E.BODY[1:]])


def values(df):
    rows = df.select("row_index", "col_index", "value").orderBy("row_index", "col_index").collect()
    out: list = []
    for r in rows:
        if r["col_index"] == 0:
            out.append([])
        assert r["row_index"] == len(out) - 1 and r["col_index"] == len(out[-1])
        out[-1].append(r["value"])
    assert len({len(x) for x in out}) <= 1
    return out


CASES = [
    (lambda g: E.merge_columns(g, 0, 1), [["Course", "Code"], ["Calculus", "I"]], [["Course Code"], ["Calculus I"]]),
    (lambda g: E.merge_cells(g, (0, 0, 0, 2)), [["a", "", "b"], ["x", "y", "z"]], [["a b", "", ""], ["x", "y", "z"]]),
    (lambda g: E.delete_shift_left(g, (1, 0, 1, 0)), [["h", "i", "j"], ["x", "a", "b"]], [["h", "i", "j"], ["a", "b", ""]]),
    (lambda g: E.delete_shift_left(g, (0, 0, 0, 1)), [["x", "y"], ["a", "b"]], [["", ""], ["a", "b"]]),
    (lambda g: E.insert_shift_right(g, (1, 0, 1, 0)), [["h", "i", "j"], ["a", "b", ""]], [["h", "i", "j"], ["", "a", "b"]]),
    (lambda g: E.insert_shift_right(g, (1, 0, 1, 0)), [["h", "i"], ["a", "b"]], [["h", "i", ""], ["", "a", "b"]]),
    (E.remove_empty, [["h1", "", "h3"], ["a", "", "c"], ["", "", ""]], [["h1", "h3"], ["a", "c"]]),
    (E.remove_empty, [["", "h2"], ["a", "b"]], [["", "h2"], ["a", "b"]]),
    (E.remove_empty, [["", ""], ["", ""]], [[""]]),
    (lambda g: E.paste(g, [["x", "y"], ["p", "q"]], 1, 0), [["h1"], ["a"]], [["h1", ""], ["x", "y"], ["p", "q"]]),
    (lambda g: E.paste(g, [], 0, 0), [["a"]], [["a"]]),
    (lambda g: E.delete_rows(g, 0, 5), [["a"], ["b"]], [["a"], ["b"]]),
    (lambda g: E.delete_columns(g, 1, 1), [["a", "b", "c"]], [["a", "c"]]),
    (lambda g: E.move_rows(g, 0, 0, -1), [["a"], ["b"]], [["a"], ["b"]]),
    (lambda g: E.move_columns(g, 0, 1, 1), [["a", "b", "c"]], [["c", "a", "b"]]),
    (lambda g: E.insert_rows(g, 99), [["a"]], [["a"], [""]]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_edit(spark, k):
    edit, before, after = CASES[k]
    assert values(edit(grid(spark, before))) == after


def test_merge_keeps_words_and_verifies(spark):
    row = E.merge_columns(grid(spark, [["a", "b"]]), 0, 1).first()
    assert (row["word_ids"], row["verified"], row["edited"], row["match_status"]) == (["a", "b"], True, True, "multi_word")


def test_ranges():
    assert E.normalized((3, 2, 1, 0)) == (1, 0, 3, 2) and E.size_of((3, 2, 1, 0)) == 9 and E.pasted_range([["x", "y"]], 2, 3) == (2, 3, 2, 4)
