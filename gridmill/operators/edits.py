"""Spreadsheet edits of grids: every edit takes cells of any number of pages and gives cells of rectangles, numbered anew.

Cells: doc_id, page_index, row_index, col_index, value, word_ids, match_status, llm_mean, llm_min, ocr, agreement, trust,
verified, edited. A range is (row0, col0, row1, col1), both ends included, corners in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.text import trim
from gridmill.operators.parse import blank_cell

KEY = ["doc_id", "page_index"]
CELL = [*KEY, "row_index", "col_index"]
BODY = ["value", "word_ids", "match_status", "llm_mean", "llm_min", "ocr", "agreement", "trust", "verified", "edited"]
Range = tuple[int, int, int, int]


def normalized(r: Range) -> Range:
    return min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3])


def size_of(r: Range) -> int:
    a, b, c, d = normalized(r)
    return (c - a + 1) * (d - b + 1)


def inside(r: Range) -> Column:
    a, b, c, d = normalized(r)
    return F.col("row_index").between(a, c) & F.col("col_index").between(b, d)


def clamped(cells: DataFrame, r: Range) -> DataFrame:
    """The range as it lies in each page's grid."""
    a, b, c, d = normalized(r)
    rows, cols = F.max("row_index"), F.max("col_index")
    into = lambda x, top: F.greatest(F.lit(0), F.least(F.lit(x), top))
    return cells.groupBy(*KEY).agg(into(a, rows).alias("row0"), into(b, cols).alias("col0"), into(c, rows).alias("row1"), into(d, cols).alias("col1"))


def rectangle(cells: DataFrame) -> DataFrame:
    """Rows and columns numbered from 0 without gaps, blank cells where a row is short."""
    row = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("row_index")) - 1
    col = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("col_index")) - 1
    numbered = cells.withColumn("_r", row.cast("int")).withColumn("_c", col.cast("int")).select(*KEY, F.col("_r").alias("row_index"), F.col("_c").alias("col_index"), *BODY)
    size = numbered.groupBy(*KEY).agg(F.max("row_index").alias("_rows"), F.max("col_index").alias("_cols"))
    frame = size.select(*KEY, F.explode(F.sequence(F.lit(0), "_rows")).alias("row_index"), "_cols").select(*KEY, "row_index", F.explode(F.sequence(F.lit(0), "_cols")).alias("col_index"))
    full = frame.hint("merge").join(numbered.withColumn("_there", F.lit(True)), CELL, "left")
    blank = blank_cell(F.col("row_index"), F.col("col_index"))
    return full.select(*CELL, *[F.when(F.col("_there"), F.col(c)).otherwise(blank[c]).alias(c) for c in BODY])


def with_value(cells: DataFrame, new: Column, where: Column) -> DataFrame:
    """Cells with a new value where said: trimmed and verified, and edited if the value changed or was edited before; words stay."""
    value = trim(new)
    return cells.withColumns({"edited": F.when(where, F.col("edited") | (value != F.col("value"))).otherwise(F.col("edited")), "verified": F.when(where, True).otherwise(F.col("verified")), "value": F.when(where, value).otherwise(F.col("value"))})


def set_value(cells: DataFrame, row: int, col: int, value: str) -> DataFrame:
    return with_value(cells, F.lit(value), inside((row, col, row, col)))


def clear(cells: DataFrame, r: Range) -> DataFrame:
    return with_value(cells, F.lit(""), inside(r))


def all_verified(cells: DataFrame, r: Range) -> DataFrame:
    return cells.filter(inside(r)).groupBy(*KEY).agg(F.bool_and("verified").alias("all_verified"))


def toggle_verified(cells: DataFrame, r: Range) -> DataFrame:
    """Verifies a range, or takes it back where all of it was verified."""
    before = cells.hint("merge").join(all_verified(cells, r), KEY, "left")
    return before.withColumn("verified", F.when(inside(r), ~F.col("all_verified")).otherwise(F.col("verified"))).drop("all_verified")


def _shifted(cells: DataFrame, axis: str, at: int, by: int) -> DataFrame:
    return cells.withColumn(axis, F.when(F.col(axis) >= at, F.col(axis) + by).otherwise(F.col(axis)))


def _insert(cells: DataFrame, axis: str, at: int, n: int) -> DataFrame:
    """Blank rows or columns before place ``at``, or after the last where that is less."""
    other = "col_index" if axis == "row_index" else "row_index"
    end = F.least(F.lit(max(0, at)), F.max(axis).over(Window.partitionBy(*KEY)) + 1)
    placed = cells.withColumn("_at", end)
    moved = placed.withColumn(axis, F.when(F.col(axis) >= F.col("_at"), F.col(axis) + n).otherwise(F.col(axis)))
    spots = placed.select(*KEY, "_at", other).distinct().select(*KEY, other, F.explode(F.sequence(F.col("_at"), F.col("_at") + n - 1)).alias(axis))
    blank = blank_cell(F.col("row_index"), F.col("col_index"))
    return rectangle(moved.select(*CELL, *BODY).unionByName(spots.select(*CELL, *[blank[c].alias(c) for c in BODY])))


def _delete(cells: DataFrame, axis: str, first: int, last: int) -> DataFrame:
    """Without these rows or columns; a page that would lose all of them stays."""
    top = F.max(axis).over(Window.partitionBy(*KEY))
    whole = (F.lit(first) <= 0) & (top <= last)
    return rectangle(cells.withColumn("_all", whole).filter(F.col("_all") | ~F.col(axis).between(first, last)).drop("_all"))


def _move(cells: DataFrame, axis: str, first: int, last: int, by: int) -> DataFrame:
    """A block one place on (1) or back (-1); off the edge nothing moves."""
    top = F.max(axis).over(Window.partitionBy(*KEY))
    fits = (F.lit(first + by) >= 0) & (F.lit(last + by) <= top)
    x = F.col(axis)
    new = F.when(x.between(first, last), x + by).when(x == (last + 1 if by > 0 else first - 1), x + (first - last - 1 if by > 0 else last - first + 1)).otherwise(x)
    return rectangle(cells.withColumn("_fits", fits).withColumn(axis, F.when(F.col("_fits"), new).otherwise(x)).drop("_fits"))


def insert_rows(cells: DataFrame, at: int, n: int = 1) -> DataFrame:
    return _insert(cells, "row_index", at, n)


def insert_columns(cells: DataFrame, at: int, n: int = 1) -> DataFrame:
    return _insert(cells, "col_index", at, n)


def delete_rows(cells: DataFrame, first: int, last: int) -> DataFrame:
    return _delete(cells, "row_index", first, last)


def delete_columns(cells: DataFrame, first: int, last: int) -> DataFrame:
    return _delete(cells, "col_index", first, last)


def move_rows(cells: DataFrame, first: int, last: int, by: int) -> DataFrame:
    return _move(cells, "row_index", first, last, by)


def move_columns(cells: DataFrame, first: int, last: int, by: int) -> DataFrame:
    return _move(cells, "col_index", first, last, by)


RANK = {"low": 0, "medium": 1, "high": 2}


def folded(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One cell of each group: values joined, words of all once, the mean OCR score and the least trust of those not blank; verified and edited."""
    full = trim(F.col("value")) != ""
    parts = F.array_sort(F.collect_list(F.struct("col_index", F.when(full, trim(F.col("value"))).alias("v"), F.col("word_ids").alias("ids"))))
    rank = F.when(F.col("trust") == "low", 0).when(F.col("trust") == "medium", 1).otherwise(2)
    agg = cells.groupBy(*keys).agg(F.min("col_index").alias("col_index"), parts.alias("_p"), F.avg(F.when(full, F.col("ocr"))).alias("ocr"), F.coalesce(F.min(F.when(full, rank)), F.lit(2)).alias("_t"), F.min(F.when(full & (F.col("agreement") == "image_only"), 0).otherwise(1)).alias("_a"))
    ids = F.array_distinct(F.flatten(F.transform("_p", lambda x: x["ids"])))
    value = F.array_join(F.filter(F.transform("_p", lambda x: x["v"]), lambda v: v.isNotNull()), " ")
    status = F.when(F.size("word_ids") > 1, "multi_word").when(F.size("word_ids") == 1, "matched").when(F.col("value") == "", "empty").otherwise("unmatched")
    out = agg.withColumn("value", value).withColumn("word_ids", ids).withColumn("match_status", status)
    none = F.lit(None).cast("double")
    return out.select(*keys, "col_index", "value", "word_ids", "match_status", none.alias("llm_mean"), none.alias("llm_min"), "ocr", F.when(F.col("_a") == 0, "image_only").otherwise("agree").alias("agreement"), F.element_at(F.array(*map(F.lit, RANK)), F.col("_t") + 1).alias("trust"), F.lit(True).alias("verified"), F.lit(True).alias("edited"))


def merge_cells(cells: DataFrame, r: Range) -> DataFrame:
    """The range's cells of each row in its left one; the others are cleared but keep their words. One column is left as it is."""
    a, b, c, d = normalized(r)
    if b == d:
        return rectangle(cells)
    merged = folded(cells.filter(inside(r)), [*KEY, "row_index"])
    rest = with_value(cells.filter(~(inside(r) & (F.col("col_index") == b))), F.lit(""), inside(r))
    return rectangle(rest.select(*CELL, *BODY).unionByName(merged.select(*CELL, *BODY)))


def merge_columns(cells: DataFrame, first: int, last: int) -> DataFrame:
    first, last = min(first, last), max(first, last)
    merged = merge_cells(cells, (0, first, 1 << 30, last))
    return rectangle(merged.filter(~F.col("col_index").between(first + 1, last)))


def delete_shift_left(cells: DataFrame, r: Range) -> DataFrame:
    """Without the range's cells, those right of them pulled left; over the whole width they are cleared instead."""
    a, b, c, d = normalized(r)
    last = F.max("col_index").over(Window.partitionBy(*KEY))
    sized = cells.withColumn("_last", last).withColumn("_whole", (F.lit(b) <= 0) & (F.col("_last") <= d))
    cleared = with_value(sized, F.lit(""), F.col("_whole") & inside(r))
    kept = cleared.filter(F.col("_whole") | ~inside(r))
    right = F.col("row_index").between(a, c) & (F.col("col_index") > d) & ~F.col("_whole")
    moved = kept.withColumn("col_index", F.when(right, F.col("col_index") - (d - b + 1)).otherwise(F.col("col_index")))
    return rectangle(_same_width(moved, cells))


def _same_width(cells: DataFrame, before: DataFrame) -> DataFrame:
    """Cells with a blank one in the corner that keeps the width there was."""
    corner = before.groupBy(*KEY).agg(F.max("col_index").alias("col_index")).withColumn("row_index", F.lit(0))
    corner = corner.hint("merge").join(cells.select(*CELL), CELL, "left_anti")
    blank = blank_cell(F.col("row_index"), F.col("col_index"))
    return cells.select(*CELL, *BODY).unionByName(corner.select(*CELL, *[blank[c].alias(c) for c in BODY]))


def insert_shift_right(cells: DataFrame, r: Range) -> DataFrame:
    """Blank cells in the range, those there pushed right; blanks at a row's end are taken up, and the grid grows for what isn't blank only."""
    a, b, c, d = normalized(r)
    width = F.max("col_index").over(Window.partitionBy(*KEY))
    sized = cells.withColumn("_last", width)
    push = F.col("row_index").between(a, c) & (F.col("col_index") >= b)
    moved = sized.withColumn("col_index", F.when(push, F.col("col_index") + (d - b + 1)).otherwise(F.col("col_index")))
    kept = moved.filter((F.col("col_index") <= F.col("_last")) | (trim(F.col("value")) != ""))
    spots = cells.filter(F.col("row_index").between(a, c)).select(*KEY, "row_index").distinct().select(*KEY, "row_index", F.explode(F.sequence(F.lit(b), F.lit(d))).alias("col_index"))
    blank = blank_cell(F.col("row_index"), F.col("col_index"))
    with_blanks = kept.select(*CELL, *BODY).unionByName(spots.select(*CELL, *[blank[c].alias(c) for c in BODY]))
    return rectangle(_same_width(with_blanks, cells))


def remove_empty(cells: DataFrame) -> DataFrame:
    """Without blank rows but the first, then without columns blank in all rows left; one column stays at least."""
    some = trim(F.col("value")) != ""
    rows = cells.withColumn("_row", F.max(some).over(Window.partitionBy(*KEY, "row_index"))).filter((F.col("row_index") == 0) | F.col("_row"))
    cols = rows.withColumn("_col", F.max(some).over(Window.partitionBy(*KEY, "col_index"))).withColumn("_any", F.max(some).over(Window.partitionBy(*KEY)))
    return rectangle(cols.filter(F.col("_col") | (~F.col("_any") & (F.col("col_index") == 0))).select(*CELL, *BODY))


def range_values(cells: DataFrame, r: Range | None = None) -> DataFrame:
    """``rows``: the values of a range, or of all."""
    held = cells.filter(inside(r)) if r else cells
    rows = held.groupBy(*KEY, "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "value"))), lambda x: x["value"]).alias("row"))
    return rows.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "row"))), lambda x: x["row"]).alias("rows"))


def paste(cells: DataFrame, block: list[list[str]], row: int, col: int) -> DataFrame:
    """A block of values over the grid from a place on; the grid grows where it must. An empty block changes nothing."""
    flat = [(row + i, col + j, v) for i, line in enumerate(block) for j, v in enumerate(line)]
    if not flat:
        return rectangle(cells)
    values = F.array(*[F.struct(F.lit(i).alias("row_index"), F.lit(j).alias("col_index"), F.lit(v).alias("_new")) for i, j, v in flat])
    new = cells.select(*KEY).distinct().select(*KEY, F.explode(values).alias("b")).select(*KEY, "b.*")
    both = cells.withColumn("_old", F.lit(True)).hint("merge").join(new, CELL, "full_outer")
    blank = blank_cell(F.col("row_index"), F.col("col_index"))
    filled = both.select(*CELL, *[F.when(F.col("_old"), F.col(c)).otherwise(blank[c]).alias(c) for c in BODY], "_new")
    return rectangle(with_value(filled, F.coalesce("_new", F.lit("")), F.col("_new").isNotNull()))


def pasted_range(block: list[list[str]], row: int, col: int) -> Range:
    return row, col, row + max(0, len(block) - 1), col + max(0, max(map(len, block), default=1) - 1)


def neighbours(cells: DataFrame) -> DataFrame:
    """The next and the previous cell of each in reading order; none at the ends."""
    order, at = Window.partitionBy(*KEY).orderBy("row_index", "col_index"), F.struct("row_index", "col_index")
    return cells.select(*CELL, F.lead(at).over(order).alias("next"), F.lag(at).over(order).alias("previous"))


def commands(cells: DataFrame, r: Range) -> DataFrame:
    """Which commands a selection allows on each page."""
    a, b, c, d = normalized(r)
    size = cells.groupBy(*KEY).agg(F.max("row_index").alias("rows"), F.max("col_index").alias("cols"))
    return size.select(*KEY, (F.lit(a > 0)).alias("move_up"), (F.lit(c) < F.col("rows")).alias("move_down"), (F.lit(b > 0)).alias("move_left"), (F.lit(d) < F.col("cols")).alias("move_right"), (F.lit(a > 0) | (F.col("rows") > c)).alias("delete_rows"), (F.lit(b > 0) | (F.col("cols") > d)).alias("delete_columns"), F.lit(b != d).alias("merge"))
