"""From positioned words to lines, columns and text. Words: doc_id, page_index, word_ord, word_id, text, confidence, left, top, width, height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.text import trim

KEY = ["doc_id", "page_index"]
GAP_CHARS, TOLERANCE_CHARS, USUAL_CHAR = 3, 1, 8.0


def line_threshold(height: Column | float) -> Column:
    return F.greatest(F.lit(2.0), (height if isinstance(height, Column) else F.lit(float(height))) * 0.005)


def with_lines(words: DataFrame, height: Column | float) -> DataFrame:
    """Adds ``line_no`` and ``pos_in_line``. A line ends where the next word by top lies more than the threshold below the one before it."""
    page = Window.partitionBy(*KEY).orderBy("top", "word_ord")
    gap = F.col("top") - F.lag("top").over(page)
    lined = words.withColumn("line_no", F.sum(F.when(gap > line_threshold(height), 1).otherwise(0)).over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    line = Window.partitionBy(*KEY, "line_no").orderBy("left", "top", "word_ord")
    return lined.withColumn("pos_in_line", (F.row_number().over(line) - 1).cast("int"))


def sorted_words(words: DataFrame, height: Column | float) -> DataFrame:
    """Adds ``reading_ord``, the place in reading order from 0."""
    order = Window.partitionBy(*KEY).orderBy("line_no", "pos_in_line")
    return with_lines(words, height).withColumn("reading_ord", (F.row_number().over(order) - 1).cast("int"))


def lines(words: DataFrame, height: Column | float) -> DataFrame:
    """One row a line: ``texts`` and ``word_ids`` in order."""
    held = F.array_sort(F.collect_list(F.struct("pos_in_line", "text", "word_id")))
    return with_lines(words, height).groupBy(*KEY, "line_no").agg(held.alias("w")).select(*KEY, "line_no", F.transform("w", lambda x: x["text"]).alias("texts"), F.transform("w", lambda x: x["word_id"]).alias("word_ids"))


def reading_text(words: DataFrame, height: Column | float) -> DataFrame:
    """``full_text``: words joined by a space, lines by a line break."""
    line = lines(words, height).select(*KEY, "line_no", F.array_join("texts", " ").alias("line"))
    return line.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("full_text"))


def char_width(words: DataFrame) -> DataFrame:
    """``char_width`` of each page: all widths over all lengths, of words with both."""
    some = (F.length("text") > 0) & (F.col("width") > 0)
    return words.groupBy(*KEY).agg(F.coalesce(F.sum(F.when(some, F.col("width"))) / F.sum(F.when(some, F.length("text"))), F.lit(USUAL_CHAR)).alias("char_width"))


def column_starts(lined: DataFrame, gap: Column) -> DataFrame:
    """Words of ``lined`` that begin a column of their line: the first, and those more than ``gap`` right of the word before."""
    line = Window.partitionBy(*KEY, "line_no").orderBy("pos_in_line")
    before = F.lag(F.col("left") + F.col("width")).over(line)
    return lined.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("left") - F.col("_before") > gap)).drop("_before")


def guide_line(words: DataFrame, height: Column | float) -> DataFrame:
    """``line_no, score`` of the line whose starts most other lines' words confirm, the earliest of equals."""
    lined = with_lines(words, height)
    lined = lined.hint("merge").join(char_width(words), KEY)
    starts = column_starts(lined, F.col("char_width") * GAP_CHARS).select(*KEY, "line_no", "pos_in_line", F.col("left").alias("start"), (F.col("char_width") * TOLERANCE_CHARS).alias("tolerance"))
    other = lined.select(*KEY, F.col("line_no").alias("other_line"), F.col("left").alias("other_left"))
    # a word can lie within the tolerance only in the start's own cell of that size or one beside it
    cell = lambda x, t: F.floor(x / F.greatest(t, F.lit(1e-9)))
    others = other.hint("merge").join(char_width(words), KEY).withColumn("cell", F.explode(F.array(*[cell(F.col("other_left"), F.col("char_width") * TOLERANCE_CHARS) + i for i in (-1, 0, 1)]))).drop("char_width")
    starts = starts.withColumn("cell", cell(F.col("start"), F.col("tolerance")))
    confirmed = starts.hint("merge").join(others, [*KEY, "cell"]).filter((F.col("other_line") != F.col("line_no")) & (F.abs(F.col("start") - F.col("other_left")) <= F.col("tolerance"))).select(*KEY, "line_no", "pos_in_line").distinct()
    score = lined.select(*KEY, "line_no").distinct().hint("merge").join(confirmed.groupBy(*KEY, "line_no").agg(F.count("*").alias("score")), [*KEY, "line_no"], "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))
    best = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("score").desc(), "line_no"))
    return score.withColumn("_best", best).filter("_best = 1").drop("_best")


def table_text(words: DataFrame, height: Column | float) -> DataFrame:
    """``table_text``: the page with its columns lined up by spaces under the start line."""
    lined = with_lines(words, height)
    chosen = guide_line(words, height).select(*KEY, "line_no")
    sized = lined.hint("merge").join(char_width(words), KEY)
    starts = column_starts(sized.hint("merge").join(chosen, [*KEY, "line_no"], "left_semi"), F.col("char_width") * GAP_CHARS).groupBy(*KEY).agg(F.sort_array(F.collect_list("left")).alias("starts"))
    sized = sized.hint("merge").join(starts, KEY, "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<double>")))
    reach = F.size(F.filter("starts", lambda a: a <= F.col("left") + F.col("char_width") / 2))
    placed = sized.withColumn("col", F.greatest(F.lit(0), reach - 1))
    held = F.array_sort(F.collect_list(F.struct("pos_in_line", "text", "col"))).alias("w")
    per_line = placed.groupBy(*KEY, "line_no").agg(held, F.first("starts").alias("starts"), F.first("char_width").alias("char_width"))

    def put(acc: Column, w: Column) -> Column:
        target = F.round(F.element_at(F.col("starts"), w["col"] + 1) / F.col("char_width")).cast("int")
        same = w["col"] == acc["col"]
        fill = F.when(same, F.lit(" ")).when(acc["text"] == "", F.repeat(F.lit(" "), F.coalesce(target, F.lit(0)))).when(F.length(acc["text"]) >= target, F.lit(" ")).otherwise(F.repeat(F.lit(" "), target - F.length(acc["text"])))
        return F.struct(F.concat(acc["text"], fill, w["text"]).alias("text"), w["col"].alias("col"))

    line = F.aggregate("w", F.struct(F.lit("").alias("text"), F.lit(-1).alias("col")), put)["text"]
    return per_line.select(*KEY, "line_no", line.alias("line")).groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("table_text"))


def sanitized(words: DataFrame, height: Column | float) -> DataFrame:
    """Words in reading order without pipes at their ends; a word of nothing else stays as it was, an empty one goes."""
    bare = trim(F.regexp_replace("text", r"\A\|+|\|+\z", ""))
    kept = sorted_words(words, height).withColumn("text", F.when(bare != "", bare).otherwise(F.col("text"))).filter("text != ''")
    order = F.row_number().over(Window.partitionBy(*KEY).orderBy("reading_ord")) - 1
    return kept.withColumn("word_ord", order.cast("int")).drop("reading_ord")


def union_box(df: DataFrame, keys: list[str]) -> DataFrame:
    right, bottom = F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    return df.groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"), (right - F.min("left")).alias("width"), (bottom - F.min("top")).alias("height"))


def source_boxes(cells: DataFrame, words: DataFrame) -> DataFrame:
    """The box around each cell's words; none if it has no word or one of them is gone. Cells: KEY, row_index, col_index, word_ids."""
    at = [*KEY, "row_index", "col_index"]
    ids = cells.select(*at, F.size("word_ids").alias("wanted"), F.explode("word_ids").alias("word_id"))
    found = ids.hint("merge").join(words.select(*KEY, "word_id", "left", "top", "width", "height"), [*KEY, "word_id"])
    boxes = union_box(found, [*at, "wanted"]).hint("merge").join(found.groupBy(*at).agg(F.count("*").alias("found")), at).filter("found = wanted").select(*at, "left", "top", "width", "height")
    return cells.select(*at).hint("merge").join(boxes, at, "left")


def edited_words(words: DataFrame, log: DataFrame, height: Column | float) -> DataFrame:
    """Words after an edit log (KEY, word_id, action 'add', 'edit' or 'delete', text, left, top, width, height), in reading order.

    What was added or edited has confidence 100; an edit to blank text deletes; an edit of an unknown word does nothing.
    """
    change = log.withColumn("text", trim(F.col("text")))
    gone = change.filter("action = 'delete' or (action = 'edit' and text = '')").select(*KEY, "word_id")
    new_text = change.filter("action = 'edit' and text != ''").select(*KEY, "word_id", F.col("text").alias("new_text"))
    kept = words.hint("merge").join(gone, [*KEY, "word_id"], "left_anti").hint("merge").join(new_text, [*KEY, "word_id"], "left")
    kept = kept.withColumn("confidence", F.when(F.col("new_text").isNotNull(), 100.0).otherwise(F.col("confidence"))).withColumn("text", F.coalesce("new_text", "text")).drop("new_text")
    added = change.filter("action = 'add' and text != ''").select(*KEY, F.lit(1 << 30).alias("word_ord"), "word_id", "text", F.lit(100.0).alias("confidence"), "left", "top", "width", "height")
    return sorted_words(kept.select(*added.columns).unionAll(added), height)


def overlay(words: DataFrame, mode: str = "issues", least: float = 85.0) -> DataFrame:
    """``hue`` of every word, and whether it is ``dim``: sure words, where only issues are shown. Mode 'none' shows no word."""
    shown = words.withColumn("hue", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("confidence"))) / 100 * 120)
    return shown.withColumn("dim", (F.col("confidence") >= least) if mode == "issues" else F.lit(False)).filter(F.lit(mode != "none"))


def prompt(instructions: str, pages: DataFrame) -> DataFrame:
    """``prompt`` of each page: the instructions, then its lined-up text."""
    return pages.select(*KEY, F.concat_ws("\n\n", F.lit(instructions), F.col("table_text")).alias("prompt"))
