"""Tables as CSV, HTML, Markdown and plain text. Cells: doc_id, page_index, row_index, col_index, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.text import escape_clipboard, escape_csv, escape_html, escape_markdown, guard_formula, pad

KEY = ["doc_id", "page_index"]


def joined(df: DataFrame, keys: list[str], order: str, value: Column, separator: str, name: str) -> DataFrame:
    """The values of each group joined in order; groups are one page or one row of it."""
    held = F.array_sort(F.collect_list(F.struct(order, value.alias("_v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["_v"]), separator).alias(name))


def delimited(cells: DataFrame, value: Column, tab: str, line_break: str, name: str) -> DataFrame:
    rows = joined(cells, [*KEY, "row_index"], "col_index", value, tab, "_line")
    return joined(rows, KEY, "row_index", F.col("_line"), line_break, name)


def csv(cells: DataFrame) -> DataFrame:
    """``csv``: quoted where needed, rows end by CR LF but for the last."""
    return delimited(cells, escape_csv(F.col("value")), ",", "\r\n", "csv")


def csv_for_export(cells: DataFrame) -> DataFrame:
    """As ``csv``, with formulas guarded; the guard stands inside the quotes."""
    return delimited(cells, escape_csv(guard_formula(F.col("value"))), ",", "\r\n", "csv")


def plain_text(cells: DataFrame) -> DataFrame:
    return delimited(cells, F.col("value"), "\t", "\n", "txt")


def clipboard(cells: DataFrame) -> DataFrame:
    return delimited(cells, escape_clipboard(F.col("value")), "\t", "\n", "tsv")


# The document around a table.
HTML_HEAD = '<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="UTF-8"><title>Exported Table</title></head>\n<body>\n<table border="1" cellpadding="4" cellspacing="0">\n'
HTML_FOOT = "\n</table>\n</body>\n</html>"


def html(cells: DataFrame) -> DataFrame:
    head = F.col("row_index") == 0
    tag = lambda name: F.concat(F.lit(f"<{name}>"), escape_html(F.col("value")), F.lit(f"</{name}>"))
    rows = joined(cells, [*KEY, "row_index"], "col_index", F.when(head, tag("th")).otherwise(tag("td")), "", "_row")
    parts = rows.withColumn("_row", F.concat(F.lit("    <tr>"), F.col("_row"), F.lit("</tr>")))
    body = joined(parts.filter(~head), KEY, "row_index", F.col("_row"), "\n", "_body")
    top = parts.filter(head).select(*KEY, F.col("_row").alias("_head"))
    return top.hint("merge").join(body, KEY, "left").select(*KEY, F.concat(F.lit(HTML_HEAD + "  <thead>\n"), F.col("_head"), F.lit("\n  </thead>\n  <tbody>\n"), F.coalesce("_body", F.lit("")), F.lit("\n  </tbody>" + HTML_FOOT)).alias("html"))


def markdown(cells: DataFrame) -> DataFrame:
    """A pipe table with even columns, three characters wide or more; short rows are padded."""
    from gridmill.operators.parse import padded

    md = padded(cells.select(*KEY, "row_index", "col_index", "value")).withColumn("value", escape_markdown(F.col("value")))
    width = F.greatest(F.lit(3), F.max(F.length("value")).over(Window.partitionBy(*KEY, "col_index")))
    wide = md.withColumn("_width", width)
    rule = wide.filter("row_index = 0").select(*KEY, F.lit(0.5).alias("_row"), "col_index", F.repeat(F.lit("-"), F.col("_width")).alias("_cell"))
    all_rows = wide.select(*KEY, F.col("row_index").cast("double").alias("_row"), "col_index", pad(F.col("value"), F.col("_width")).alias("_cell")).unionAll(rule)
    lines = joined(all_rows, [*KEY, "_row"], "col_index", F.col("_cell"), " | ", "_line")
    return joined(lines, KEY, "_row", F.concat(F.lit("| "), F.col("_line"), F.lit(" |")), "\n", "md")


def overlay_html(blocks: DataFrame) -> DataFrame:
    """Boxes of layout blocks, in percent of a page of 1000 by 1000. Blocks: page_id, block_no, label, bbox (4 numbers or null), text."""
    pct = lambda i: F.format_string("%.1f%%", F.col("bbox")[i] / 10)
    size = lambda a, b: F.format_string("%.1f%%", (F.col("bbox")[b] - F.col("bbox")[a]) / 10)
    box = F.concat(F.lit('<div class="block" style="left:'), pct(0), F.lit(";top:"), pct(1), F.lit(";width:"), size(0, 2), F.lit(";height:"), size(1, 3), F.lit('" title="'), escape_html(F.col("label")), F.lit('"></div>'))
    return joined(blocks.filter("bbox is not null"), ["page_id"], "block_no", box, "\n", "overlay")


#: Format name -> (function of cells, column); None for a format that is written as files.
FORMATS = {"csv": (csv_for_export, "csv"), "xlsx": None, "html": (html, "html"), "md": (markdown, "md"), "txt": (plain_text, "txt")}


def exported(cells: DataFrame, name: str) -> DataFrame:
    """``content`` of each page in a format of text."""
    if FORMATS[name] is None:
        raise ValueError(f"{name} is written by write_pages")
    make, column = FORMATS[name]
    return make(cells).select(*KEY, F.lit(name).alias("format"), F.col(column).alias("content"))


def rows_for_export(pages: DataFrame) -> DataFrame:
    """``rows`` of each page (KEY, cells and stored as arrays of rows): the cells if there are any, else the stored table, else none."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return pages.select(*KEY, F.coalesce(some("cells"), some("stored"), F.array().cast("array<array<string>>")).alias("rows"))
