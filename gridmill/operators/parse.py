"""From model output and stored text to cells and tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "page_index"]
_SPACE = " \t\n\r\x0b\x0c\xa0    　﻿"


def tsv_cells(raw: str) -> list[tuple[int, int, str, int, int]]:
    """(row, column, value, start, end) of each cell. A fence at either end is left out but counts in offsets; blank rows go."""
    head = re.match(r"```[a-z]*\r?\n?", raw, re.I)
    tail = re.search(r"\r?\n?```\s*\Z", raw)
    start, end = head.end() if head else 0, tail.start() if tail else len(raw)
    rows, number = [], 0
    for line in re.compile(r"[^\r\n]+").finditer(raw, start, max(start, end)):
        at, cells = line.start(), []
        for c, value in enumerate(line[0].split("\t")):
            cells.append((number, c, value.strip(_SPACE), at, at + len(value)))
            at += len(value) + 1
        if any(x[2] for x in cells):
            rows += cells
            number += 1
    return rows


_CSV = re.compile(r'"((?:[^"]|"")*)(?:"|\Z)|(,)|(\n)|\r|([^",\n\r]+)')


def csv_rows(raw: str) -> list[list[str]]:
    """Rows of comma-separated text, fields trimmed, fences and blank rows left out. A carriage return outside quotes is nothing."""
    text = re.sub(r"\n?```\s*\Z", "", re.sub(r"\A```[a-z]*\n?", "", raw, flags=re.I))
    rows, row, field, some = [], [], [], False

    def end_row() -> None:
        row.append("".join(field).strip(_SPACE))
        if row != [""]:
            rows.append(row.copy())
        row.clear()
        field.clear()

    for m in _CSV.finditer(text):
        if m[2]:
            row.append("".join(field).strip(_SPACE))
            field.clear()
            some = False
        elif m[3]:
            end_row()
            some = False
        elif m[1] is not None or m[4]:
            field.append(m[1].replace('""', '"') if m[1] is not None else m[4])
            some = True
    if some or row:
        end_row()
    return rows


_QUOTED = re.compile(r'"((?:[^"]|"")*)(?:"|\Z)')
_PLAIN = re.compile(r"[^\t\r\n]")


def clipboard_rows(text: str) -> list[list[str]]:
    """Rows of tab-separated text; a quote opens at the start of a field only, nothing is trimmed, and an end of line at the end makes no row."""
    rows, row, field, at = [], [], "", 0
    while at < len(text):
        if field == "" and (m := _QUOTED.match(text, at)):
            field, at = m[1].replace('""', '"'), m.end()
        elif text[at] == "\t":
            row.append(field)
            field, at = "", at + 1
        elif text[at] in "\r\n":
            rows.append([*row, field])
            row, field, at = [], "", at + (2 if text.startswith("\r\n", at) else 1)
        else:
            end = re.compile(r"[\t\r\n]").search(text, at)
            end = end.start() if end else len(text)
            field, at = field + text[at:end], end
    return [*rows, [*row, field]] if field or row else rows


def parsed_tsv(pages: DataFrame, raw_col: str = "raw") -> DataFrame:
    """One row a cell: KEY, row_index, col_index, value, range_start, range_end. Pages are parsed where they are."""
    schema = pa.schema([("doc_id", pa.int64()), ("page_index", pa.int32()), ("row_index", pa.int32()), ("col_index", pa.int32()), ("value", pa.string()), ("range_start", pa.int32()), ("range_end", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, p, *cell) for d, p, raw in zip(*(c.to_pylist() for c in b.columns), strict=True) for cell in tsv_cells(raw or "")]
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 20_000], strict=True), schema, strict=True)], schema=schema)

    return pages.select(F.col("doc_id").cast("long"), F.col("page_index").cast("int"), F.col(raw_col).cast("string")).mapInArrow(run, "doc_id long, page_index int, row_index int, col_index int, value string, range_start int, range_end int")


def parsed_rows(df: DataFrame, id_col: str, raw_col: str, dialect: str) -> DataFrame:
    """``id_col, rows``: the rows of stored text by the 'csv' or 'clipboard' dialect."""
    parse = {"csv": csv_rows, "clipboard": clipboard_rows}[dialect]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(x or "") for x in b.column(1).to_pylist()], pa.list_(pa.list_(pa.string())))], names=[id_col, "rows"])

    return df.select(id_col, F.col(raw_col).cast("string").alias("raw")).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, rows array<array<string>>")


def padded(cells: DataFrame) -> DataFrame:
    """Cells of a rectangle: blank ones where a row is shorter than the widest of its page."""
    width = cells.groupBy(*KEY).agg(F.max("col_index").alias("_last"))
    frame = cells.select(*KEY, "row_index").distinct().hint("merge").join(width, KEY).select(*KEY, "row_index", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("col_index"))
    return frame.hint("merge").join(cells, [*KEY, "row_index", "col_index"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def blank_cell(row: Column, col: Column) -> Column:
    """What a cell is that nothing is known of: empty, in agreement, trusted."""
    none = lambda t: F.lit(None).cast(t)
    return F.struct(row.alias("row_index"), col.alias("col_index"), F.lit("").alias("value"), F.array().cast("array<string>").alias("word_ids"), F.lit("empty").alias("match_status"), none("double").alias("llm_mean"), none("double").alias("llm_min"), none("double").alias("ocr"), F.lit("agree").alias("agreement"), F.lit("high").alias("trust"), F.lit(False).alias("verified"), F.lit(False).alias("edited"))


# -- token streams ----------------------------------------------------------

CHUNK = "struct<choices:array<struct<delta:struct<content:string,reasoning_content:string,reasoning:string,thinking:string>,finish_reason:string,logprobs:struct<content:array<struct<token:string,logprob:string>>>>>>"


def read_lines(lines: DataFrame) -> DataFrame:
    """Lines of event streams (request_id, line_no, line) with ``c``: the first choice of a data line, null where there is none that can be read."""
    body = F.regexp_replace(F.substring(F.col("line"), F.lit(7), F.length("line")), r"\A\s+|\s+\z", "")
    data = F.when(F.col("line").startswith("data: ") & ~body.isin("", "[DONE]"), body)
    return lines.withColumn("c", F.from_json(data, CHUNK)["choices"][0])


def chunks(lines: DataFrame) -> DataFrame:
    return read_lines(lines).filter("c is not null")


def stream_tokens(lines: DataFrame) -> DataFrame:
    """``request_id, seq, token, logprob, char_offset`` of streams. A delta without log-probabilities is one token; a logprob that is no number is null."""
    listed = F.filter(F.col("c.logprobs.content"), lambda x: F.coalesce(x["token"], F.lit("")) != "")
    as_token = F.transform(listed, lambda x: F.struct(x["token"].alias("token"), x["logprob"].try_cast("double").alias("logprob")))
    alone = F.when(F.coalesce(F.col("c.delta.content"), F.lit("")) != "", F.array(F.struct(F.col("c.delta.content").alias("token"), F.lit(None).cast("double").alias("logprob"))))
    found = F.when(F.size(F.coalesce(F.col("c.logprobs.content"), F.array())) > 0, as_token).otherwise(alone)
    each = chunks(lines).select("request_id", "line_no", F.posexplode(found).alias("k", "t")).select("request_id", "line_no", "k", "t.token", "t.logprob")
    order = Window.partitionBy("request_id").orderBy("line_no", "k")
    offset = F.coalesce(F.sum(F.length("token")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return each.select("request_id", (F.row_number().over(order) - 1).cast("int").alias("seq"), "token", "logprob", offset.alias("char_offset"))


def stream_ends(lines: DataFrame) -> DataFrame:
    """``request_id, finish_reason, truncated``: the last reason that a stream gave, and whether it was its length."""
    last = F.max_by(F.col("c.finish_reason"), F.when(F.coalesce(F.col("c.finish_reason"), F.lit("")) != "", F.col("line_no")))
    return chunks(lines).groupBy("request_id").agg(last.alias("finish_reason")).withColumn("truncated", F.coalesce(F.col("finish_reason") == "length", F.lit(False)))


def no_signal(tokens: DataFrame) -> DataFrame:
    """Requests that gave text and not one usable log-probability."""
    return tokens.groupBy("request_id").agg(F.count("logprob").alias("n"), F.sum(F.length("token")).alias("chars")).filter("n = 0 and chars > 0").select("request_id")


def chat_split(lines: DataFrame, placeholder: str = "(no answer)") -> DataFrame:
    """``request_id, thinking, content``: what a chat stream reasoned and what it said, trimmed; a placeholder where it did neither."""
    d = F.col("c.delta")
    thought = F.coalesce(d["reasoning"], d["thinking"], d["reasoning_content"], F.lit(""))
    held = F.array_sort(F.collect_list(F.struct("line_no", thought.alias("t"), F.coalesce(d["content"], F.lit("")).alias("s"))))
    trimmed = lambda field: F.regexp_replace(F.array_join(F.transform("h", lambda x: x[field]), ""), r"\A\s+|\s+\z", "")
    both = read_lines(lines).groupBy("request_id").agg(held.alias("h")).select("request_id", trimmed("t").alias("thinking"), trimmed("s").alias("content"))
    return both.withColumn("content", F.when((F.col("thinking") == "") & (F.col("content") == ""), placeholder).otherwise(F.col("content")))


def token_offsets(tokens: DataFrame) -> DataFrame:
    """Adds ``char_offset``: where in its page's text each token begins."""
    order = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("char_offset", F.coalesce(F.sum(F.length("token")).over(order), F.lit(0)).cast("int"))


def logprob_summary(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, mean, least and greatest log-probability, and a verdict on whether a stream carries them."""
    n, some = F.count("*"), F.count("logprob")
    verdict = F.when(n == 0, "no output").when(some == n, "PASS").when(some > 0, "PARTIAL").otherwise("FAIL")
    return tokens.groupBy(*keys).agg(some.alias("with_logprob"), (n - some).alias("without_logprob"), F.avg("logprob").alias("mean"), F.min("logprob").alias("least"), F.max("logprob").alias("greatest"), verdict.alias("verdict"))


def chat_messages(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, content``: as sent to a model, by 'assistant' or else by 'user'. Text alone is a plain string.

    ``attachments`` (type, data in base64), if turns have them, come before the text as parts, in JSON; without either, there is no part.
    """
    part = "type string, image_url struct<url:string>, text string"
    none = F.lit(None)
    text = F.struct(F.lit("text").alias("type"), none.cast("struct<url:string>").alias("image_url"), F.col("text").alias("text")).cast(f"struct<{part.replace(' ', ':').replace(',:', ',')}>")
    some = F.coalesce(F.col("attachments"), F.array().cast("array<struct<type:string,data:string>>")) if "attachments" in turns.columns else F.array().cast("array<struct<type:string,data:string>>")
    images = F.transform(some, lambda a: F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("data:"), a["type"], F.lit(";base64,"), a["data"]).alias("url")).alias("image_url"), none.cast("string").alias("text")))
    said = F.coalesce(F.col("text"), F.lit("")) != ""
    parts = F.concat(images, F.when(said, F.array(text)).otherwise(F.array().cast(f"array<struct<{part.replace(' ', ':').replace(',:', ',')}>>")))
    content = F.when(said & (F.size(some) == 0), F.col("text")).otherwise(F.to_json(parts))
    return turns.select("conv_id", "turn", F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), content.alias("content"))


# -- layout blocks ----------------------------------------------------------

_DIV = re.compile(r"<div\b([^>]*)>|</div\s*>", re.I)


def top_divs(html: str) -> list[tuple[str, str]]:
    """(attributes, inner text) of each outermost div; a closing tag too many is nothing, an unclosed div gives none.

    Tags are counted up and down all at once; the count less its least value so far, under zero, is the depth.
    """
    tags = list(_DIV.finditer(html))
    if not tags:
        return []
    count = np.cumsum([1 if m[1] is not None else -1 for m in tags])
    depth = count - np.minimum(np.minimum.accumulate(count), 0)
    before = np.concatenate([[0], depth[:-1]])
    opens, closes = np.flatnonzero((before == 0) & (depth == 1)), np.flatnonzero((before == 1) & (depth == 0))
    return [(tags[i][1], html[tags[i].end() : tags[j].start()]) for i, j in zip(opens.tolist(), closes.tolist())]  # noqa: B905, the last may be open


#: Fixed value: what counts as a number of a box.
BOX_NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", label: str = "data-label", loose: bool = False) -> DataFrame:
    """``page_id, block_no, label, bbox, text`` of the outermost divs. ``bbox`` is data-bbox where that is four numbers parted by white space, else null; ``loose`` takes commas and brackets too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, a, inner) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, (a, inner) in enumerate(top_divs(h or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["page_id", "block_no", "attributes", "inner"])

    found = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, block_no int, attributes string, inner string")
    attribute = lambda name: F.regexp_extract("attributes", rf'(?i){name}\s*=\s*"([^"]*)"', 1)
    listed = F.regexp_replace(attribute("data-bbox"), r"[\[\],]", " ") if loose else attribute("data-bbox")
    box = F.split(F.trim(F.regexp_replace(listed, r"\s+", " ")), " ")
    numbers = F.when((F.size(box) == 4) & F.forall(box, lambda x: x.rlike(rf"\A{BOX_NUMBER}\z")), F.transform(box, lambda x: x.try_cast("double")))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("inner", "<[^>]*>", " "), "&nbsp;", " "), r"\s+", " ")
    return found.select("page_id", "block_no", attribute(label).alias("label"), numbers.alias("bbox"), F.trim(text).alias("text"))
