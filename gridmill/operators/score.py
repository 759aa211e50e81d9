"""Confidence of cells: from token log-probabilities, OCR confidences and the match of both. Cells: KEY, row_index, col_index, value, range_start, range_end, word_ids, match_status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.text import normalize, trim

KEY = ["doc_id", "page_index"]
CELL = [*KEY, "row_index", "col_index"]
HIGH, MEDIUM, LEAST_MIN = 0.85, 0.65, 0.5
LLM_SHARE, OCR_SHARE = 0.4, 0.6
#: Characters of a page's text that tokens and cells are dealt by.
STRETCH = 64


def tokens_of_cells(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """Each token with the cell it overlaps most, the first in reading order of equals; a token that overlaps none is left out. Tokens have ``char_offset``.

    Tokens and cells meet in stretches of ``STRETCH`` characters, so a token meets the cells about it and not its whole page's;
    a pair that shares several stretches counts in the first.
    """
    stretches = lambda a, b: F.sequence(F.floor(a / STRETCH), F.floor((b - 1) / STRETCH))
    t = tokens.select(*KEY, "seq", "token", "logprob", F.col("char_offset").alias("t0"), (F.col("char_offset") + F.length("token")).alias("t1")).filter("t1 > t0")
    t = t.withColumn("_at", F.explode(stretches(F.col("t0"), F.col("t1"))))
    c = cells.filter("range_end > range_start").select(*CELL, "range_start", "range_end", F.explode(stretches(F.col("range_start"), F.col("range_end"))).alias("_at"))
    overlap = F.least("t1", "range_end") - F.greatest("t0", "range_start")
    first = F.col("_at") == F.floor(F.greatest("t0", "range_start") / STRETCH)
    met = t.hint("merge").join(c, [*KEY, "_at"]).filter(first).drop("_at").withColumn("overlap", overlap).filter("overlap > 0")
    best = F.row_number().over(Window.partitionBy(*KEY, "seq").orderBy(F.col("overlap").desc(), "row_index", "col_index"))
    return met.withColumn("_best", best).filter("_best = 1").drop("_best")


def llm_scores(credited: DataFrame) -> DataFrame:
    """``llm_mean`` (geometric) and ``llm_min`` of each cell, of tokens that begin inside it and have a log-probability."""
    return credited.filter("t0 >= range_start and logprob is not null").groupBy(*CELL).agg(F.exp(F.avg("logprob")).alias("llm_mean"), F.exp(F.min("logprob")).alias("llm_min"))


def ocr_scores(cells: DataFrame, words: DataFrame) -> DataFrame:
    """``ocr``: mean confidence of a cell's words that are still there."""
    ids = cells.select(*CELL, F.explode("word_ids").alias("word_id"))
    return ids.hint("merge").join(words.select(*KEY, "word_id", "confidence"), [*KEY, "word_id"]).groupBy(*CELL).agg(F.avg("confidence").alias("ocr"))


def agreement(status: Column, word_ids: Column) -> Column:
    return F.when(status == "unmatched", "image_only").when((status == "empty") & (F.size(word_ids) > 0), "disagree").otherwise("agree")


def trust(agree: Column, llm_mean: Column, llm_min: Column, ocr: Column) -> Column:
    o = F.coalesce(ocr, F.lit(0.0)) / 100
    blend = F.lit(LLM_SHARE) * llm_mean + F.lit(OCR_SHARE) * o
    ladder = lambda x, high: F.when(high, "high").when(x >= MEDIUM, "medium").otherwise("low")
    image_only = F.when(llm_mean.isNotNull() & (llm_mean >= HIGH), "medium").otherwise("low")
    agreed = F.when(llm_mean.isNull(), ladder(o, o >= HIGH)).otherwise(ladder(blend, (blend >= HIGH) & (llm_min >= LEAST_MIN)))
    return F.when(agree == "disagree", "low").when(agree == "image_only", image_only).otherwise(agreed)


def demoted(level: Column, status: Column) -> Column:
    """A fuzzy match is trusted one step less."""
    return F.when(status == "fuzzy", F.when(level == "high", "medium").otherwise("low")).otherwise(level)


def scored(cells: DataFrame, tokens: DataFrame, words: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Cells with llm_mean, llm_min, ocr, agreement and trust. An empty cell in agreement is trusted, one with overlooked words is not; neither is scored by tokens.

    ``cells`` are read once, so that what made them (a match) runs once: tokens are credited by ``ranges`` (the parsed cells,
    if given), and word confidences come as one map a page.
    """
    llm = llm_scores(tokens_of_cells(tokens, cells if ranges is None else ranges))
    page = words.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("word_id", "confidence"))).alias("_words"))
    known = F.filter(F.transform("word_ids", lambda i: F.try_element_at("_words", i)), lambda x: x.isNotNull())
    mean = F.aggregate("_known", F.lit(0.0), lambda a, x: a + x) / F.size("_known")
    full = cells.hint("merge").join(page, KEY, "left").withColumn("_known", known).withColumn("ocr", F.when(F.size("_known") > 0, mean)).drop("_known", "_words").hint("merge").join(llm, CELL, "left")
    empty = F.col("match_status") == "empty"
    full = full.withColumn("agreement", agreement(F.col("match_status"), F.col("word_ids")))
    level = demoted(trust(F.col("agreement"), F.col("llm_mean"), F.col("llm_min"), F.col("ocr")), F.col("match_status"))
    full = full.withColumn("trust", F.when(empty, F.when(F.col("agreement") == "disagree", "low").otherwise("high")).otherwise(level))
    return full.withColumns({c: F.when(~empty, F.col(c)) for c in ("llm_mean", "llm_min", "ocr")})


def needs_review(verified: Column, level: Column) -> Column:
    return ~F.coalesce(verified, F.lit(False)) & (level != "high")


def worklist(cells: DataFrame) -> DataFrame:
    """Cells to review in reading order, each with the next and the one before; the ends meet. Cells have ``verified`` and ``trust``."""
    flagged = cells.filter(needs_review(F.col("verified"), F.col("trust"))).select(*CELL, "trust")
    order, page = Window.partitionBy(*KEY).orderBy("row_index", "col_index"), Window.partitionBy(*KEY).orderBy("row_index", "col_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct("row_index", "col_index")
    return flagged.select("*", F.coalesce(F.lead(at).over(order), F.first(at).over(page)).alias("next"), F.coalesce(F.lag(at).over(order), F.last(at).over(page)).alias("previous"))


def next_flagged(cells: DataFrame, selection: DataFrame) -> DataFrame:
    """The flagged cells after and before a selected one (KEY, row_index, col_index), flagged or not; the ends meet. None if no cell is flagged."""
    flagged = cells.filter(needs_review(F.col("verified"), F.col("trust"))).select(*KEY, F.struct("row_index", "col_index").alias("f"))
    at = F.struct("row_index", "col_index").alias("s")
    both = selection.select(*KEY, at).hint("merge").join(flagged, KEY)
    after, before = F.min(F.when(F.col("f") > F.col("s"), F.col("f"))), F.max(F.when(F.col("f") < F.col("s"), F.col("f")))
    return both.groupBy(*KEY, "s").agg(F.coalesce(after, F.min("f")).alias("next"), F.coalesce(before, F.max("f")).alias("previous")).select(*KEY, "s.*", "next", "previous")


def overlooked(status: Column, word_ids: Column) -> Column:
    return (status == "empty") & (F.size(word_ids) > 0)


def display_class(verified: Column, status: Column, word_ids: Column, value: Column, agree: Column, level: Column) -> Column:
    return F.when(verified, "high").when(overlooked(status, word_ids), "low").when((status == "empty") | (trim(value) == ""), "neutral").when(agree == "image_only", "image_only").otherwise(level)


def tooltip(level: Column, llm_mean: Column, ocr: Column) -> Column:
    percent = lambda x, none: F.when(x.isNull(), none).otherwise(F.concat(F.round(x).cast("int").cast("string"), F.lit("%")))
    return F.concat(F.lit("Trust: "), level, F.lit("; model: "), percent(llm_mean * 100, "not scored"), F.lit("; OCR: "), percent(ocr, "N/A"))


def is_empty(value: Column) -> Column:
    """Whether a cell counts as empty: nothing of it is a letter a-z or a digit."""
    return normalize(value) == ""
