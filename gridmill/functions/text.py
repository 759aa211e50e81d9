"""Column functions over strings: normal forms, likeness, budgets, escapes, snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a script language trims it; Java's \s is ASCII only.
WS = r"[\s\x0B   -     　﻿]"
CONTEXT_TOKENS, PROMPT_RESERVE, LEAST_OUTPUT = 8192, 1024, 256
EXCERPT_MARK = "[... more lines left out ...]"
SNIPPET_CONTEXT = 48
STEM_LENGTH = 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{WS}+|{WS}+\z", "")


def normalize(s: Column) -> Column:
    """Lower case, nothing but a-z and 0-9; letters with marks vanish."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def normalize_unicode(s: Column) -> Column:
    """Lower case, letters and digits of any script."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def compact(s: Column) -> Column:
    """Lines without outer and with single inner spaces, blank ones left out. The text is gone over as a whole, not line by line."""
    spaced = F.regexp_replace(s, rf"[{WS}&&[^\n]]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, " ?\n[ \n]*", "\n"), r"\A[ \n]|[ \n]\z", "")


def lines(s: Column) -> Column:
    """The lines of ``compact``."""
    return F.filter(F.split(compact(s), "\n"), lambda x: x != "")


def excerpt(s: Column, most_lines: int, most_chars: int) -> Column:
    """Compact lines while both limits hold, the last cut to what is left (a line costs one more for its break); a mark if whole lines were left out."""
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("used"))

    def take(acc: Column, line: Column) -> Column:
        room = F.lit(most_chars) - acc["used"]
        piece = F.substring(line, F.lit(1), room)
        return F.when(room > 0, F.struct(F.concat(acc["taken"], F.array(piece)).alias("taken"), (acc["used"] + F.length(piece) + 1).alias("used"))).otherwise(acc)

    def shown(all_lines: Column) -> Column:
        taken = F.aggregate(F.slice(all_lines, 1, most_lines), start, take)["taken"]
        return let(taken, lambda t: F.array_join(F.when(F.size(t) < F.size(all_lines), F.concat(t, F.array(F.lit(EXCERPT_MARK)))).otherwise(t), "\n"))

    return let(lines(s), shown)


def estimated_tokens(s: Column) -> Column:
    return F.ceil(F.length(s) / 4).cast("long")


def budget(s: Column) -> Column:
    """prompt, available and overflow of an extraction prompt with this text."""
    prompt = F.lit(PROMPT_RESERVE) + estimated_tokens(s)
    available = F.greatest(F.lit(0), F.lit(CONTEXT_TOKENS) - prompt)
    return F.struct(prompt.cast("long").alias("prompt_tokens"), available.cast("long").alias("available_tokens"), (available < LEAST_OUTPUT).alias("overflow"))


def output_target(words: Column, available: Column, boost: Column) -> Column:
    """Four tokens a word, or all there is if boosted; never under the least, even on overflow."""
    desired = F.greatest(F.lit(LEAST_OUTPUT), words * 4)
    return F.greatest(F.lit(LEAST_OUTPUT), F.least(F.when(boost, available).otherwise(desired), available)).cast("long")


def fold_ascii(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def contains_folded(s: Column, term: str) -> Column:
    """As LIKE '%term%' that ignores the case of ASCII letters only, with no wildcard in the term."""
    return F.contains(fold_ascii(s), F.lit(term.translate(str.maketrans(UPPER, LOWER))))


def escape_like(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\%_])", r"\\$1")


def snippet(s: Column, term: str) -> Column:
    """before, match and after of the first hit of a term in the text with single spaces, whatever the case; null without a hit, or for an empty term."""
    if not term:
        return F.lit(None).cast("struct<before:string,match:string,after:string>")

    def cut(flat: Column, at: Column) -> Column:
        start, end = F.greatest(F.lit(1), at - SNIPPET_CONTEXT), at + len(term)
        before = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(flat, start, at - start))
        after = F.concat(F.substring(flat, end, F.lit(SNIPPET_CONTEXT)), F.when(end + SNIPPET_CONTEXT <= F.length(flat), "…").otherwise(""))
        return F.when(at > 0, F.struct(before.alias("before"), F.substring(flat, at, F.lit(len(term))).alias("match"), after.alias("after")))

    flat = trim(F.regexp_replace(s, rf"{WS}+", " "))
    return let(flat, lambda f: let(F.locate(term.lower(), F.lower(f)), lambda at: cut(f, at)))


def char_start(source: Column, value: Column) -> Column:
    """Where a value first stands in its source, from 0, whatever a model said; -1 where it doesn't, or is empty."""
    return F.when(value != "", F.instr(source, value) - 1).otherwise(-1)


# -- escapes for export -----------------------------------------------------

#: Fixed value: what counts as a plain number, which needs no guard.
NUMBER = r"\A[+-]?[$€£¥]?\d[\d,\s]*(\.\d+)?([eE][+-]?\d+)?%?\z"
FORMULA = r"\A[=+\-@\t\r]"


def guard_formula(s: Column) -> Column:
    """An apostrophe before what a spreadsheet would run as a formula; plain numbers stay."""
    return F.when(s.rlike(FORMULA) & ~s.rlike(NUMBER), F.concat(F.lit("'"), s)).otherwise(s)


def escape_csv(s: Column) -> Column:
    return F.when(s.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def escape_clipboard(s: Column) -> Column:
    return F.when(s.rlike('[\t"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_markdown(s: Column) -> Column:
    s = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(s, r"\s*\r?\n\s*", " ")


def pad(s: Column, width: Column) -> Column:
    return F.concat(s, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(s))))


def file_stem(name: Column, page: Column, pages: Column) -> Column:
    """A safe name for an export, of at most STEM_LENGTH characters before the suffixes; the cut is last and may leave an underscore."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]+\z", "")
    stem = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_-]", "_"), "_+", "_")
    stem = F.substring(F.regexp_replace(stem, r"\A_|_\z", ""), 1, STEM_LENGTH)
    stem = F.when(stem == "", F.lit("extraction")).otherwise(stem)
    return F.concat(stem, F.when(pages > 1, F.concat(F.lit("_p"), (page + 1).cast("string"))).otherwise(""), F.lit("_extract"))


def column_label(i: Column) -> Column:
    """A, B, ... Z, AA, ... for a column number from 0, with as many letters as it needs; a long needs 14 at most."""
    start = F.struct(F.lit("").alias("label"), i.cast("long").alias("left"))

    def step(x: Column, _: Column) -> Column:
        left = x["left"]
        letter = F.char(F.lit(65).cast("long") + left % F.lit(26).cast("long"))
        return F.when(left < 0, x).otherwise(F.struct(F.concat(letter, x["label"]).alias("label"), (F.call_function("div", left, F.lit(26).cast("long")) - F.lit(1).cast("long")).alias("left")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["label"]


def shown_timestamp(s: Column) -> Column:
    """A stored timestamp without zone, read as UTC, as a date; what can't be read stays as it is."""
    shaped = s.rlike(r"\A\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?\z")
    return F.coalesce(F.when(shaped, F.date_format(F.try_to_timestamp(F.regexp_replace(s, "T", " ")), "yyyy-MM-dd")), s)
