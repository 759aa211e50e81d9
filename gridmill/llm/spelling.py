"""Spelling variants of a corpus's words, by anagram hashing.

A word's key is the sum of its letters' fifth powers, so anagrams have one key, and a letter more, less or exchanged changes it
by that letter's value. Keys meet first: an integer with one letter taken off is looked up among whole keys (a letter added
or removed) and among other keys with one letter off (a letter exchanged). Only letters that a meeting of keys allows are then
taken off the words themselves, place by place, and words meet where what is left stands in the same order; a hash says so,
and the words of each pair are compared at that place.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import batch, checkpointed, shared_folder, strings

LETTERS = "a-zÀ-ÿ"
NO_LETTER = re.compile(f"[^{LETTERS}]")
POWER = 5
#: Characters of a text that are cut into words at once, and of the words that a task counts before it sends them.
AT_ONCE, MOST_COUNTED = 4_000_000, 16_000_000
ROWS = 50_000
#: Keys are taken by this modulus, so that no word is too long for one.
KEYS = 1 << 62
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def _signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def value(letter: int) -> int:
    return letter**POWER


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about ``AT_ONCE`` characters that cut no word."""
    start = 0
    while start < len(text):
        end = NO_LETTER.search(text, start + AT_ONCE) if start + AT_ONCE < len(text) else None
        stop = end.start() if end else len(text)
        yield text[start:stop]
        start = stop


def counted(docs: DataFrame, least_length: int, every: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: how often each run of letters stands in all texts. If ``every`` divides the crc32 of an id and a run, a letter of it is left out first. A task adds up its own texts before the exchange."""
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        chars = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in stretches(text.encode().lower().decode()):  # bytes lower A-Z only
                    for word, n in Counter(runs.findall(part)).items():
                        if every:
                            h = zlib.crc32(word.encode(), start)
                            if not h % every:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                        if word in held:
                            held[word] += n
                        else:
                            held[word] = n
                            chars += len(word)
                    if chars > MOST_COUNTED:
                        yield batch(schema, [list(held), list(held.values())])
                        held, chars = {}, 0
        yield batch(schema, [list(held), list(held.values())])

    plain = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
    return plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(words: DataFrame) -> DataFrame:
    """``id, word`` with the anagram key and the letters of each word."""
    schema = pa.schema([("id", pa.int64()), ("word", pa.string()), ("key", pa.int64()), ("letters", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(1).to_pylist()
            count = [Counter(map(ord, w)) for w in words]
            yield batch(schema, [b.column(0), b.column(1), [sum(value(x) * n for x, n in c.items()) % KEYS for c in count], [list(c) for c in count]])

    return words.select("id", "word").mapInArrow(run, "id long, word string, key long, letters array<int>")


def _met_keys(keyed: DataFrame) -> DataFrame:
    """For each key that meets another: the letters that may have been added to a shorter word, those that may be exchanged, and whether a longer word may have one more. A key less one letter is shared by at most as many keys as there are letters."""
    value_of = F.pow(F.col("letter").cast("double"), F.lit(float(POWER))).cast("bigint")  # exact: below 2 ** 53
    classes = keyed.select("key", F.explode("letters").alias("letter")).distinct()
    less = classes.select(F.pmod(F.col("key") - value_of, F.lit(KEYS)).alias("rest"), "letter", "key")
    whole = keyed.select(F.col("key").alias("rest"), F.lit(None).cast("int").alias("letter"), "key").distinct()
    of_rest = Window.partitionBy("rest")
    met = less.unionByName(whole).withColumn("others", F.count("letter").over(of_rest)).withColumn("is_key", F.max(F.col("letter").isNull()).over(of_rest))
    return (
        met.groupBy("key")
        .agg(
            F.collect_set(F.when(F.col("is_key"), F.col("letter"))).alias("added"),
            F.collect_set(F.when(F.col("others") > 1, F.col("letter"))).alias("exchanged"),
            F.max(F.col("letter").isNull() & (F.col("others") > 0)).alias("longer"),
        )
        .filter("longer or size(added) > 0 or size(exchanged) > 0")
    )


#: What a row of a word says: the word as it is, the word without the letter at ``place``, the word with a gap there.
WHOLE, WITHOUT, GAP = 0, 1, 2


def orders(word: str, added: set[int], exchanged: set[int], longer: bool) -> Iterator[tuple[int, int, int, int]]:
    """``kind, rest, place, order`` of a word: the key of what is left, and a hash of its letters in their order. Of equal letters in a row only the first is taken off."""
    letters = list(map(ord, word))
    key = sum(map(value, letters))
    power, left, right, above = 1, 0, 0, 1
    for x in letters[1:]:
        right += x * above
        above = above * BASE & MASK
    right &= MASK
    if longer:
        yield WHOLE, key % KEYS, -1, _signed(letters[0] + right * BASE)
    for p, x in enumerate(letters):
        order = _signed(left + right)
        if x in added and (not p or letters[p - 1] != x):
            yield WITHOUT, (key - value(x)) % KEYS, p, order
        if x in exchanged:
            yield GAP, (key - value(x)) % KEYS, p, order
        left = left + x * power & MASK
        if p + 1 < len(letters):
            right = right - letters[p + 1] * power & MASK
        power = power * BASE & MASK


def _ordered(words: DataFrame) -> DataFrame:
    fields = [("kind", pa.int32()), ("rest", pa.int64()), ("place", pa.int32()), ("order", pa.int64()), ("id", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for i, word, added, exchanged, longer in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                for row in orders(word, set(added), set(exchanged), longer):
                    rows.append((*row, i))
                    if len(rows) == ROWS:
                        yield batch(schema, zip(*rows, strict=True))
                        rows = []
        if rows:
            yield batch(schema, zip(*rows, strict=True))

    return words.select("id", "word", "added", "exchanged", "longer").mapInArrow(run, "kind int, rest long, place int, order long, id long")


def _less(word: str, place: str) -> Column:
    """The word without its letter at the place, from 0."""
    return F.concat(F.expr(f"substring({word}, 1, {place})"), F.expr(f"substring({word}, {place} + 2)"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, word_a, n_a, b, word_b, n_b``: each two words of ``id, word, n`` that one added, removed or exchanged letter makes equal, once.

    A meeting holds at most one word for each letter of the alphabet, so no frequent key can grow; words must be distinct.
    """
    keyed = _keyed(words)
    rows = checkpointed(_ordered(keyed.join(_met_keys(keyed), "key")))
    one = lambda kind, name: rows.filter(F.col("kind") == kind).select("rest", "order", "place", F.col("id").alias(name))
    exchanged = one(GAP, "a").join(one(GAP, "b"), ["rest", "order", "place"]).filter("a < b").select("a", "b", "place", F.lit(True).alias("same_length"))
    added = one(WHOLE, "a").drop("place").join(one(WITHOUT, "b"), ["rest", "order"]).select("a", "b", "place", F.lit(False).alias("same_length"))
    named = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = exchanged.unionByName(added).join(named("a"), "a").join(named("b"), "b")
    return pairs.filter(_less("word_b", "place") == F.when(F.col("same_length"), _less("word_a", "place")).otherwise(F.col("word_a"))).drop("place", "same_length")


def followed(links: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms followed to the last, twice as far in each round. A form is several times as frequent as its word, so no chain is long or closed."""
    found = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        after = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = checkpointed(found.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if found.filter("moved").isEmpty():
            return found.drop("moved")
        found = found.drop("moved")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of a corpus with the more frequent spelling that each may stand for.

    Words are the runs of letters (a-z, À-ÿ; A-Z are lowered) of at least ``least_length`` that stand ``least_count`` times in
    all. Returns ``word, form, root, n, n_near, form_n``: ``form`` is the near word of largest ``n`` (of equals the smallest in
    code-point order) if that is ``ratio`` times the word's own, else null; ``root`` the last of the forms that follow.
    ``every`` damages a run here and there, by its document's id, as a test of the grouping. Whole texts are counted, and sent
    as counts only; what follows is of the size of the vocabulary. Null texts have no words, a null id is an empty one; rows
    that repeat count each; an empty table gives no row; other columns are not read. A word may be of any length: it makes
    as many short rows as it has letters.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    path = f"{shared_folder(docs.sparkSession)}/words-{uuid.uuid4().hex}"
    counted(docs, least_length, every, id_col, text_col).filter(F.col("n") >= least_count).select(F.monotonically_increasing_id().alias("id"), "word", "n").write.parquet(path)
    words = docs.sparkSession.read.parquet(path)  # written: ids stay as they are
    pairs = near_pairs(words)
    towards = lambda a, b: pairs.select(F.col(a).alias("id"), F.col(f"word_{b}").alias("near"), F.col(f"n_{b}").alias("near_n"))
    best = towards("a", "b").unionByName(towards("b", "a")).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= F.col("n") * ratio
    known = checkpointed(
        words.join(best, "id", "left").select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n"))
    )
    roots = followed(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
