"""How filters of documents overlap: what each order of them removes, what only one of them finds, and what each costs in good text.

The filter for copies refines a partition of the documents: classes by number of code points, split by the hash of the first
block of bytes, of the next block and so on, each sixteen times longer than the one before. A class of one document leaves
the refinement. What stays is compared by whole texts, and all but the least id of equal texts are marked.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import checkpointed, shared_folder

#: First byte and length of each block; together they cover any text.
BLOCKS = [(sum(1 << 10 + 4 * j for j in range(k)), 1 << 10 + 4 * k) for k in range(6)]
#: Parts that a class is dealt into where it is joined, as one may hold a third of all documents.
SALTS = 16
SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


#: Failure by the text alone, in the order of the bits of a mask. The filter for copies is ``COPIES``, the bit after them.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
    "C": lambda text, words: F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3,
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
COPIES = "E"


def _block_hashes(text: Column) -> Column:
    raw = text.cast("binary")
    return F.array_compact(F.array(*[F.when(F.octet_length(text) > start, F.xxhash64(F.substring(raw, start + 1, min(size, (1 << 31) - 1 - start)))) for start, size in BLOCKS]))


def _step(cls: Column, block: Column, bits: int) -> Column:
    return F.xxhash64(cls, block).bitwiseAND((1 << bits) - 1 if bits < 64 else -1)


def refined(rows: DataFrame, bits: int = 64) -> DataFrame:
    """Rows ``doc_id, n_chars, blocks`` whose class, by length and all block hashes, has another row; with ``cls``, the class.

    A round deals classes into ``SALTS`` parts, so that a class of very many rows is not one task's. Rounds end when no row
    that is left has a further block: after one round for each block of the longest text that some other text still equals.
    """
    alive = rows.withColumn("cls", F.col("n_chars").cast("bigint")).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)).cast("int"))
    done = 0
    while True:
        here = alive.groupBy("cls", "salt").agg(F.count("*").alias("n"))  # a class has SALTS rows here, at most
        shared = here.withColumn("all", F.sum("n").over(Window.partitionBy("cls"))).filter("all > 1").select("cls", "salt")
        alive = checkpointed(alive.join(shared, ["cls", "salt"], "left_semi"))
        longest = alive.agg(F.max(F.size("blocks"))).first()[0] or 0
        if done >= longest:
            return alive.drop("salt")
        alive = alive.withColumn("cls", F.when(F.size("blocks") > done, _step(F.col("cls"), F.col("blocks")[done], bits)).otherwise(F.col("cls")))
        done += 1


def _class_of(blocks: Column, n_chars: Column, bits: int) -> Column:
    """The class that ``refined`` ends at."""
    return F.aggregate(blocks, n_chars.cast("bigint"), lambda cls, block: _step(cls, block, bits))


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Written and read again: nothing before it runs twice, and a later join knows its size."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _first_copies(docs: DataFrame, features: DataFrame, folder: str, bits: int) -> DataFrame:
    """``cls, text, first, texts``: for each class left by the refinement its whole texts with their least id; ``texts`` says how many the class has, and if it is one, ``text`` is null."""
    classes = _kept(refined(features.select("doc_id", "n_chars", "blocks"), bits).groupBy("cls").agg(F.lit(1).alias("one")).select("cls"), folder, "classes")
    texts = docs.withColumn("cls", _class_of(_block_hashes(F.col("text")), F.length("text"), bits)).join(classes, "cls", "left_semi")
    least = lambda some: some.groupBy("cls", "text").agg(F.min("doc_id").alias("first"))  # noqa: E731  (equal texts meet before the exchange, in each task)
    count = _kept(least(texts).groupBy("cls").agg(F.count("*").alias("texts"), F.min("first").alias("first")), folder, "count")
    alone = count.filter("texts = 1").select("cls", F.lit(None).cast("string").alias("text"), "first", "texts")
    several = count.filter("texts > 1").select("cls", "texts")
    if several.isEmpty():
        return alone
    return _kept(alone.unionByName(least(texts.join(several, "cls", "left_semi")).join(several, "cls").select("cls", "text", "first", "texts")), folder, "firsts")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """``doc_id, first_id`` of each row whose text is that of a smaller id; ``first_id`` is the least id of that text.

    A null text is empty, and equal to an empty one. A null id is larger than any other, and of rows of one id and text none
    is a copy of the other. An empty table gives no row; very long texts are compared whole; other columns are not read.
    """
    folder = f"{shared_folder(docs.sparkSession)}/copies-{uuid.uuid4().hex}"
    docs = _plain(docs, id_col, text_col)
    features = _kept(docs.select("doc_id", F.length("text").alias("n_chars"), _block_hashes(F.col("text")).alias("blocks")), folder, "features")
    firsts = _first_copies(docs, features, folder, bits)
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    salt, salts = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    one = features.select("doc_id", _class_of(F.col("blocks"), F.col("n_chars"), bits).alias("cls"), salt.alias("salt"))
    found = one.join(firsts.filter("texts = 1").select("cls", "first", salts.alias("salt")), ["cls", "salt"]).filter(later).select("doc_id", F.col("first").alias("first_id"))
    several = firsts.filter("texts > 1")
    if several.isEmpty():
        return found
    hard = docs.withColumn("cls", _class_of(_block_hashes(F.col("text")), F.length("text"), bits)).join(several, ["cls", "text"]).filter(later)
    return found.unionByName(hard.select("doc_id", F.col("first").alias("first_id")))


def _plain(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *more)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", bits: int = 64) -> DataFrame:
    """What each filter removes in every order of the filters, for each part of the documents.

    ``filters`` maps a letter to failure by a text and its words; ``COPIES`` is added as the last: a text that a smaller id
    has, in whatever part. Returns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley`` for all orders and steps. One scan of the texts gives each row's mask and hashes; then rows without texts are
    exchanged: by id for labels, by class for copies, where rows of one part, mask, label and text are one row with a count,
    so a text that very many documents have is no hot key. Texts travel for the last comparison only, of classes that stay.

    A null text is empty; a null part is the empty one. A null id has no label, is a copy of any row of its text that has an
    id, and none a copy of it. Rows that repeat count each; of equal rows of one id none is a copy of the other. Where an id
    has several rows of labels, any that says so counts. An empty table gives no row. Other columns are not read. ``bits``
    shortens class hashes (tests: classes of several texts, which are then told apart by their whole texts).
    """
    filters = FILTERS if filters is None else filters
    letters = [*filters, COPIES]
    if len(letters) > 7:
        raise ValueError("too many filters for all their orders")
    spark, last = docs.sparkSession, 1 << len(filters)
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    docs = _plain(docs, id_col, text_col, F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    masked = lambda df: df.withColumn("words", _words(F.col("text"))).withColumn("mask", mask)
    features = _kept(masked(docs).select("doc_id", "part", "mask", F.length("text").alias("n_chars"), _block_hashes(F.col("text")).alias("blocks")), folder, "features")
    firsts = _first_copies(docs, features, folder, bits)

    rows = features.withColumn("cls", _class_of(F.col("blocks"), F.col("n_chars"), bits)).select("doc_id", "part", "mask", "cls", F.lit(None).cast("string").alias("text"))
    several = firsts.filter("texts > 1").select("cls").distinct()
    if not several.isEmpty():  # texts of one length and one hash: their rows come with their texts
        hard = docs.withColumn("cls", _class_of(_block_hashes(F.col("text")), F.length("text"), bits)).join(several, "cls", "left_semi")
        rows = rows.join(several, "cls", "left_anti").unionByName(masked(hard).select("doc_id", "part", "mask", "cls", "text"))
    said = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).cast("int").alias(name)
    labels = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(said("quality"), said("toxic"))
    rows = rows.groupBy("doc_id", "part", "mask", "cls", "text").agg(F.count("*").alias("n")).join(labels, "doc_id", "left").fillna(0, ["quality", "toxic"])
    groups = rows.groupBy("part", "mask", "quality", "toxic", "cls", "text").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    met = groups.alias("g").join(firsts.alias("f"), (F.col("g.cls") == F.col("f.cls")) & F.col("g.text").eqNullSafe(F.col("f.text")), "left").select("g.*", "f.first")
    copies = F.when(F.col("first").isNull(), 0).otherwise(F.col("n") - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + last).alias("mask"), copies.alias("n"))))
    counts = met.select("part", "quality", "toxic", split.alias("x")).groupBy("part", "x.mask").agg(*[F.sum(F.col("x.n") * by).alias(name) for name, by in (("n", F.lit(1)), ("good", F.col("quality")), ("bad", F.col("toxic")))])
    return _in_all_orders(counts, letters)


def _in_all_orders(counts: DataFrame, letters: list[str]) -> DataFrame:
    """From ``part, mask, n, good, bad`` (a row for each mask of a part) the counts of each step of each order."""
    orders = ["".join(x) for x in itertools.permutations(letters)]
    steps = counts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    bits = lambda some: sum((F.when(F.instr(some, x) > 0, 1 << k).otherwise(0) for k, x in enumerate(letters)), F.lit(0))
    steps = steps.withColumn("before", bits(F.substring(F.col("filter_order"), 1, F.col("step") - 1))).withColumn("own", bits(F.substring(F.col("filter_order"), F.col("step"), 1)))
    mask, before, own = F.col("mask"), F.col("before"), F.col("own")
    fails, early = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    of = lambda name, where, value="n": F.sum(F.when(where, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("bigint").alias(name)
    return steps.groupBy("part", "filter_order", "step").agg(
        of("kept", ~fails & ~early), of("removed", fails & ~early), of("redundant", fails & early), of("unique_fails", mask == own),
        of("good_lost", fails & ~early, "good"), of("toxic_lost", fails & ~early, "bad"),
        of("shapley", fails, F.col("n") * (F.lit(math.factorial(len(letters))) / F.greatest(F.bit_count(mask), F.lit(1))).cast("bigint")),
    )
