"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text is cut into units, each with the spaces that follow: a word; or a single character, in scripts that are written
without spaces and in runs of more than 32 characters, where a cut at a fixed length would depend on where the run began. A
k-mer of ``k`` units is a marker if the least hash among its s-mers is the first's or the last's; that depends on nothing
outside the k-mer, so the same units give the same markers wherever they stand. The fingerprint is the ``size`` markers of
least hash, each with its place among the text's markers. The likeness of two fingerprints is the share of common markers
among the least ``size`` of both, an estimate of the Jaccard likeness of all markers, exact for short texts. By their places
two texts are aligned: of the common markers, as many as stand at the commonest shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import text_partitions

S, K, SIZE = 2, 6, 64
UNIT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\s*|(?<!\S)\S{1,32}(?!\S)\s*|\S\s*|\s+"
#: Ranges of ids that can be worked on side by side. A range is sorted on disk where it must be; only the time of one task grows beyond.
MOST_RANGES = 10_000
#: Bounds of ranges are searched in steps of so many.
STRIDE = 100


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, though the body names it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def markers(text: Column) -> Column:
    """Hashes of 40 bits of the text's closed syncmers, in order. A text with fewer units than a k-mer is one marker; an empty one has none."""
    width = K - S + 1
    empty = F.array().cast("array<bigint>")

    def syncmers(g: Column) -> Column:
        closed = lambda i: F.least(g[i], g[i + (width - 1)]) <= F.least(*(g[i + j] for j in range(1, width - 1)))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(g) - width), closed), lambda i: F.shiftrightunsigned(F.xxhash64(*(g[i + j] for j in range(0, width, S))), 24))

    def of(h: Column) -> Column:
        n = F.size(h)
        mers = lambda: F.zip_with(F.slice(h, 1, n - (S - 1)), F.slice(h, S, n - (S - 1)), lambda a, b: F.xxhash64(a, b))
        short = F.when(n == 0, empty).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(h), 24)))
        return F.when(n < K, short).otherwise(let(mers(), syncmers))

    return let(F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u)), of)


def sketch(found: Column, size: int = SIZE) -> Column:
    """The least hashes, sorted, each once."""
    return F.slice(F.sort_array(F.array_distinct(found)), 1, size)


def fingerprint(least: Column, found: Column) -> Column:
    """``hash@place`` of each marker of a sketch, joined by one space; the place counts the text's markers from 1."""
    return F.array_join(F.transform(least, lambda x: F.concat(F.lower(F.lpad(F.hex(x), 10, "0")), F.lit("@"), F.array_position(found, x).cast("string"))), " ")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Of the least hashes of both sketches, the share that both have; 1 if neither has any."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    share = F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share).cast("double")


def aligned(a: Column, found_a: Column, b: Column, found_b: Column) -> Column:
    """Of the markers that both sketches have, the share that stand at the commonest shift between the texts; 0 if there is none in common."""
    shifts = F.transform(F.array_intersect(a, b), lambda x: F.array_position(found_b, x) - F.array_position(found_a, x))

    def most(s: Column) -> Column:
        return F.array_max(F.transform(F.array_distinct(s), lambda d: F.size(F.filter(s, lambda x: x == d)))) / F.size(s)

    return F.coalesce(let(shifts, lambda s: F.when(F.size(s) > 0, most(s))), F.lit(0.0))


def id_array(ids: list[int]) -> Column:
    """An array of numbers that is one constant of the plan, however many there are."""
    return F.split(F.lit(",".join(map(str, ids))), ",").cast("array<bigint>") if ids else F.array().cast("array<bigint>")


def range_of(starts: list[int], value: Column) -> Column:
    """How many of the sorted ``starts`` are at most ``value``: first among every hundredth of them, then in that hundred."""
    upto = lambda some: F.size(F.filter(some, lambda b: b <= value))
    coarse = F.greatest(F.lit(0), upto(id_array(starts[::STRIDE])) - 1) * STRIDE
    return coarse + upto(F.slice(id_array(starts), coarse + 1, STRIDE))


def with_next(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (doc_id, text), dealt by ranges of ids, with ``bucket``, ``place`` and, in each range, the first row of the next as a last one.

    Ranges begin at ids that exist, so a range's end needs one more row and nothing from the other ranges. ``place`` is 0
    for a row, 1 for the copy of the next range's first row and 2 for a row with a null id.
    """
    shares = [i / ranges for i in range(1, ranges)]
    low, cuts = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares or [0.5], 10 * ranges)).first()
    starts = sorted({low, *cuts} if shares else {low}) if low is not None else []
    n = len(starts)
    spread = F.pmod(F.xxhash64("text"), F.lit(max(1, n))).cast("int")
    own = F.when(F.col("doc_id").isNull(), spread).otherwise(range_of(starts, F.col("doc_id")) - 1)
    begins = F.get(id_array(starts), own) == F.col("doc_id")
    place = F.when(F.col("doc_id").isNull(), 2).otherwise(0)
    copy = F.when(begins, F.array(F.struct(F.pmod(own - 1, F.lit(max(1, n))).alias("bucket"), F.lit(1).alias("place"))))
    stands = F.array(F.struct(own.alias("bucket"), place.alias("place")))
    return rows.select("doc_id", "text", F.explode(F.concat(stands, F.coalesce(copy, F.slice(stands, 1, 0)))).alias("at")).select("doc_id", "text", "at.bucket", "at.place")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the beginning of the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, aligned_edited``, one
    row for each row of ``docs``. ``aligned_edited`` is the share of the markers common to the text and its edited one that
    stand at one shift. The next document is the next by ascending id, the first after the last; rows of one id follow by the
    hash of their text. A null text is empty: it has no marker, and two such are alike (1). A row with a null id stands
    outside the order and is its own next. A very long text is read whole. An empty table gives no row; other columns are
    not read, whatever their names. Texts are exchanged once, by ranges of ids of even size.
    """
    tasks = text_partitions(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = with_next(rows, min(MOST_RANGES, 2 * tasks)).repartition(tasks, "bucket")
    found = dealt.withColumn("found", markers(F.col("text"))).withColumn("least", sketch(F.col("found")))
    order = Window.partitionBy("bucket").orderBy("place", "doc_id", F.xxhash64("text"))
    after = F.when(F.col("place") == 2, F.struct("text", "least")).otherwise(F.lead(F.struct("text", "least")).over(order))
    n = F.length("text")
    both = found.withColumn("after", after).filter("place != 1").withColumn("n_chars", n)
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("after.text", F.lit(1), F.floor(n / 2).cast("int")))
    both = both.select("doc_id", F.col("n_chars").cast("long"), "found", "least", F.col("after.least").alias("next_least"), edited.alias("edited"))
    both = both.withColumn("edited_found", markers(F.col("edited"))).withColumn("edited_least", sketch(F.col("edited_found")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("least"), F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_least"), F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("least"), F.col("edited_least")).alias("near_edited"),
        likeness(F.col("least"), F.col("next_least")).alias("near_next"),
        aligned(F.col("least"), F.col("found"), F.col("edited_least"), F.col("edited_found")).alias("aligned_edited"),
    )
