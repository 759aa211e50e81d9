"""Joins inside pages that do not compare all of a page with all of it: words in regions, likest words, channels between columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.operators.layout import KEY, char_width

# -- words in regions -------------------------------------------------------

#: Words that a bin of a page's grid has on the average.
PER_BIN = 8


def _bin(x: Column, low: str, high: str, bins: str = "bins") -> Column:
    """The bin of a place between the page's extents; it never falls as ``x`` grows, whatever the rounding."""
    span = F.col(high) - F.col(low)
    return F.when(span > 0, F.least(F.col(bins) - 1, F.floor((x - F.col(low)) / span * F.col(bins)))).otherwise(0).cast("int")


def words_in_regions(words: DataFrame, regions: DataFrame, claimed: DataFrame) -> DataFrame:
    """Free words whose centre lies in a region (KEY, region_id, x0, x1, y0, y1), edges included. ``claimed``: KEY, word_id.

    A page is a grid of bins, about one for each ``PER_BIN`` words. A word is in one bin, a region in those that it touches
    within the page's words, so a pair meets once and only near words meet a region.
    """
    free = words.hint("merge").join(claimed.select(*KEY, "word_id").distinct(), [*KEY, "word_id"], "left_anti")
    free = free.select(*KEY, "word_id", (F.col("left") + F.col("width") / 2).alias("cx"), (F.col("top") + F.col("height") / 2).alias("cy"))
    extents = free.groupBy(*KEY).agg(F.ceil(F.sqrt(F.count("*") / PER_BIN)).alias("bins"), *[f(c).alias(f"{c}_{n}") for c in ("cx", "cy") for n, f in (("low", F.min), ("high", F.max))])
    x, y = (lambda c: _bin(c, "cx_low", "cx_high")), (lambda c: _bin(c, "cy_low", "cy_high"))
    dealt = free.hint("merge").join(extents, KEY).select(*KEY, "word_id", "cx", "cy", x(F.col("cx")).alias("bx"), y(F.col("cy")).alias("by"))
    inside = regions.hint("merge").join(extents, KEY).filter("x0 <= x1 and y0 <= y1 and x0 <= cx_high and x1 >= cx_low and y0 <= cy_high and y1 >= cy_low")
    across = F.sequence(x(F.greatest("x0", "cx_low")), x(F.least("x1", "cx_high")))
    down = F.sequence(y(F.greatest("y0", "cy_low")), y(F.least("y1", "cy_high")))
    spread = inside.select(*KEY, "region_id", "x0", "x1", "y0", "y1", F.explode(across).alias("bx"), down.alias("down")).select("*", F.explode("down").alias("by")).drop("down")
    met = spread.hint("merge").join(dealt, [*KEY, "bx", "by"]).filter(F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1")))
    return met.select(*KEY, "region_id", "word_id")


# -- the likest word --------------------------------------------------------

#: How different a word may be, as a number or as a share of the value's length, and the charge for its place.
LEAST_EDITS, EDITS, CHARGE = 2.0, 0.4, 5
#: The counts of letters are compared where the value is no longer than this; it only spares distances.
COUNTED = 200


def _letters(s: str) -> Column:
    """Each letter with its turn among equal ones, so that a set holds their counts."""
    return F.expr(f"transform(split({s}, ''), (x, i) -> concat(x, size(filter(slice(split({s}, ''), 1, i + 1), y -> y = x))))")


def _sketch(s: str) -> Column:
    """A bit for each of the letters with turns, so that two words' sketches differ in no more bits than their counts of letters do."""
    return F.aggregate(F.filter(_letters(s), lambda x: F.length(s) > 0), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def near_candidates(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of a cell and a word of its page that may be near enough, some more than once: ``KEY, cell_ord, v, tau, p, word_ord, word_id, t, place``.

    Of ``tau + 1`` pieces that a value is cut into, one stands unchanged in any word ``tau`` edits away, moved by ``tau`` places
    at most. So pieces of one to three letters with their places are what pages join by, then lengths, then counts of letters:
    rows have a sketch of 64 bits of these.
    A value of one or two letters is near any word that short; those meet without a piece.
    """
    page = Window.partitionBy(*KEY)
    place = lambda df: df.withColumn("place", F.when(F.count("*").over(page) > 1, F.col("ord") / (F.count("*").over(page) - 1)).otherwise(0.0))
    c = place(cells).select(*KEY, F.col("ord").alias("cell_ord"), F.lower("value").alias("v"), F.col("place").alias("p")).filter("v != ''").withColumn("n", F.length("v"))
    w = place(words).select(*KEY, F.col("ord").alias("word_ord"), "word_id", F.lower("text").alias("t"), "place").filter("t is not null").withColumn("m", F.length("t"))
    longest = w.groupBy(*KEY).agg(F.max("m").alias("longest"))
    c = c.withColumn("tau", F.floor(F.greatest(F.lit(LEAST_EDITS), F.col("n") * EDITS)).cast("int")).hint("merge").join(longest, KEY).filter("n - tau <= longest").drop("longest")
    cut = "transform(sequence(0, tau), k -> struct(int(floor(k * n / (tau + 1))) as at, substring(v, int(floor(k * n / (tau + 1))) + 1, int(floor((k + 1) * n / (tau + 1)) - floor(k * n / (tau + 1)))) as piece))"
    short = "transform(sequence(0, n), k -> struct(k as at, substring(v, k + 1, 1) as piece))"  # the last is empty
    pieces = F.expr(f"if(n <= 2, {short}, {cut})")
    parts = "flatten(transform(sequence(1, least(3, m)), l -> transform(sequence(0, m - l), i -> struct(i as at, substring(t, i + 1, l) as piece))))"
    found = F.expr(f"concat(if(m > 0, {parts}, array()), if(m <= 2, array(struct(0 as at, '' as piece)), array()))")
    c = c.withColumn("v_sketch", F.when(F.col("n") <= COUNTED, _sketch("v"))).withColumn("x", F.explode(pieces)).select("*", F.col("x.at").alias("v_at"), F.col("x.piece").alias("piece")).drop("x")
    w = w.withColumn("t_sketch", F.when(F.col("m") <= 2 * COUNTED, _sketch("t"))).withColumn("x", F.explode(found)).select("*", F.col("x.at").alias("t_at"), F.col("x.piece").alias("piece")).drop("x")
    met = c.hint("merge").join(w, [*KEY, "piece"]).filter("abs(n - m) <= tau and (abs(v_at - t_at) <= tau or piece = '')")
    # tau edits change so many counts of letters at most
    met = met.filter(F.coalesce(F.bit_count(F.col("v_sketch").bitwiseXOR(F.col("t_sketch"))) <= 2 * F.col("tau") - F.abs(F.col("n") - F.col("m")), F.lit(True)) | (F.greatest("n", "m") <= F.col("tau")))
    return met.select(*KEY, "cell_ord", "v", "tau", "p", "word_ord", "word_id", "t", "place")


def nearest_like(cells: DataFrame, words: DataFrame) -> DataFrame:
    """For each cell the word least different from it, with a charge for standing elsewhere on the page: an alternative that knows duplicates.

    A word counts if its edit distance is at most the greater of 2 and 0.4 of the value's length; the charge is 5 times the
    difference of relative places (0 for the first, 1 for the last); the first of equals wins. Cells and words need KEY and
    ``ord``, from 0; cells a ``value``.
    """
    near = near_candidates(cells, words).withColumn("d", F.expr("levenshtein(v, t)")).filter("d <= tau")
    scored = near.withColumn("score", F.col("d") + CHARGE * F.abs(F.col("p") - F.col("place")))
    return scored.groupBy(*KEY, "cell_ord").agg(F.min_by("word_id", F.struct("score", "word_ord")).alias("word_id"))


# -- channels between columns -----------------------------------------------


def valleys(swept: DataFrame) -> DataFrame:
    """``a, b, lo, hi`` for each stretch of a page between higher coverage on both sides: no word more than ``lo`` stands anywhere in it, and it is a stretch by itself for every limit from ``lo`` to ``hi``.

    ``swept``: KEY, x, cover, a row where the coverage may change. Valleys lie in each other, so a stack in one pass finds all:
    no more of them than rows.
    """
    kinds = dict(swept.dtypes)
    keys = swept.sparkSession.createDataFrame([], ", ".join(f"{k} {kinds[k]}" for k in KEY)).schema

    def run(page: pa.Table) -> pa.Table:
        page = page.sort_by("x")
        x, cover = page["x"].to_pylist(), page["cover"].to_pylist()
        found, stack = [], []  # (coverage, first place) of stretches that are open to the right, ever lower
        for i, c in enumerate(cover):
            start = i
            while stack and stack[-1][0] < c:
                low, start = stack.pop()
                if stack:  # else it is open to the left
                    found.append((x[start], x[i], low, min(c, stack[-1][0]) - 1))
            if not stack or stack[-1][0] > c:
                stack.append((c, start))
        a, b, lo, hi = zip(*found, strict=True) if found else ([], [], [], [])
        own = [pa.array([page[k][0].as_py()] * len(found), page.schema.field(k).type) for k in KEY]
        return pa.Table.from_arrays([*own, pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=[*KEY, "a", "b", "lo", "hi"])

    schema = keys.add("a", "double").add("b", "double").add("lo", "long").add("hi", "long")
    return swept.select(*KEY, F.col("x").cast("double").alias("x"), F.col("cover").cast("long").alias("cover")).groupBy(*KEY).applyInArrow(run, schema)


def separators(words: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``separators`` of each page (KEY, bands), sorted: middles of the widest channels at the least coverage that leaves enough. ``lines``: KEY, n_lines.

    One sweep gives the valleys of coverage; a second, over the limits at which a valley opens or closes, gives the least limit
    with enough of them. There are no more rows than ends of words.
    """
    ends = words.select(*KEY, F.explode(F.array(F.struct(F.col("left").alias("x"), F.lit(1).alias("d")), F.struct((F.col("left") + F.col("width")).alias("x"), F.lit(-1).alias("d")))).alias("e")).select(*KEY, "e.x", "e.d")
    page = Window.partitionBy(*KEY)
    swept = ends.groupBy(*KEY, "x").agg(F.sum("d").alias("d")).withColumn("cover", F.sum("d").over(page.orderBy("x")))
    limits = lines.hint("merge").join(char_width(words), KEY).hint("merge").join(wanted, KEY).withColumn("most", F.greatest(F.lit(1), F.floor(F.col("n_lines") * 0.2).cast("int"))).filter("bands >= 2")
    wide = F.col("b") - F.col("a") >= F.greatest(F.lit(2.0), F.col("char_width") * 0.5)
    good = valleys(swept).hint("merge").join(limits, KEY).filter(wide & (F.col("lo") <= F.col("most"))).select(*KEY, "a", "b", "lo", "hi", "bands")
    turns = good.select(*KEY, "bands", F.explode(F.array(F.struct(F.col("lo").alias("k"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("k"), F.lit(-1).alias("d")))).alias("e")).groupBy(*KEY, "bands", "e.k").agg(F.sum("e.d").alias("d"))
    first = turns.withColumn("n", F.sum("d").over(page.orderBy("k"))).filter("n >= bands - 1").groupBy(*KEY).agg(F.min("k").alias("k"))
    ranked = good.hint("merge").join(first, KEY).filter("lo <= k and k <= hi").withColumn("rank", F.row_number().over(page.orderBy(F.col("a") - F.col("b"), "a"))).filter("rank <= bands - 1")
    return ranked.groupBy(*KEY).agg(F.sort_array(F.collect_list((F.col("a") + F.col("b")) / 2)).alias("separators"))
