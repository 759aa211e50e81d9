"""Small reports over tables: sizes of trees, what is missing, diagnostics, simple Markdown, brightness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tree_sizes(files: DataFrame, depth: int) -> DataFrame:
    """``folder, bytes, files`` of each folder ``depth`` deep. Files: path, length."""
    folder = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/").alias("folder")
    return files.groupBy(folder).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """``folder, depth, bytes, files, own_files`` of every folder, of whatever depth, with all that lies under it. Files: path, length.

    A file counts for each folder above it, added up in each task before the exchange, so the root is no hot key. The folder
    of an absolute path's first step is the empty one; what cannot be measured (a null length) is 0.
    """
    names = F.split("path", "/")
    above = F.explode(F.sequence(F.lit(1), F.size(names) - 1)).alias("depth")
    each = files.filter(F.size(names) > 1).select("path", F.coalesce("length", F.lit(0)).cast("long").alias("length"), above)
    own = F.col("depth") == F.size(names) - 1
    folder = F.array_join(F.slice(names, F.lit(1), F.col("depth")), "/")
    return each.groupBy(folder.alias("folder"), "depth").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"), F.count_if(own).alias("own_files"))


def subtree(files: DataFrame, folder: str) -> DataFrame:
    """Files under a folder, of whatever depth: their paths are an interval, which a scan of sorted files can skip to."""
    root = folder.rstrip("/") + "/"
    return files.filter((F.col("path") >= root) & (F.col("path") < root[:-1] + "0"))  # "0" follows "/"


def removal_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: bytes that went, and how many files are still there."""
    kept = after.select("path").withColumn("_there", F.lit(True))
    joined = before.join(kept, "path", "left")
    return joined.agg(F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("length"))), F.lit(0)).alias("freed"), F.count("_there").alias("survivors"))


def after_removal(survivors: Column, mode: Column) -> Column:
    """What comes next: a removal that left files asks for another try, a reset restarts, an uninstall ends."""
    return F.when(survivors > 0, "retry").when(mode == "reset", "restart").otherwise("quit")


def expired_paths(files: DataFrame, now: Column, prefix: str, hours: int) -> DataFrame:
    """Paths under a prefix that were last changed more than so many hours ago. Files: path, modified."""
    return files.filter(F.col("path").startswith(prefix) & (F.unix_seconds(now) - F.unix_seconds("modified") > hours * 3600)).select("path")


def missing_assets(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required assets (name, and ``needed`` if its condition holds) that aren't there; none means that the setup is complete."""
    return required.filter("needed").join(present, "name", "left_anti").select("name")


def under_prefix(files: DataFrame, marker: str) -> DataFrame:
    """The least deep folder that has a file of this name, one for each root. Files: root, path."""
    found = files.filter(F.element_at(F.split("path", "/"), -1) == marker)
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    return found.groupBy("root").agg(F.min_by(folder, F.struct(F.size(F.split("path", "/")), F.col("path"))).alias("folder"))


def copied(files: DataFrame, source: str, target: str) -> DataFrame:
    """``path, to``: every file under a folder with its place under another; what copies them reads this."""
    root = source.rstrip("/") + "/"
    return files.filter(F.col("path").startswith(root)).select("path", F.concat(F.lit(target.rstrip("/") + "/"), F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))).alias("to"))


def diagnostics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``report``: name and value a line, in order, unknown values said so. Pairs: keys, ord, name, value."""
    line = F.concat(F.col("name"), F.lit(": "), F.coalesce("value", F.lit("unknown")))
    held = F.array_sort(F.collect_list(F.struct("ord", line.alias("l"))))
    return pairs.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["l"]), "\n").alias("report"))


def darkness(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``dark``: whether the mean luminance of an image's pixels (r, g, b, whole numbers) is under the middle, in whole thousandths, so that no order of adding shifts a mean of just the middle."""
    y = (F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114).cast("long")
    return pixels.groupBy(*keys).agg((F.sum(y) < F.count(y) * 128_000).alias("dark"))


# -- tolerant scalars -------------------------------------------------------


def pid_of(s: Column) -> Column:
    """A process number, or null."""
    return F.regexp_extract(s, r"\A\s*(\d{1,9})\s*\z", 1).try_cast("int")


def gpu_memory(s: Column) -> Column:
    """Megabytes of the first line of a GPU query ('name, 8192 MiB' or a bare number), or null."""
    return F.regexp_extract(F.split_part(s, F.lit("\n"), F.lit(1)), r"(\d+)\s*(?:MiB)?\s*\z", 1).try_cast("long")


def range_total(s: Column) -> Column:
    """The total of a Content-Range header ('bytes 0-99/1234'), or null where it isn't given."""
    return F.regexp_extract(s, r"/(\d+)\s*\z", 1).try_cast("long")


# -- simple Markdown --------------------------------------------------------

#: Fixed value: spans inside a line.
SPAN = r"\*\*[^*]+\*\*|\*[^*]+\*|`[^`]+`|\[[^\]]+\]\([^)]+\)"


def line_kind(s: Column) -> Column:
    return (
        F.when(s.rlike(r"\A\s*\z"), "blank").when(s.rlike(r"\A#{1,4} "), F.concat(F.lit("h"), F.length(F.regexp_extract(s, r"\A(#+)", 1)).cast("string")))
        .when(s.rlike(r"\A\s*(?:-{3,}|\*{3,})\s*\z"), "rule").when(s.rlike(r"\A\s*[-*] "), "bullet").when(s.rlike(r"\A\s*\d+\. "), "numbered").when(s.rlike(r"\A> ?"), "quote").when(s.rlike(r"\A {2,}\S"), "continued").otherwise("paragraph")
    )


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``line_no, kind, block_no, content, spans``: lines that run on (quote, paragraph, a list item's continuation) share their block."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, r"\r?\n")).alias("line_no", "line")).withColumn("kind", line_kind(F.col("line")))
    order = Window.partitionBy(id_col).orderBy("line_no")
    before = F.lag("kind").over(order)
    runs_on = ((F.col("kind") == before) & F.col("kind").isin("quote", "paragraph")) | ((F.col("kind") == "continued") & before.isin("bullet", "numbered", "continued", "paragraph"))
    begun = lines.withColumn("_new", F.when(F.coalesce(runs_on, F.lit(False)) | (F.col("kind") == "blank"), 0).otherwise(1))
    block = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    content = F.regexp_replace("line", r"\A(?:#{1,4} |\s*[-*] |\s*\d+\. |> ?|\s+)", "")
    return begun.withColumn("block_no", block).filter("kind != 'blank'").select(id_col, "line_no", "kind", "block_no", content.alias("content"), F.regexp_extract_all("line", F.lit(SPAN), F.lit(0)).alias("spans"))
