"""What comes in: files by type, OCR records, and rules on both."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_PAGES, SMALL_SIDE, LEAST_CONFIDENCE = 500 * 1024 * 1024, 2000, 1500, 10
#: MIME type, first bytes in hex, of each type by extension.
TYPES = {"pdf": ("application/pdf", "25504446"), "png": ("image/png", "89504E470D0A1A0A"), "jpg": ("image/jpeg", "FFD8FF")}


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, length, content`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def extension(name: Column) -> Column:
    e = F.lower(F.regexp_extract(name, r"\.([^./]*)\z", 1))
    return F.when(e == "jpeg", "jpg").otherwise(e)


def magic_type(content: Column) -> Column:
    """The type that a file's first bytes name, or null."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for kind, (_, magic) in TYPES.items():
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def file_type(mime: Column, name: Column, content: Column) -> Column:
    """By MIME type, else by extension, else by first bytes."""
    by_mime = F.lit(None).cast("string")
    for kind, (m, _) in TYPES.items():
        by_mime = F.when(mime == m, kind).otherwise(by_mime)
    by_name = F.when(extension(name).isin(*TYPES), extension(name))
    return F.coalesce(by_mime, by_name, magic_type(content))


def rejection(n_files: Column, length: Column, kind: Column, content: Column) -> Column:
    """Why an upload is refused, or null: one file at a time, not too large, of a known type, with first bytes that agree."""
    return F.when(n_files != 1, "one file at a time").when(length > MOST_BYTES, "too large").when(kind.isNull(), "unknown type").when(~F.coalesce(magic_type(content) == kind, F.lit(False)), "content is not of its type")


def classified(ext: Column) -> Column:
    """What reads a file of this (lower-case) extension."""
    return F.when(ext == "pdf", "Pdf").when(ext.isin("png", "jpg", "jpeg"), "Image").otherwise("Unsupported")


def page_count_error(n: Column) -> Column:
    return F.when(n == 0, "no pages").when(n > MOST_PAGES, "too many pages")


def upscale_factor(width: Column, height: Column, allowed: Column) -> Column:
    return F.when(allowed & (F.least(width, height) < SMALL_SIDE), F.lit(2.0)).otherwise(F.lit(1.0))


def original_coordinate(v: Column, scale: Column) -> Column:
    return F.round((v.cast("float") / scale.cast("float")).cast("double")).cast("int")


OCR_FIELDS = "level INT, page_num INT, block_num INT, par_num INT, line_num INT, word_num INT, left INT, top INT, width INT, height INT, conf DOUBLE, text STRING"


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="", schema=OCR_FIELDS)


#: Files by page lie in folders of these names, which the schema of a read names too.
OCR_PAGES = OCR_FIELDS + ", doc_id BIGINT, page_index INT"
_TSV = {"sep": "\t", "header": "true", "quote": ""}


def read_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """OCR files in folders ``doc_id=…/page_index=…``: a filter on either lists no other folder."""
    return spark.read.schema(OCR_PAGES).options(**_TSV).csv(path)


def stream_ocr_pages(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """The same as a stream: each file comes once, as the checkpoint knows, over restarts."""
    return spark.readStream.schema(OCR_PAGES).options(**_TSV).option("maxFilesPerTrigger", files_per_batch).csv(path)


def write_ocr_pages(records: DataFrame, path: str) -> None:
    """OCR records with ``doc_id`` and ``page_index`` as such files."""
    columns = [f.split(" ")[0] for f in OCR_PAGES.split(", ")]
    dealt = records.select(*columns).repartition("doc_id", "page_index")
    dealt.write.mode("append").partitionBy("doc_id", "page_index").options(**_TSV, emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


#: Documents whose pages lie in one folder where there are many, and the files that a folder's documents are dealt to.
GROUP, GROUP_FILES = 4096, 16


def write_ocr_groups(records: DataFrame, path: str) -> None:
    """The same records in a folder ``doc_group=…`` for each ``GROUP`` documents, a few files each: files grow with the records, and not as many come as there are pages."""
    columns = [f.split(" ")[0] for f in OCR_PAGES.split(", ")]
    grouped = records.select(*columns, F.expr(f"doc_id div {GROUP}").alias("doc_group"))
    dealt = grouped.repartition("doc_group", F.expr(f"pmod(doc_id, {GROUP_FILES})")).sortWithinPartitions("doc_group", "doc_id", "page_index")
    dealt.write.mode("append").partitionBy("doc_group").options(**_TSV, emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def read_ocr_groups(spark: SparkSession, path: str, first_doc: int | None = None) -> DataFrame:
    """Such files, from a document on: folders before its own are not listed."""
    rows = spark.read.schema(OCR_PAGES + ", doc_group BIGINT").options(**_TSV).csv(path)
    if first_doc is not None:
        rows = rows.filter((F.col("doc_group") >= first_doc // GROUP) & (F.col("doc_id") >= first_doc))
    return rows.drop("doc_group")


def ocr_words(records: DataFrame, scale: Column) -> DataFrame:
    """Words of OCR records: those of level 5 with text, boxes in the original's units."""
    box = [original_coordinate(F.col(c), scale).cast("double").alias(c) for c in ("left", "top", "width", "height")]
    keep = [c for c in records.columns if c not in ("level", "left", "top", "width", "height", "conf", "text")]
    return records.filter((F.col("level") == 5) & F.col("text").rlike(r"\S")).select(*keep, "text", F.col("conf").alias("confidence"), *box)


def sure_text(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``text``: words of more than a little confidence in order, joined by spaces."""
    kept = records.filter(F.col("text").rlike(r"\S") & (F.col("conf") > LEAST_CONFIDENCE))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))


def page_results(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Every page (doc_id, page_index, kind, error) with ``n_words``. A page of a PDF that failed keeps its row, with its error and no words; a failed image fails the query."""
    counts = words.groupBy("doc_id", "page_index").agg(F.count("*").alias("n_words"))
    checked = F.when(F.col("error").isNotNull() & (F.col("kind") == "Image"), F.raise_error(F.concat(F.lit("image could not be read: "), "error")).cast("string")).otherwise(F.col("error"))
    out = pages.join(counts, ["doc_id", "page_index"], "left").withColumn("error", checked)
    return out.withColumn("n_words", F.when(F.col("error").isNull(), F.coalesce("n_words", F.lit(0))).otherwise(F.lit(0)).cast("long"))


def data_url(mime: str, content: Column) -> Column:
    """The content as one line: an encoder of mail breaks what is longer than 76 characters."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


WORDS_JSON = "array<struct<id: string, text: string, confidence: double, box_coords: struct<left: double, top: double, width: double, height: double>>>"


def stored_words(pages: DataFrame) -> DataFrame:
    """Words of stored pages (session_id, page_index, words_json), in their order."""
    each = pages.select("session_id", "page_index", F.posexplode(F.from_json("words_json", WORDS_JSON)).alias("word_ord", "w"))
    return each.select("session_id", "page_index", "word_ord", F.col("w.id").alias("word_id"), "w.text", "w.confidence", "w.box_coords.*")


def rechunked(chunks: DataFrame, size: int) -> DataFrame:
    """``stream, block, content``: chunks (stream, seq, content) joined to blocks of ``size`` bytes or more; no chunk is split, the last may be short.

    Chunks stream by in order; a task holds one open block.
    """
    kind = dict(chunks.dtypes)["stream"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, held, used, begun, key = None, 0, [], 0, False, None
        for b in batches:
            key = b.schema.field(0).type
            out: list[tuple] = []
            for stream, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if begun and stream != own:
                    if held:
                        out.append((own, block, b"".join(held)))
                    block, held, used = 0, [], 0
                own, begun = stream, True
                held.append(content or b"")
                used += len(held[-1])
                if used >= size:
                    out.append((own, block, b"".join(held)))
                    block, held, used = block + 1, [], 0
            if out:
                yield _blocks(out, key)
        if held:
            yield _blocks([(own, block, b"".join(held))], key)

    return chunks.select("stream", "content", "seq").repartition(F.col("stream")).sortWithinPartitions("stream", "seq").select("stream", "content").mapInArrow(run, f"stream {kind}, block int, content binary")


def _blocks(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (key, pa.int32(), pa.binary()), strict=True)], names=["stream", "block", "content"])


def ingested(documents: DataFrame, pages: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a round of uploads gives: page results, progress events, and the documents refused.

    Documents: doc_id, n_files, length, mime, name, content, n_pages. One that a check refuses has a ``reason`` and no pages;
    the pages of the others (doc_id, page_index, kind, error) have their words counted, and an event each: current, of total.
    """
    kind = file_type(F.col("mime"), F.col("name"), F.col("content"))
    checked = documents.select("doc_id", "n_pages", F.coalesce(rejection(F.col("n_files"), F.col("length"), kind, F.col("content")), page_count_error(F.col("n_pages"))).alias("reason"))
    accepted = checked.filter("reason is null").select("doc_id", "n_pages")
    results = page_results(pages.join(accepted.select("doc_id"), "doc_id", "left_semi"), words)
    events = results.join(accepted, "doc_id").select("doc_id", (F.col("page_index") + 1).alias("current"), F.col("n_pages").alias("total"))
    return results, events, checked.filter("reason is not null").select("doc_id", "reason")


CELLS_JSON = "array<struct<row_index: int, col_index: int, value: string, word_ids: array<string>, match_status: string, trust: string, verified: boolean>>"


def stored_cells(outputs: DataFrame) -> DataFrame:
    """Cells of stored tables (session_id, page_index, cell_mappings_json); what isn't JSON has none."""
    each = outputs.select("session_id", "page_index", F.explode(F.from_json("cell_mappings_json", CELLS_JSON)).alias("c"))
    return each.select("session_id", "page_index", "c.*")
