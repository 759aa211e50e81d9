"""A trigram index over stored texts: search for a piece of text reads the texts that can have it, not all.

Texts are numbered and lie in a table by the hash of their number. For each trigram (three code points of the folded text, as
one integer) there are posting lists: a task's run of texts is a block, and a list has the differences of the numbers of the
block's texts that hold the trigram. Lists lie in order of the trigrams, so a pushed filter on a term's trigrams skips what
has none of them. The lists of a block are intersected, and what is left is looked up and searched literally.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.text import LOWER, UPPER, contains_folded
from gridmill.operators.hashed import HashedTable
from gridmill.sources.shared import kept

#: Pairs of a text and a trigram that a block has, at most, but for a block of one text.
BLOCK_PAIRS = 2_000_000
#: Code points of a text that are cut into trigrams at once.
AT_ONCE = 2_000_000
#: If more than this share of all texts may have a term, they are scanned: the index would spare little and cost a join.
SCAN_ABOVE = 0.25


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, A-Z lowered, as integers in order."""
    found = []
    for start in range(0, max(len(text) - 2, 0), AT_ONCE):
        points = np.frombuffer(text[start : start + AT_ONCE + 2].encode("utf-32-le"), "<u4").astype(np.int64)
        points = np.where((points >= 65) & (points <= 90), points + 32, points)
        found.append(np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


POSTINGS = "gram long, block long, n int, steps array<long>"


def postings(texts: DataFrame) -> DataFrame:
    """Posting lists of ``entry, text``: made in the tasks that read the texts, which holds one block at a time; only lists are exchanged."""
    schema = pa.schema([("gram", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("steps", pa.list_(pa.int64()))])

    def lists(entries: list[int], grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, entry = np.concatenate(grams), np.repeat(np.array(entries, np.int64), [len(g) for g in grams])
        if not len(gram):
            return
        order = np.lexsort((entry, gram))
        gram, entry, block = gram[order], entry[order], min(entries)
        starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        steps = np.diff(entry, prepend=block)
        steps[starts] = entry[starts] - block
        ends = np.r_[starts, len(gram)].astype(np.int32)
        columns = [pa.array(gram[starts]), pa.array(np.full(len(starts), block)), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(steps))]
        made = pa.RecordBatch.from_arrays(columns, schema=schema)
        for k in range(0, len(made), 50_000):
            yield made.slice(k, 50_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, grams, pairs = [], [], 0
        for b in batches:
            for entry, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = trigrams(text.as_py())
                if pairs and pairs + len(found) > BLOCK_PAIRS:
                    yield from lists(entries, grams)
                    entries, grams, pairs = [], [], 0
                entries.append(entry)
                grams.append(found)
                pairs += len(found)
        if entries:
            yield from lists(entries, grams)

    return texts.select("entry", "text").mapInArrow(run, POSTINGS)


def _intersected(blocks: DataFrame) -> DataFrame:
    """``entry`` of the texts that stand in all lists of a block."""
    schema = pa.schema([("entry", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lists in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                decoded = sorted((block + np.cumsum(x.values.to_numpy()) for x in lists), key=len)
                found = functools.reduce(lambda a, c: np.intersect1d(a, c, assume_unique=True), decoded)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], schema=schema)

    return blocks.select("block", "lists").mapInArrow(run, "entry long")


class TextIndex:
    """Stored texts with their trigrams. ``keys`` tell texts apart: a text that is added again replaces the one before."""

    def __init__(self, texts: HashedTable, path: str, keys: list[str]):
        self.spark, self.texts, self.path, self.keys = texts.spark, texts, path, keys

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> TextIndex:
        """An index of ``rows`` (the keys, and ``text``). Null texts hold nothing and are not stored; of rows of one key each counts."""
        numbered = cls._numbered(rows, keys, 0)
        made = cls(HashedTable.create(numbered, f"{path}/texts", ["entry"], buckets), path, keys)
        made._write_lists(numbered)
        rows.sparkSession.createDataFrame([], "entry long").write.parquet(f"{path}/gone")
        return made

    @staticmethod
    def _numbered(rows: DataFrame, keys: list[str], first: int) -> DataFrame:
        """Rows with their numbers, written, so that both tables are made of the same."""
        return kept(rows.filter("text is not null").select((F.monotonically_increasing_id() + first).alias("entry"), *keys, "text"), "numbered")

    def _write_lists(self, numbered: DataFrame) -> None:
        """Lists by trigram, in files that a filter on trigrams can skip; version 2 pages store their numbers by differences too."""
        dealt = postings(numbered).repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")
        dealt.write.mode("append").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/postings")

    def add(self, rows: DataFrame) -> None:
        """Stores further texts, or new ones of stored keys, with lists of their own; nothing that is stored is read but keys. Stopped half way, the same call again gives the same index."""
        last = self.texts.read().agg(F.coalesce(F.max("entry"), F.lit(-1))).first()[0]
        numbered = self._numbered(rows, self.keys, last + 1)
        self.remove(rows)
        self.texts.append(numbered)
        self._write_lists(numbered)

    def remove(self, keys: DataFrame) -> None:
        """Texts of these keys are not found any more."""
        gone = self.texts.read().select("entry", *self.keys).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
        kept(gone.select("entry"), "gone").write.mode("append").parquet(f"{self.path}/gone")

    def _lists(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.spark.read.schema("entry long").parquet(f"{self.path}/gone"), "entry", "left_anti")

    def candidates(self, term: str) -> DataFrame:
        """``entry`` of the texts that have all trigrams of a term of three letters or more."""
        grams = trigrams(term).tolist()
        lists = self._lists().filter(F.col("gram").isin(grams))
        blocks = lists.groupBy("block").agg(F.collect_list("steps").alias("lists")).filter(F.size("lists") == len(grams))  # a list for each trigram of the term
        return _intersected(blocks)

    def most(self, term: str) -> int:
        """At most so many texts have the term: those of its rarest trigram. Lists are not read for it, only their lengths."""
        grams = trigrams(term).tolist()
        counts = self._lists().filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # as many as the term has trigrams
        return min((r["n"] for r in counts), default=0) if len(counts) == len(grams) else 0

    def find(self, term: str, scan_above: float = SCAN_ABOVE) -> DataFrame:
        """The keys and texts that hold a term, the case of A-Z aside, whatever characters it has; an empty term is in all.

        A term under three letters has no trigram, and one that most texts may have is not worth a lookup: these are found by a scan.
        """
        stored = self.texts.read()
        if len(term) >= 3 and self.most(term) <= scan_above * stored.count():
            stored = self.texts.lookup(kept(self.candidates(term), "candidates"))
        return self._live(stored.filter(contains_folded(F.col("text"), term))).select(*self.keys, "text")


def index_pages(pages: DataFrame, outputs: DataFrame, path: str, buckets: int | None = None) -> TextIndex:
    """An index of pages (session_id, page_index, full_text) and tables (session_id, page_index, csv_content)."""
    return TextIndex.create(searched(pages, outputs), path, ["session_id", "kind", "page_index"], buckets)


def searched(pages: DataFrame, outputs: DataFrame) -> DataFrame:
    one = lambda rows, kind, col: rows.select("session_id", F.lit(kind).alias("kind"), F.col("page_index").cast("int").alias("page_index"), F.col(col).alias("text"))
    return one(pages, "scan", "full_text").unionByName(one(outputs, "table", "csv_content"))


def matches(sessions: DataFrame, index: TextIndex, term: str) -> DataFrame:
    """Sessions with ``matched``, as ``store.matches`` says, by the index; titles are read with the sessions."""
    hit = index.find(term).select(F.col("session_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    joined = sessions.join(hit, "id", "left")
    return joined.withColumn("matched", contains_folded(F.col("title"), term) | F.col("_hit").isNotNull() | F.lit(term == "")).drop("_hit")


def search_counts(sessions: DataFrame, index: TextIndex, term: str) -> DataFrame:
    return matches(sessions, index, term).agg(F.count_if("matched").alias("matching"), F.count("*").alias("total"))


def first_texts(index: TextIndex, term: str) -> DataFrame:
    """``id, scan_match, table_match``: the text of the first page, and of the first table, of each session that has the term."""
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("text")), F.when(F.col("kind") == kind, F.col("page_index")))
    return index.find(term).groupBy(F.col("session_id").alias("id")).agg(first("scan").alias("scan_match"), first("table").alias("table_match"))
