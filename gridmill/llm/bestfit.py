"""Best-fit decreasing of a whole corpus into sequences of one length.

Only how many pieces there are of each length decides where the next piece goes, so the places are found for all pieces of one
length at once: a segment tree over the remaining capacities of open sequences gives the tightest that still holds the length,
in a logarithm of the sequence's length, and pieces go there until it or they are used up. The plan that comes out has rows
of (length, first rank, count, first sequence, offset, pieces to a sequence); it is bounded by the sequence's length, whatever
the corpus. Each piece then finds its place by its rank among the pieces of its length. So no sequence is left open at the end
of a task: the packing is that of all pieces in one queue.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import batch, shared_folder, strings
from gridmill.llm.packing import coder

ROWS = 20_000


class Capacities:
    """A segment tree over remaining capacities 0 to ``longest``: a leaf has the number of open sequences with that capacity, a node their sum."""

    def __init__(self, longest: int):
        self.width = 1 << longest.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, count: int) -> None:
        node = self.width + capacity
        while node:
            self.open[node] += count
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` that an open sequence has."""
        node = self.width + length
        if self.open[node]:
            return length
        while node > 1:  # up to the first subtree on the right that has an open sequence, then down its left side
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node + (not self.open[2 * node])
                return node - self.width
            node >>= 1
        return None


class Placed(NamedTuple):
    """``count`` pieces of ``length`` from ``rank`` on stand at ``offset`` of the sequences from ``sequence`` on, ``each`` in one."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int
    each: int


def plan(counts: Mapping[int, int], longest: int) -> list[Placed]:
    """Best-fit decreasing of ``counts`` pieces of each length. Each piece goes to the fullest sequence that still holds it, a new one if none does."""
    tree, ranges, placed, opened = Capacities(longest), defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, count = longest, -(-left // (longest // length))
                ranges[capacity].append((opened, count))
                tree.add(capacity, count)
                opened += count
            first, count = ranges[capacity].pop()
            each = capacity // length  # a sequence that took a piece is the tightest for the next, while it holds it
            full = min(count, left // each)
            used, n = (full, full * each) if full else (1, left)
            placed.append(Placed(length, rank, n, first, longest - capacity, each))
            tree.add(capacity, -used)
            if count > used:
                ranges[capacity].append((first + used, count - used))
            rest = capacity - (each if full else left) * length
            ranges[rest].append((first, used))
            tree.add(rest, used)
            rank, left = rank + n, left - n
    return placed


def cut(tokens: int, longest: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece: pieces of ``longest``, the first of what is left over."""
    start, length = 0, tokens % longest or longest
    while start < tokens:
        yield start, min(length, tokens)
        start, length = start + length, longest


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, longest: int, special: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each text with ``task`` and ``nth``: the number of the task, and of the piece among those of its length in that task."""
    fields = PIECES + ", task int, nth long"
    types = {"int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in fields.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seen = coder(ranks_path, pattern, special), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                coded = memoryview(ids.of(text) + end)
                for k, (start, length) in enumerate(cut(len(coded) // 4, longest)):
                    rows.append((doc, k, start, length, zlib.crc32(coded[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
                if len(rows) >= ROWS:
                    yield batch(schema, zip(*rows, strict=True))
                    rows = []
        if rows:
            yield batch(schema, zip(*rows, strict=True))

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, fields)


def _placed(ranked: DataFrame, found: list[Placed]) -> DataFrame:
    """Rows with ``rank``: their sequences and offsets, looked up in the plan by length and rank."""
    table = np.array(found, np.int64).reshape(-1, len(Placed._fields))
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    fields = PIECES + ", sequence_id long, offset long"
    types = {"int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in fields.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.unique(table[:, 0])
        bounds = {int(x): (int(a), int(z)) for x, a, z in zip(lengths, np.searchsorted(table[:, 0], lengths), np.searchsorted(table[:, 0], lengths, "right"), strict=True)}
        for b in batches:
            length, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            row = np.empty(len(length), np.int64)
            for x in np.unique(length):
                at, (a, z) = length == x, bounds[int(x)]
                row[at] = a + np.searchsorted(table[a:z, 1], rank[at], "right") - 1
            nth, each = rank - table[row, 1], table[row, 5]
            yield batch(schema, [*b.columns[:5], pa.array(table[row, 3] + nth // each), pa.array(table[row, 4] + nth % each * length)])

    return ranked.select(*[f.split()[0] for f in PIECES.split(", ")], "rank").mapInArrow(run, fields)


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0, longest: int = 2048, special: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all texts into sequences of at most ``longest`` tokens by best-fit decreasing over the whole corpus.

    A text is its ids by the ranks, then ``end_id``; ``special`` texts in it have ids of their own. Only what is longer than a
    sequence is cut: whole sequences, and before them a first piece of what is left over. Returns ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset``, a row for each piece. Texts are coded once, where they are read; the pieces are
    written to the shared folder, as rows without text. Counts of pieces by length, at most ``longest`` of them, go to the
    driver for the plan; the plan's rows, which are bounded by ``longest`` too, go to the tasks. Ranks come from counts by task
    and length, so nothing is sorted and no key holds more than one task's pieces. A task that runs again gives the same rows,
    as the pieces are read from their files.

    A null text is empty and gives ``end_id`` alone. Null ids, ids and rows that repeat are packed each by itself; a very long
    text is cut as it comes; an empty table gives no row; other columns are not read, whatever their names.
    """
    spark, path = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/pieces-{uuid.uuid4().hex}"
    pieces(docs, ranks_path, pattern, end_id, longest, special, id_col, text_col).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    found = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, longest)  # at most longest rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return _placed(rows.join(first, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth")), found)
