"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt into shards by a hash of their direction, so that equal vectors, and those that differ by a power of two,
meet; a shard keeps each once, with the few least ids that have it. Vectors that lie closer together than a walk in single
precision can tell apart are one node of the shard's graph. A greedy search from an entry point proposes neighbours of a
node, and pruning keeps a proposal unless a kept neighbour is nearer to it by the factor ``alpha``, so that edges point in
diverse directions. Every query walks every shard's graph by beam search; all vectors of the nodes it met are compared in
double precision, and the shards' nearest are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import batch

#: Distinct vectors of a shard: so many at least, and as many as ``GROWTH`` roots of all, so that queries times shards grow by less than the square; memory bounds them.
SHARD, GROWTH, MOST_OF_SHARD = 4_000, 16, 100_000
#: Directions whose cosine is within this of one are a node together. Single precision resolves a hundredth of it.
NEAR = 1e-5


def shards_for(n: int) -> int:
    return max(1, -(-n // min(MOST_OF_SHARD, max(SHARD, GROWTH * math.isqrt(n)))))


def direction(vector: Iterable[float]) -> np.ndarray:
    """The vector divided by the power of two of its largest component. That is exact, so cosines stay the same to the last bit."""
    v = np.array(vector, np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1]) + 0.0  # no negative zeros


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nodes(units: np.ndarray, near: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are nodes, node of each row): every row is a node or within ``near`` of its own, and nodes are farther apart than that.

    Rows are met in the order of their projection to one line, on which two near rows are near too.
    """
    line = units @ (np.random.default_rng(5).normal(size=units.shape[1]) / math.sqrt(units.shape[1]))
    width = math.sqrt(2 * near) * np.linalg.norm(np.random.default_rng(5).normal(size=units.shape[1])) / math.sqrt(units.shape[1])
    order, heads, at, of = np.argsort(line, kind="stable"), np.zeros(len(units), np.int64), 0, np.full(len(units), -1, np.int64)
    for k in range(0, len(order), 256):
        part = order[k : k + 256]
        first = int(np.searchsorted(line[heads[:at]], line[part[0]] - width))
        if first < at:
            cosine = units[part] @ units[heads[first:at]].T
            best = cosine.argmax(axis=1)
            own = cosine[np.arange(len(part)), best] >= 1 - near
            of[part[own]] = first + best[own]
        free = part[of[part] < 0]
        together = units[free] @ units[free].T >= 1 - near
        open_ = np.ones(len(free), bool)
        for i in range(len(free)):
            if open_[i]:
                of[free[open_ & together[i]]] = at
                of[free[i]] = at
                open_ &= ~together[i]
                open_[i] = False
                heads[at] = free[i]
                at += 1
    return heads[:at], of


def beam(vectors: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cosines) of the ``width`` nearest met by a walk for each query, nearest first; all queries step together. -1 where fewer were met."""
    n, many = len(vectors), len(queries)
    ids = np.full((many, width), -1, np.int64)
    near = np.full((many, width), -np.inf, np.float32)
    open_ = np.zeros((many, width), bool)
    ids[:, 0], near[:, 0], open_[:, 0] = entry, queries @ vectors[entry], True
    met = np.zeros((many, n + 1), bool)
    met[:, entry] = met[:, n] = True
    live = np.arange(many)
    while len(live):
        at = np.argmax(open_[live], axis=1)
        some = open_[live, at]
        live, at = live[some], at[some]
        if not len(live):
            break
        open_[live, at] = False
        follow = graph[ids[live, at]]
        follow = np.where(follow < 0, n, follow)
        new = ~met[live[:, None], follow]
        met[live[:, None], follow] = True
        score = np.where(new, np.einsum("qrd,qd->qr", vectors[np.minimum(follow, n - 1)], queries[live]), -np.inf)
        all_near = np.concatenate([near[live], score], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        near[live] = np.take_along_axis(all_near, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], follow], axis=1), order, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], new], axis=1), order, 1) & (near[live] > -np.inf)
    ids[near == -np.inf] = -1
    return ids, near


def prune(vectors: np.ndarray, own: int, found: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Of the proposals, nearest first, those to which no kept neighbour is nearer by ``alpha`` than ``own`` is."""
    found = np.unique(found[(found >= 0) & (found != own)])
    if not len(found):
        return []
    far = 1 - vectors[found] @ vectors[own]
    order = np.argsort(far, kind="stable")
    found, far = found[order], far[order]
    between = 1 - vectors[found] @ vectors[found].T
    kept, alive = [], np.ones(len(found), bool)
    for i in range(len(found)):
        if alive[i]:
            kept.append(int(found[i]))
            if len(kept) == degree:
                break
            alive &= alpha * between[i] > far
    return kept


@dataclass
class Graph:
    """Vectors of the nodes (unit length, single precision), out-edges (-1: none), and where every walk begins."""

    vectors: np.ndarray
    edges: np.ndarray
    entry: int


@dataclass
class Shard:
    """A graph of nodes; the vectors of node i are rows ``start[i]`` to ``start[i + 1]`` of ``full``, each with the least ids that have it."""

    graph: Graph
    start: np.ndarray
    full: np.ndarray
    norms: np.ndarray
    least: list[list[int]]

    @classmethod
    def of(cls, same: dict[bytes, list[int]], degree: int) -> Shard:
        order = sorted(same, key=lambda v: (min(same[v]), v))
        full = np.frombuffer(b"".join(order)).reshape(len(order), -1)
        units = unit(full)
        heads, node = nodes(units)
        by_node = np.argsort(node, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(heads)))])
        full = full[by_node]
        return cls(build(units[heads].astype(np.float32), degree), start, full, np.linalg.norm(full, axis=1), [same[order[i]] for i in by_node.tolist()])

    def nearest(self, vectors: np.ndarray, own: list[int], k: int, width: int) -> Iterator[tuple[int, int, float]]:
        """(query, id, cosine) of the nearest met: all vectors of the nodes that the walk ends with are compared."""
        found, _ = beam(self.graph.vectors, self.graph.edges, self.graph.entry, unit(vectors).astype(np.float32), min(width, len(self.start) - 1))
        for met, v, me in zip(found, vectors, own, strict=True):
            met = met[met >= 0]
            size = self.start[met + 1] - self.start[met]
            rows = np.repeat(self.start[met] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cosine = (self.full[rows] * v).sum(axis=1) / (self.norms[rows] * np.linalg.norm(v))
            if len(rows) > k + 1:  # one of them may have no id but the query's own
                some = np.flatnonzero(cosine >= np.partition(cosine, len(cosine) - k - 1)[len(cosine) - k - 1])
                rows, cosine = rows[some], cosine[some]
            best = sorted((-c, i) for c, r in zip(cosine.tolist(), rows.tolist(), strict=True) for i in self.least[r] if i != me)[:k]
            yield from ((me, i, -c) for c, i in best)


def build(vectors: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2, step: int = 256, seed: int = 3) -> Graph:
    """Two passes over the vectors in random order, ``step`` at a time; the second with the relaxed ``alpha``."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    edges = np.full((n, degree), -1, np.int64)
    entry = int(np.argmax(vectors @ vectors.mean(axis=0)))
    start = min(n - 1, degree)
    for i in range(n if start else 0):  # random edges to begin with
        edges[i, :start] = (i + 1 + rng.choice(n - 1, start, replace=False)) % n
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        for k in range(0, n, step):
            part = order[k : k + step]
            found, _ = beam(vectors, edges, entry, vectors[part], width)
            back: dict[int, list[int]] = {}
            for i, f in zip(part.tolist(), found, strict=True):
                kept = prune(vectors, i, np.concatenate([f, edges[i]]), degree, factor)
                edges[i] = -1
                edges[i, : len(kept)] = kept
                for j in kept:
                    back.setdefault(j, []).append(i)
            for j, some in back.items():
                there = edges[j][edges[j] >= 0]
                add = [i for i in some if i not in set(there.tolist())]
                if len(there) + len(add) <= degree:
                    edges[j, len(there) : len(there) + len(add)] = add
                elif add:
                    kept = prune(vectors, j, np.concatenate([there, add]), degree, factor)
                    edges[j] = -1
                    edges[j, : len(kept)] = kept
    return Graph(vectors, edges, entry)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, finite in all components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, width: int = 160, degree: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to each query by cosine, but for the query's own row.

    Returns ``query_id, rank, vec_id, score``: rank from 1, the cosine of the original vectors in double precision, ties to
    the smaller id; fewer than ``k`` rows where there are fewer candidates. Rows whose vector is null, zero or not finite,
    whose id is null, or whose length is not the queries' take no part. Rows of one id and vector are one; an empty table
    gives no row; other columns are not read, whatever their names. Queries go to each shard, in blocks.
    """
    take = k + 1  # one of them may be the query itself
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    rows, asked = clean(vectors), clean(queries).distinct()
    shards = shards_for(rows.count())
    sent = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("v", pa.binary())])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct direction of a batch with its least ids, to the shard that its bytes name."""
        for b in batches:
            same: dict[bytes, list[int]] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                same.setdefault(direction(v).tobytes(), []).append(i)
            out = [(xxhash.xxh32_intdigest(v) % shards, 0, i, v) for v, ids in same.items() for i in sorted(set(ids))[:take]]
            if out:
                yield batch(sent, zip(*out, strict=True))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = pa.array([direction(v).tobytes() for v in b.column(1).to_pylist()], pa.binary())
            for s in range(shards):
                yield batch(sent, [np.full(b.num_rows, s, np.int32), np.ones(b.num_rows, np.int32), b.column(0), coded])

    answer = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shard after shard: first its vectors, of which a graph is built for each length, then the queries, block by block."""
        number, held, built = None, {}, None
        for b in batches:
            shard, kind, ids, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])).tolist() if len(shard) else []
            for start, end in zip(edges, [*edges[1:], len(shard)], strict=True):
                if shard[start] != number:
                    number, held, built = shard[start], {}, None
                if kind[start] == 0:
                    for i in range(start, end):
                        some = held.setdefault(raw[i], [])
                        if int(ids[i]) not in some:
                            held[raw[i]] = sorted([*some, int(ids[i])])[:take]
                    continue
                if built is None:
                    built, held = {size: Shard.of({v: i for v, i in held.items() if len(v) == size}, degree) for size in {len(v) for v in held}}, {}
                for at in range(start, end, 512):
                    out = []
                    for size, known in built.items():
                        mine = [i for i in range(at, min(at + 512, end)) if len(raw[i]) == size]
                        if mine:
                            out += known.nearest(np.frombuffer(b"".join(raw[i] for i in mine)).reshape(len(mine), -1), [int(ids[i]) for i in mine], k, width)
                    if out:
                        yield batch(answer, zip(*out, strict=True))

    both = rows.mapInArrow(deal, "shard int, kind int, id long, v binary").unionAll(asked.mapInArrow(ask, "shard int, kind int, id long, v binary"))
    found = both.repartition(2 * shards, F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """The same by comparing all, for measuring recall on a small table."""
    cosine = (vectors @ queries.T) / (np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :])
    return [sorted((-c, i) for c, i in zip(column.tolist(), ids.tolist(), strict=True) if i != q)[:k] for column, q in zip(cosine.T, query_ids.tolist(), strict=True)]
