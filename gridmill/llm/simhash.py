"""Near copies by SimHash fingerprints, found exactly by vantage-point trees.

A tree of vantage points, grown on a bounded sample of the distinct fingerprints, cuts all fingerprints into shards by
their Hamming distance to each vantage point. By the triangle bound two fingerprints within the radius of each other have
distances within the radius; so a fingerprint that lies near a cut is also sent across it, as a query. Each shard grows a
tree of its own and searches it, and returns a spanning forest of its links, never its pairs. Forests are joined by
alternating star contractions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import batch, checkpointed, release, remove, shared_folder, strings, text_partitions

SEED = 42
#: The tree that cuts shards grows on so many fingerprints for each shard, and so many at least: 2 MB at most.
SAMPLE_EACH, SAMPLE = 16, 4096
#: Fingerprints of a shard, about; shards at most.
SHARD, MOST_SHARDS = 4_000, 1 << 14
BUCKET = 256
MOST_PAIRS = 1_000_000


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the shingles of ``width`` words, repeats included; unsigned. 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]  # noqa: B905
    n = max(1, len(words) - width + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n, count = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        bits = np.unpackbits(h[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            count += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; the 64 bits are a signed long. A null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, width) for t in strings(b.column(1))], np.uint64)
            yield batch(schema, [b.column(0), pa.array(found.view(np.int64))])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# -- vantage-point trees ----------------------------------------------------


class Node:
    """A cut by the distance to a vantage point: up to ``cut`` inside, the others outside; or a leaf with a number and points."""

    __slots__ = ("vantage", "cut", "inside", "outside", "leaf", "points")


def distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


def grow(points: np.ndarray, most: int, rng: np.random.Generator, most_leaves: int, numbers: Iterator[int]) -> Node:
    """A tree with about ``most`` points in a leaf. Of some vantage points that one is taken whose cut is even and has few points near it."""
    node = Node()
    if len(points) > most and most_leaves > 1:
        best = None
        for vantage in rng.choice(points, min(8, len(points)), replace=False):
            count = np.bincount(distance(points, vantage), minlength=68)
            below = np.cumsum(count)
            for cut in range(65):
                small = min(below[cut], len(points) - below[cut])
                if small * 4 >= len(points) or (small and best is None):
                    near = count[max(0, cut - 1) : cut + 1].sum()
                    rank = (small * 4 < len(points), near - small / 4)
                    if best is None or rank < best[0]:
                        best = rank, vantage, cut
        if best:
            _, node.vantage, node.cut = best
            inside = distance(points, node.vantage) <= node.cut
            part = max(1, min(most_leaves - 1, round(most_leaves * inside.mean())))
            node.leaf, node.points = None, None
            node.inside = grow(points[inside], most, rng, part, numbers)
            node.outside = grow(points[~inside], most, rng, most_leaves - part, numbers)
            return node
    node.leaf, node.points = next(numbers), points
    return node


def reach(node: Node, points: np.ndarray, at: np.ndarray, home: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray, np.ndarray]]:
    """(leaf, indexes of points, whether at home there). A point at home crosses a cut outwards only: of a pair over the cut, the inner one asks."""
    if not len(at):
        return
    if node.leaf is not None:
        yield node, at, home
        return
    d = distance(points[at], node.vantage)
    inside = d <= node.cut
    left = inside | ~home & (d - radius <= node.cut)
    right = ~inside | (d + radius > node.cut)
    yield from reach(node.inside, points, at[left], (home & inside)[left], radius)
    yield from reach(node.outside, points, at[right], (home & ~inside)[right], radius)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(label, label[label]):
            label = label[label]


def forest(home: np.ndarray, asking: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, least point linked) of a spanning forest of all links of points at home with one another and with those asking."""
    points = np.unique(np.concatenate([home, asking]).view(np.int64)).view(np.uint64)
    label = np.arange(len(points))
    place = np.argsort(home.view(np.int64), kind="stable")
    own = np.searchsorted(points.view(np.int64), home.view(np.int64)[place])
    tree = grow(points[own], BUCKET, np.random.default_rng(1), 1 << 30, iter(range(1 << 60)))
    left, right, waiting = [], [], 0
    for leaf, at, _ in reach(tree, points, np.arange(len(points)), np.zeros(len(points), bool), radius):
        there = np.searchsorted(points.view(np.int64), leaf.points.view(np.int64))
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            for m in range(0, len(there), 1024):  # a leaf whose points can't be told apart may be large
                i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[there[m : m + 1024]][None, :]) <= radius)
                i, j = part[i], there[m : m + 1024][j]
                left.append(i[i != j])
                right.append(j[i != j])
                waiting += len(left[-1])
                if waiting > MOST_PAIRS:
                    label = labels_of(len(points), np.concatenate([*left, np.arange(len(points))]), np.concatenate([*right, label]))
                    left, right, waiting = [], [], 0
    label = labels_of(len(points), np.concatenate([*left, np.arange(len(points))]), np.concatenate([*right, label]))
    linked = np.flatnonzero(label != np.arange(len(points)))
    return points[linked].view(np.int64), points[label[linked]].view(np.int64)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``u, v`` with v < u: forests that join exactly the fingerprints within ``radius`` bits of each other, or by way of others."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = max(1, min(MOST_SHARDS, -(-n // SHARD)))
    drawn = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(max(SAMPLE, SAMPLE_EACH * shards))
    sample = drawn.toArrow().column("fp").to_numpy().view(np.uint64)
    tree = spark.sparkContext.broadcast(grow(np.sort(sample), max(4, len(sample) // shards), np.random.default_rng(0), shards, iter(range(1 << 60))))
    sent = pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("home", pa.bool_())])

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy().view(np.uint64)
            for leaf, at, home in reach(tree.value, points, np.arange(len(points)), np.ones(len(points), bool), radius):
                yield batch(sent, [np.full(len(at), leaf.leaf, np.int32), points[at].view(np.int64), home])

    def search(group: pa.Table) -> pa.Table:
        fp, home = group.column("fp").to_numpy().view(np.uint64), group.column("home").to_numpy(zero_copy_only=False)
        u, v = forest(fp[home], fp[~home], radius)
        return pa.table({"u": u, "v": v})

    return distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(search, "u long, v long")


def stars(edges: DataFrame) -> DataFrame:
    """``u, v``: every node of ``edges`` but the least of its component, and that least node. By alternating large and small stars.

    It ends when each node but a centre has one edge, and centres have none of their own.
    """
    edges = checkpointed(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1 and out > 0").isEmpty():
            return edges
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())


def components(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every text, and the least id that links of at most ``radius`` differing bits reach from it.

    Returns ``doc_id, fingerprint, component_id``, one row for each row of ``docs``. A null text, like an empty one, has
    fingerprint zero, which is linked like any other. Rows that repeat are rows of one component. A null id is never the
    least; a component of null ids only has none. Very long texts are read whole. An empty table gives no row; other columns
    are not read, whatever their names. Copies are one fingerprint from the start, so they cost no more than their rows.
    """
    rows = checkpointed(fingerprints(docs, width, id_col, text_col))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = stars(links(checkpointed(distinct.select("fp")), radius))
    root = distinct.join(joined.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reached = root.groupBy("root").agg(F.min("least").alias("component_id"))
    member = root.select("fp", "root").join(reached, "root").select("fp", "component_id")
    return rows.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies by likeness ------------------------------------------------

#: Minima by which texts meet first. They find most links cheaply; those that they miss are found by rare shingles.
MINIMA = 3
#: Classes that are compared in one task.
BLOCK = 2_000
#: Two fingerprints within this are likely to be alike, and looked at first.
NEAR_BITS = 24
#: Buckets by which shingles of large meetings are counted.
BUCKETS = 1 << 20


def shingle_set(text: str, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else [b" ".join(words)] * bool(words)  # noqa: B905
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))


def minima(shingles: np.ndarray) -> list[int]:
    """The least value of the set under each of ``MINIMA`` permutations, marked by its number. Two sets share one as often as they are alike."""
    out = []
    for i in range(MINIMA if len(shingles) else 0):
        x = (shingles ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        out.append(xxhash.xxh64_intdigest(int((x ^ (x >> np.uint64(29))).min()).to_bytes(8, "little"), i) - (1 << 63))
    return out


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard likeness of two sets is ``least`` or more."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def overlaps(sets: list[np.ndarray], rows: Iterable[int], most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``rows``, how many members it has in common with each of the sets, from the holders of each member."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    end = np.cumsum(size)
    _, member, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(member, kind="stable")]
    first = np.cumsum(n) - n
    for i in rows:
        own = member[end[i] - size[i] : end[i]]
        own = own[n[own] > 1]
        both, ends = np.zeros(len(sets), np.int64), np.cumsum(n[own])
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            part = n[own[at:to]]
            where = np.repeat(first[own[at:to]] - np.cumsum(part) + part, part) + np.arange(part.sum())
            both += np.bincount(holders[where], minlength=len(sets))
            at = to
        yield i, both


class Joined:
    """Who is joined with whom: the least place of each group."""

    def __init__(self, known: list[int]):
        first: dict[int, int] = {}
        self.root = [first.setdefault(k, i) for i, k in enumerate(known)]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.root))])


def near_edges(ids: list[int], points: np.ndarray, sets: list[np.ndarray], guest: list[bool], least: float, known: list[int] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that join all members alike, and the members' roots. Who is joined already (equal in ``known``, or by an edge) is not compared.

    Without guests all are compared with all: a vantage-point tree over the fingerprints proposes those within ``NEAR_BITS``,
    and the sets decide. That joins most, and cheaply; whoever is outside the largest group then is compared with all others
    by counts of common members, so that no pair is lost whatever its fingerprints. Where there are guests, they are
    compared with the others, and nobody else.
    """
    joined, edges = Joined(ids if known is None else known), []
    guests = np.array(guest, bool)
    if not guests.any():
        distinct, back = np.unique(points.view(np.int64), return_inverse=True)
        holders: list[list[int]] = [[] for _ in distinct]
        for i, k in enumerate(back.tolist()):
            holders[k].append(i)
        values = distinct.view(np.uint64)
        tree = grow(values, BUCKET, np.random.default_rng(1), 1 << 30, iter(range(1 << 60)))
        for leaf, at, _ in reach(tree, values, np.arange(len(values)), np.zeros(len(values), bool), NEAR_BITS):
            there = np.searchsorted(distinct, leaf.points.view(np.int64))
            for k in range(0, len(at), 1024):
                x, y = np.nonzero(np.bitwise_count(values[at[k : k + 1024]][:, None] ^ leaf.points[None, :]) <= NEAR_BITS)
                for p, q in zip(at[k : k + 1024][x].tolist(), there[y].tolist(), strict=True):
                    for i in holders[p] if p <= q else ():
                        for j in holders[q]:
                            if (p < q or i < j) and joined.find(i) != joined.find(j) and alike(sets[i], sets[j], least):
                                joined.join(i, j)
                                edges.append((ids[i], ids[j]))
    roots = joined.roots()
    asking = np.flatnonzero(guests) if guests.any() else np.flatnonzero(roots != np.bincount(roots).argmax())
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    for i, both in overlaps(sets, asking.tolist()) if len(asking) else ():
        for j in np.flatnonzero((both > 0) & (both >= least * (size[i] + size - both)) & (roots != roots[i]) & ~(guests & guests[i])).tolist():
            if joined.join(i, j):
                edges.append((ids[i], ids[j]))
    return edges, joined.roots()


def prefix(shingles: np.ndarray, counts: np.ndarray, likeness: float, common: int = 1) -> np.ndarray:
    """The rarest members of a set, as many as two sets alike by ``likeness`` cannot both do without: they have ``common`` of these in common.

    Rare by the count of a member's bucket, ties by the member itself; any order that is the same for all sets would do.
    """
    order = np.lexsort((shingles, counts[shingles >> np.uint32(32 - (BUCKETS.bit_length() - 1))]))
    return shingles[order[: len(shingles) - int(np.ceil(likeness * len(shingles) - 1e-9)) + common]]


def _common_counts(sets: DataFrame) -> np.ndarray:
    """How often the members of all sets fall into each of ``BUCKETS`` buckets, which is all that comes to the driver."""
    schema, shift = pa.schema([("bucket", pa.int32()), ("n", pa.int64())]), np.uint32(32 - (BUCKETS.bit_length() - 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(raw, np.uint32) >> shift, minlength=BUCKETS) if len(raw) > BUCKETS else 0
                if len(raw) <= BUCKETS:
                    np.add.at(n, np.frombuffer(raw, np.uint32) >> shift, 1)
        some = np.flatnonzero(n)
        for k in range(0, len(some), 50_000):
            yield batch(schema, [some[k : k + 50_000].astype(np.int32), n[some[k : k + 50_000]]])

    one_each = sets.select("shingles").coalesce(sets.sparkSession.sparkContext.defaultParallelism)  # what a task tells is as large as all buckets, whatever it reads
    found = one_each.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def near_copies(docs: DataFrame, width: int = 5, likeness: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every row: documents whose sets of ``width``-word shingles are alike by ``likeness`` or more, or by way of others.

    Documents of equal sets are one class from the start. Classes meet first where one of three minima of their sets is the
    same; there a vantage-point tree over SimHash fingerprints of the sets proposes pairs, what it leaves apart is counted
    out, and the sets decide (by 32 bits of each shingle's hash). A meeting of more than ``BLOCK`` classes, as a passage that
    very many documents have makes one, is dealt into blocks. Each block is compared in itself and with the least class; then
    the heads of its large groups visit the other blocks. That finds most groups, and loses some links. Two sets alike have
    one of their rarest shingles in common, whatever else: by these all classes meet again, where two groups do that are
    not joined yet, and there all are compared. Where more than ``BLOCK`` have a rare shingle, they meet by it and a second
    one, as sets alike have two of one more; only what shares both so often is compared in pairs of blocks. So no link is
    lost. Documents without a word are one class; a null text has none. A row with a null id stands alone, with a null
    component. Rows of one id have each the group of their own text. Very long texts are read whole; an empty table
    gives no row; other columns are not read, whatever their names.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width) for t in strings(b.column(1))]
            yield batch(schema, [b.column(0), [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], [minima(s) for s in sets]])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(texts.mapInArrow(read, "doc_id long, own long, keys array<long>"))
    classes = checkpointed(rows.filter("doc_id is not null").groupBy("own").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")))
    each = classes.select("own", F.explode("keys").alias("key"))
    counts = _meetings(each)
    met = checkpointed(each.join(counts, "key"))
    del each
    packed = pa.schema([("own", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("outline", pa.binary()), ("shingles", pa.binary())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The set of each text, with its outline; of equal ones a task sends one."""
        sent: set[int] = set()
        for b in batches:
            texts_ = strings(b.column(0))
            for start in range(0, len(texts_), 1_000):
                out = []
                for text in texts_[start : start + 1_000]:
                    s = shingle_set(text, width)
                    own = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
                    if own not in sent:
                        sent.add(own)
                        short = np.unique(s.astype(np.uint32))
                        out.append((own, int(np.uint64(majority(s)).view(np.int64)), len(short), outline(short).tobytes(), short.tobytes()))
                if out:
                    yield batch(packed, zip(*out, strict=True))

    spark, n_sets = docs.sparkSession, text_partitions(docs)
    work = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"
    packs = texts.filter("doc_id is not null").select("text").mapInArrow(pack, "own long, fp long, size int, outline binary, shingles binary")
    table = f"near_{uuid.uuid4().hex}"  # it lies by ``own``, so joins by that do not exchange the sets again
    packs.repartition(n_sets, "own").dropDuplicates(["own"]).write.bucketBy(n_sets, "own").format("parquet").option("path", f"{work}/sets").saveAsTable(table)
    sets = spark.table(table)
    release(spark)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = F.pmod(F.xxhash64("own"), blocks).cast("int")
    all_blocks = F.sequence(F.lit(0), blocks - 1)
    told = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("head", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Group after group of (key, block): edges, and the heads of a large block's large groups."""
        at, group = None, []

        def close() -> list[tuple]:
            unique = {r[0]: r for r in sorted(group, key=lambda r: r[3])}  # a guest may stand in its own block too
            members = [unique[i] for i in sorted(unique)]
            ids = [r[0] for r in members]
            edges, roots = near_edges(ids, np.array([r[1] for r in members], np.int64).view(np.uint64), [np.frombuffer(r[2], np.uint32) for r in members], [r[3] for r in members], likeness, [i if r[4] is None else r[4] for i, r in zip(ids, members, strict=True)])
            out = [(max(e), min(e), None, None) for e in edges]
            if members[0][5]:
                size = np.bincount(roots)
                out += [(None, None, at[0], ids[k]) for k in np.flatnonzero(size >= max(2, len(ids) / 20)).tolist()]
            return out

        found: list[tuple] = []
        for b in batches:
            for key, block, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, block) != at:
                    if len(group) > 1:
                        found += close()
                    at, group = (key, block), []
                    if len(found) > 20_000:
                        yield batch(told, zip(*found, strict=True))
                        found = []
                group.append(row)
        if len(group) > 1:
            found += close()
        if found:
            yield batch(told, zip(*found, strict=True))

    def meeting(who: DataFrame) -> DataFrame:
        """``who``: key, block, own, guest, root (the group it is in, or null), heads (whether heads of groups are asked for)."""
        full = who.join(sets, "own").select("key", "block", "own", "fp", "shingles", "guest", "root", "heads")
        return _written(full.repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block").mapInArrow(run, "u long, v long, key long, head long"), work)

    none, no = F.lit(None).cast("long").alias("root"), F.lit(False)
    first = meeting(met.select("key", spread.alias("block"), "own", no.alias("guest"), none, (blocks > 1).alias("heads")))
    edges, large = first.filter("u is not null").select("u", "v"), met.filter(F.col("n") > BLOCK)
    if not large.isEmpty():
        sized = counts.filter(F.col("n") > BLOCK).select("key", "n")
        guests = first.filter("head is not null").select("key", F.col("head").alias("own")).unionAll(large.groupBy("key").agg(F.min("own").alias("own"))).distinct()
        visits = guests.join(sized, "key").select("key", F.explode(all_blocks).alias("block"), "own", F.lit(True).alias("guest"), none, no.alias("heads"))
        hosts = large.select("key", spread.alias("block"), "own", no.alias("guest"), none, no.alias("heads"))
        edges = edges.unionAll(meeting(hosts.unionAll(visits)).filter("u is not null").select("u", "v"))
    group = _written(stars(edges).select(F.col("u").alias("own"), F.col("v").alias("root")), f"{work}-groups")
    del met, counts, large, first, edges
    release(spark)
    of = lambda rows: rows.join(group, "own", "left").withColumn("root", F.coalesce("root", "own"))
    common = spark.sparkContext.broadcast(_common_counts(sets).astype(np.int32))
    rare, twice = pa.schema([("own", pa.int64()), ("key", pa.int64())]), pa.schema([("own", pa.int64()), ("root", pa.int64()), ("key", pa.int64())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rarest shingles of each class."""
        for b in batches:
            for start in range(0, b.num_rows, 1_000):
                part = b.slice(start, 1_000)
                keys = [prefix(np.frombuffer(raw, np.uint32), common.value, likeness) for raw in part.column(1).to_pylist()]
                yield batch(rare, [np.repeat(part.column(0).to_numpy(), list(map(len, keys))), np.concatenate(keys).astype(np.int64)])

    def cut_twice(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A frequent one of them with each other of one more."""
        for b in batches:
            for own, root, raw, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                others = prefix(np.frombuffer(raw, np.uint32), common.value, likeness, 2)
                pairs = [xxhash.xxh64_intdigest(int(x).to_bytes(4, "little"), key) - (1 << 63) for x in others if int(x) != key]
                if pairs:
                    yield batch(twice, [np.repeat(own, len(pairs)), np.repeat(root, len(pairs)), pairs])

    tokens = sets.select("own", "shingles").mapInArrow(cut, "own long, key long")
    # most are one class's alone; those of several are found by their counts, and only they go on
    several = _written(tokens.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), work)
    release(spark)
    shared = _written(tokens.join(several, "key"), work)
    release(spark)
    again = _mixed(of(shared), work)
    often = again.filter(F.col("n") > BLOCK)
    if not often.isEmpty():
        split = often.join(sets, "own").select("own", "root", "shingles", "key").mapInArrow(cut_twice, "own long, root long, key long")
        again = _written(again.filter(F.col("n") <= BLOCK).unionByName(_mixed(_written(split, work), work)), work)
    pairs = F.transform(all_blocks, lambda i: F.least(i, spread) * blocks + F.greatest(i, spread))  # a place for each two blocks
    dealt = again.select("key", F.explode(F.when(blocks > 1, pairs).otherwise(F.array(F.lit(0)))).alias("block"), "own", "root")
    release(spark)
    more = meeting(_worth_comparing(dealt, sets, likeness, work).select("key", "block", "own", no.alias("guest"), "root", no.alias("heads"))).filter("u is not null").select("u", "v")
    whole = classes.select("own", "id")
    if more.isEmpty():
        found = of(whole).withColumnRenamed("root", "group")
    else:  # groups are joined, as a whole
        ends = of(of(more.withColumnRenamed("u", "own")).select("root", F.col("v").alias("own")).withColumnRenamed("root", "v")).select(F.col("v").alias("u"), F.col("root").alias("v"))
        joined = stars(ends).select(F.col("u").alias("root"), F.col("v").alias("group"))
        found = of(whole).join(joined, "root", "left").select("own", "id", F.coalesce("group", "root").alias("group"))
    spark.sql(f"drop table {table}")
    remove(spark, work)
    release(spark)
    least_id = found.groupBy("group").agg(F.min("id").alias("component_id"))
    member = found.join(least_id, "group").select("own", "component_id")
    return rows.join(member, "own", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _written(rows: DataFrame, folder: str) -> DataFrame:
    """Written to a folder that is shared and read again, smaller than a checkpoint, and of a size that a join knows."""
    path = f"{folder}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _mixed(tokens: DataFrame, folder: str) -> DataFrame:
    """``own, root, key, n`` of the tokens (own, root, key) that two groups or more have; of those that the same classes have, one."""
    return _written(tokens.join(_meetings(tokens, "root"), "key"), folder)


#: Bits of the outline of a set, at least.
OUTLINE = 1024


def outline(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of members falls into each of as many buckets as there are members, or twice as many at most: a bit each, a 32nd to a 16th of a large set. Two sets differ in as many members as their outlines in bits, or more."""
    n = max(OUTLINE, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits((np.bincount(shingles & np.uint32(n - 1), minlength=n) & 1).astype(np.uint8))


def may_be_alike(size: np.ndarray, outlines: Sequence[np.ndarray], root: np.ndarray, likeness: float, at: slice) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of two groups, the first in ``at``, that their sizes and outlines do not show to be unlike.

    The longer outline of a pair is folded to the shorter one: halves of a bit's buckets make one.
    """
    small, large = (f(size[at][:, None], size[None, :]) for f in (np.minimum, np.maximum))
    i, j = np.nonzero((small >= likeness * large - 1e-6) & (root[at][:, None] != root[None, :]))
    i += at.start
    i, j = i[i < j], j[i < j]
    width = np.fromiter(map(len, outlines), np.int64, len(outlines))
    least, apart = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        who, back = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        bits = np.stack([np.bitwise_xor.reduce(outlines[k].reshape(-1, w), axis=0) for k in who.tolist()]).view(np.uint64)
        for k in range(0, len(pairs), step := max(1, (4 << 20) // w)):
            x, y = back[k : min(k + step, len(pairs))], back[len(pairs) + k : len(pairs) + k + step]
            apart[pairs[k : k + step]] = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
    near = apart <= (size[i] + size[j]) * (1 - likeness) / (1 + likeness) + 1e-6
    return i[near], j[near]


def _worth_comparing(dealt: DataFrame, sets: DataFrame, likeness: float, folder: str) -> DataFrame:
    """``key, block, own, root`` of the meetings (the same) in which sets must be compared, with the members of pairs that outlines leave.

    An outline is far smaller than its set, so a class that meets others by many shingles does not bring its set to each of them: a
    pair that meets often is compared in one of its meetings. A meeting in which outlines leave more than ``4`` pairs for a
    member stays as it is, so that no pairs of a large group are made.
    """
    told = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("u", pa.int64()), ("ru", pa.int64()), ("v", pa.int64()), ("rv", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def close() -> list[tuple]:
            members = sorted({r[0]: r for r in group}.values())
            own, root = (np.array([r[k] for r in members], np.int64) for k in (0, 1))
            size = np.array([r[2] for r in members], np.int64)
            outlines = [np.frombuffer(r[3], np.uint8) for r in members]
            out: list[tuple] = []
            for start in range(0, len(members), 64):
                i, j = may_be_alike(size, outlines, root, likeness, slice(start, min(start + 64, len(members))))
                out += [(*at, *x) for x in zip(own[i].tolist(), root[i].tolist(), own[j].tolist(), root[j].tolist(), strict=True)]
                if len(out) > 4 * len(members) > 40:
                    return [(*at, r[0], r[1], None, None) for r in members]
            return out

        found: list[tuple] = []
        for b in batches:
            for key, block, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, block) != at:
                    if len(group) > 1:
                        found += close()
                    at, group = (key, block), []
                    if len(found) > 20_000:
                        yield batch(told, zip(*found, strict=True))
                        found = []
                group.append(row)
        if len(group) > 1:
            found += close()
        if found:
            yield batch(told, zip(*found, strict=True))

    full = dealt.join(sets, "own").select("key", "block", "own", "root", "size", "outline")
    found = _written(full.repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block").mapInArrow(run, "key long, block int, u long, ru long, v long, rv long"), folder)
    whole = found.filter("v is null").select("key", "block", F.col("u").alias("own"), F.col("ru").alias("root"))
    once = found.filter("v is not null").groupBy("u", "v").agg(F.min(F.struct("key", "block")).alias("at"), F.first("ru").alias("ru"), F.first("rv").alias("rv"))
    both = F.explode(F.array(F.struct(F.col("u").alias("own"), F.col("ru").alias("root")), F.struct(F.col("v").alias("own"), F.col("rv").alias("root")))).alias("x")
    return _written(whole.unionByName(once.select("at.key", "at.block", both).select("key", "block", "x.own", "x.root")).distinct(), folder)


def _meetings(each: DataFrame, apart: str | None = None) -> DataFrame:
    """``key, n`` of the keys that two or more have (own, key), and two or more groups if ``apart`` names them; of keys that the same have, one."""
    same = [F.bit_xor(F.xxhash64("own", F.lit(i))).alias(f"same{i}") for i in range(2)]
    groups = [(F.min(apart) != F.max(apart)).alias("mixed")] if apart else [F.lit(True).alias("mixed")]
    counts = each.groupBy("key").agg(F.count("*").alias("n"), *same, *groups).filter("n > 1 and mixed")
    return counts.groupBy("n", "same0", "same1").agg(F.min("key").alias("key")).select("key", "n")


def keep_first(docs: DataFrame, width: int = 5, likeness: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, that are the least of their near copies.

    Rows with a null id stay. Of rows with one id, one stays, the first by the hash of its text, and none if one of them is a
    near copy of a lesser id. A null text is like an empty one; an empty table gives no row.
    """
    found = checkpointed(near_copies(docs, width, likeness, id_col, text_col).select(F.col("doc_id").alias(id_col), "component_id"))
    kept = docs.join(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), id_col, "left_anti")
    repeated = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col)
    if repeated.isEmpty():
        return kept
    name = "turn" + "_" * max(map(len, docs.columns))
    turn = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))
    first = kept.join(repeated, id_col, "left_semi").withColumn(name, turn).filter(F.col(name) == 1).drop(name)
    return kept.join(repeated, id_col, "left_anti").unionAll(first)
