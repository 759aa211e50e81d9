"""Toxicity by a factorization machine over hashed terms.

A term is a lower-case word or the first letters of a longer one, hashed to a slot. Besides a weight for each slot, every
pair of slots that a text holds adds the product of their factors, so that two terms may weigh more, or less, together
than each by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import batch, remainder_is, strings

BITS = 22
STEM = 5
#: All that is no ASCII letter and no part of a longer character separates words.
_WORDS = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else (c if c >= 128 else 32) for c in range(256))


def terms(text: str) -> np.ndarray:
    """Slots of the distinct words and stems of a text, sorted."""
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split())
    words |= {b"\0" + w[:STEM] for w in words if len(w) > STEM}
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) & ((1 << BITS) - 1))


@dataclass
class FactorizationMachine:
    """``row`` of a slot (-1: not used), bias, weights, factors."""

    row: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, held: list[np.ndarray]) -> np.ndarray:
        size = np.fromiter(map(len, held), np.int64, len(held))
        out = np.full(len(held), self.bias)
        if size.sum():
            flat, some = np.concatenate(held), np.flatnonzero(size)
            starts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            v = self.factor[flat]
            total = np.add.reduceat(v, starts)
            out[some] += np.add.reduceat(self.weight[flat], starts) + 0.5 * (total**2 - np.add.reduceat(v**2, starts)).sum(axis=1)
        return out

    def used(self, slots: np.ndarray) -> np.ndarray:
        rows = self.row[slots]
        return rows[rows >= 0]

    def predict(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.raw([self.used(terms(t)) for t in texts]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(held: list[np.ndarray], y: np.ndarray, seen: np.ndarray, least_chi2: float) -> np.ndarray:
    """Of the slots in ``seen``, those that tell the classes apart by themselves (chi-squared)."""
    n1, n = y.sum(), len(y)
    a, b = (np.bincount(np.concatenate([h for h, k in zip(held, y, strict=True) if k == c] or [np.zeros(0, np.int64)]), minlength=1 << BITS)[seen].astype(np.float64) for c in (0, 1))
    chi2 = n * (a * n1 - b * (n - n1)) ** 2 / np.maximum((n - n1) * n1 * (a + b) * (n - a - b), 1)
    return seen[chi2 >= least_chi2]


#: Cells of sums, and pairs in texts, that are held at once.
CELLS, EVENTS = 4_000_000, 4_000_000
#: Slots that a dense block has.
BLOCK = 1_024


def telling_pairs(held: list[np.ndarray], missed: np.ndarray, unsure: np.ndarray, seen: np.ndarray, least_chi2: float) -> np.ndarray:
    """Of the slots in ``seen``, those of pairs that tell what is still missed: over the texts with both, the sum of ``missed`` is too far from zero for its spread ``unsure``.

    All pairs that stand together in a text are looked at. A slot over whose texts too little is missed, either way, can be in
    no such pair and is left out. Sums come from the pairs of each text, or where texts hold a good part of the slots,
    from products of blocks of the matrix of texts and slots; both give all of them.
    """
    size = [len(h) for h in held]
    flat = np.concatenate(held)
    most = np.maximum(*(np.bincount(flat, np.repeat(np.maximum(sign * missed, 0), size), minlength=1 << BITS)[seen] for sign in (1, -1)))
    seen = seen[most**2 >= least_chi2]
    if len(seen) < 2:
        return seen[:0]
    place = np.full(1 << BITS, -1, np.int64)
    place[seen] = np.arange(len(seen))
    slot, text = place[flat], np.repeat(np.arange(len(held)), size)
    slot, text = slot[slot >= 0], text[slot >= 0]  # rising inside a text, as the terms are
    n = np.bincount(text, minlength=len(held))
    blocks = _dense_sums if (n.astype(np.float64) ** 2).sum() > 0.25 * len(held) * len(seen) ** 2 / 10 else _sparse_sums
    kept = np.zeros(len(seen), bool)
    for rows, columns, total, spread in blocks(slot, text, np.cumsum(n), missed, unsure, len(seen)):
        hit = total**2 >= least_chi2 * np.maximum(spread, 1)
        kept[rows] |= hit.any(axis=1)
        kept[columns] |= hit.any(axis=0)
    return seen[kept]


Sums = Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]


def _sparse_sums(slot: np.ndarray, text: np.ndarray, ends: np.ndarray, missed: np.ndarray, unsure: np.ndarray, slots: int) -> Sums:
    """Sums over the texts of each pair, for some slots with all later ones at a time: from the slots that follow each in its text."""
    order = np.argsort(slot, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=slots))])
    after = ends[text[order]] - order - 1  # slots of the text that follow
    events = np.concatenate([[0], np.cumsum(after)])
    lo = 0
    while lo < slots:
        hi = lo + 1
        while hi < slots and (hi + 1 - lo) * slots <= CELLS and events[first[hi + 1]] - events[first[lo]] <= EVENTS:
            hi += 1
        total, spread = np.zeros((hi - lo) * slots), np.zeros((hi - lo) * slots)
        at = first[lo]
        while at < first[hi]:
            to = max(at + 1, min(first[hi], int(np.searchsorted(events, events[at] + EVENTS, "right")) - 1))
            own, more = order[at:to], after[at:to]
            begin = np.cumsum(more) - more
            others = slot[np.repeat(own + 1 - begin, more) + np.arange(more.sum())]
            cell, by = np.repeat((slot[own] - lo) * slots, more) + others, np.repeat(text[own], more)
            total += np.bincount(cell, missed[by], minlength=len(total))
            spread += np.bincount(cell, unsure[by], minlength=len(spread))
            at = to
        yield slice(lo, hi), slice(0, slots), total.reshape(hi - lo, slots), spread.reshape(hi - lo, slots)
        lo = hi


def _dense_sums(slot: np.ndarray, text: np.ndarray, ends: np.ndarray, missed: np.ndarray, unsure: np.ndarray, slots: int) -> Sums:
    """The same by products of blocks of the matrix that says which text has which slot."""

    def block(lo: int) -> np.ndarray:
        x = np.zeros((len(missed), min(BLOCK, slots - lo)), np.float32)
        some = (slot >= lo) & (slot < lo + BLOCK)
        x[text[some], slot[some] - lo] = 1
        return x

    missed, unsure = missed.astype(np.float32)[:, None], unsure.astype(np.float32)[:, None]
    for lo in range(0, slots, BLOCK):
        a = block(lo)
        m, u = (a * missed).T, (a * unsure).T
        for at in range(lo, slots, BLOCK):
            b = a if at == lo else block(at)
            total, spread = m @ b, u @ b
            if at == lo:
                np.fill_diagonal(total, 0)  # a slot is no pair with itself
            yield slice(lo, lo + BLOCK), slice(at, at + BLOCK), total, spread


def learn(held: list[np.ndarray], y: np.ndarray, slots: np.ndarray, factors: int, passes: int, rate: float, decay: float, seed: int) -> FactorizationMachine:
    """A machine over these slots, by AdaGrad."""
    row = np.full(1 << BITS, -1, np.int32)
    row[slots] = np.arange(len(slots), dtype=np.int32)
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(row, float(np.log(y.sum() / (len(y) - y.sum()))), np.zeros(len(slots)), rng.normal(0, 0.02, (len(slots), factors)))
    x = [m.used(h) for h in held]
    gw, gv, gb = np.full(len(slots), 1e-6), np.full((len(slots), factors), 1e-6), 1e-6
    for _ in range(passes if len(slots) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            some = [x[i] for i in part]
            error = sigmoid(m.raw(some)) - y[part]
            g = error.mean()
            gb += g * g
            m.bias -= rate * g / np.sqrt(gb)
            size = np.fromiter(map(len, some), np.int64, len(some))
            if not size.sum():
                continue
            flat, full = np.concatenate(some), np.flatnonzero(size)
            starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
            total = np.repeat(np.add.reduceat(m.factor[flat], starts), size[full], axis=0)
            e = np.repeat(error[full], size[full]) / len(part)
            touched, back = np.unique(flat, return_inverse=True)
            dw, dv = np.zeros(len(touched)), np.zeros((len(touched), factors))
            np.add.at(dw, back, e)
            np.add.at(dv, back, e[:, None] * (total - m.factor[flat]))
            dw += decay * m.weight[touched]
            dv += decay * m.factor[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            m.weight[touched] -= rate * dw / np.sqrt(gw[touched])
            m.factor[touched] -= rate * dv / np.sqrt(gv[touched])
    return m


def fit(held: list[np.ndarray], labels: list[int], factors: int = 8, passes: int = 12, rate: float = 0.1, decay: float = 1e-4, least_texts: int = 4, least_chi2: float = 12.0, least_pair_chi2: float = 40.0, seed: int = 7) -> FactorizationMachine:
    """Learns from the terms of texts and their labels, 0 or 1.

    A slot is used if ``least_texts`` texts hold it and either it tells the classes apart by itself, or it does so in a pair
    with any other: a first machine is learned over slots of the first sort, and a pair of the second must tell what that
    machine misses. So two terms that say nothing alone, but much together, are used as well, however rare or frequent.
    The level for pairs is higher, as there are more of them.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        rate_of = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        return FactorizationMachine(np.full(1 << BITS, -1, np.int32), float(np.log(rate_of / (1 - rate_of))), np.zeros(0), np.zeros((0, factors)))
    support = np.bincount(np.concatenate(held), minlength=1 << BITS) if held else np.zeros(1 << BITS, np.int64)
    seen = np.flatnonzero(support >= least_texts)
    alone = telling(held, y, seen, least_chi2)
    first = learn(held, y, alone, factors, passes, rate, decay, seed)
    said = np.concatenate([sigmoid(first.raw([first.used(h) for h in held[k : k + 512]])) for k in range(0, len(held), 512)])
    pairs = telling_pairs(held, y - said, np.maximum(said * (1 - said), 0.05), seen, least_pair_chi2)
    more = np.union1d(alone, pairs)
    return first if len(more) == len(alone) else learn(held, y, more, factors, passes, rate, decay, seed)


def training_rows(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str) -> list[tuple[np.ndarray, int]]:
    """Terms and label of about ``most`` labelled texts (twice as many at most) by the id's hash, half of them toxic if there are enough; none of the held-out fold.

    Only terms travel, each once for a text, so a very long text is no larger than its vocabulary. Of rows of one id, one counts, by the hash of its text.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~remainder_is("id", 4, 2))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, most / 2 / n)))])
    drawn_rows = marked.filter(drawn < share[F.col("toxic")]).distinct().orderBy(drawn, "id", "toxic").limit(2 * most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.binary())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, [b.column(0), b.column(1), [terms(t).astype("<i4").tobytes() for t in strings(b.column(2))]])

    found = texts.join(F.broadcast(drawn_rows), "id")  # at most 2 * most rows of two numbers
    found = found.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted((r["id"], r["toxic"], bytes(r["terms"])) for r in found.mapInArrow(cut, "id long, toxic int, terms binary").collect())
    return [(np.frombuffer(raw, "<i4").astype(np.int64), toxic) for _, toxic, raw in rows]


def score(docs: DataFrame, labels: DataFrame, most: int = 8_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text for toxicity.

    Learns from about ``most`` labelled texts of the rows whose id's crc32 mod 4 is not 2 (a bounded sample by the id's
    hash, both classes alike in number); the model is bounded by ``BITS`` and goes to every task. Returns ``doc_id,
    held_out, score, predicted``, one row for each row of ``docs``, without an exchange of texts. A null text is scored as
    empty: by the bias alone. A null id is not held out. Labels other than 0 and 1 are not used; without labels of both
    classes every score is the same. A very long text is scored whole, by its distinct terms. Repeated rows get the same
    answer; an empty table gives none; other columns are not read, whatever their names.
    """
    rows = training_rows(docs, labels, most, id_col, text_col)
    machine = fit([x for x, _ in rows], [k for _, k in rows])
    toxic = sum(k for _, k in rows)
    if 0 < toxic < len(rows):  # the sample is even; the bias is put back to what is usual among labelled rows
        usual = labels.filter(F.col("toxic").isin(0, 1) & ~remainder_is("doc_id", 4, 2)).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        machine.bias += float(np.log(usual / (1 - usual)) - np.log(toxic / (len(rows) - toxic))) if 0 < usual < 1 else 0.0
    model = docs.sparkSession.sparkContext.broadcast(machine)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.value.predict(strings(b.column(2))) if b.num_rows else np.zeros(0)
            yield batch(schema, [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.select("doc_id", remainder_is("doc_id", 4, 2).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
