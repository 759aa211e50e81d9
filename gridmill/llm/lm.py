"""Language-model scores by a probabilistic suffix tree, beside a unigram base over words.

The tree reads a text as the bytes of its words, a space between two words and an end after the last. A context is kept if
it is frequent enough and its next-symbol distribution diverges from that of its longest proper suffix; kept contexts are
closed under suffixes. A context's distribution is smoothed by its suffix's (Witten-Bell), down to the uniform one. Each
symbol is scored in the state of the longest kept suffix of what stands before it.

The base needs the training count of each word. Texts lie dealt into groups; a group sends its distinct words with its own
counts, and gets each back with the count of all groups. So a frequent word is a row for each group, not for each text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import batch, checkpointed, remainder_is, small_runs, strings, text_partitions

DEPTH = 5
#: A kept context stands so often at least.
LEAST_COUNT = 16
#: Nats that a context tells beyond its suffix: for each of its symbols, and for all together.
LEAST_DIVERGENCE, LEAST_GAIN = 1e-3, 20.0
SPACE, END = 32, 10


def words_of(text: str) -> list[bytes]:
    """Lower-case (A-Z) words; bytes that are none of the six ASCII spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def symbols(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def gram_counts(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all strings of ``depth`` + 1 symbols, with their counts. A text begins after ``depth`` ends."""
    lead = b"\n" * depth
    raw = np.frombuffer(b"".join(lead + t for t in texts), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(raw) - depth, np.int64)
    for j in range(depth + 1):
        code = code << 8 | raw[j : j + len(code)]
    starts = np.cumsum([0] + [depth + len(t) for t in texts])[:-1] + depth
    wanted = np.zeros(len(raw), bool)
    for s, t in zip(starts.tolist(), texts, strict=True):
        wanted[s : s + len(t)] = True
    return np.unique(code[wanted[depth:]], return_counts=True)


@dataclass
class Level:
    """Kept contexts of one length, sorted, with log10 of the weight of their suffixes; their seen (context, class) codes, sorted, with log10 of the probability."""

    contexts: np.ndarray
    back: np.ndarray
    codes: np.ndarray
    logp: np.ndarray

    def columns(self) -> list[np.ndarray]:
        return [self.contexts, self.back, self.codes, self.logp]


def find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted array, and whether it does."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


@dataclass
class SuffixTree:
    """The class of each byte (0: too rare for one of its own), and a level for each length of context. What a context has not seen is left to its suffix."""

    classes: np.ndarray
    levels: list[Level]

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def of(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of the class in the lowest byte after the symbols above it; sorted codes are fastest."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for d in range(self.depth, -1, -1):
            level, part = self.levels[d], codes[left] & ((1 << (8 * (d + 1))) - 1)
            at, seen = find(level.codes, part)
            out[left[seen]] += level.logp[at[seen]]
            left, part = left[~seen], part[~seen]
            at, kept = find(level.contexts, part >> 8)
            out[left[kept]] += level.back[at[kept]]
        return out

    @property
    def logp(self) -> np.ndarray:
        """All states as rows of all classes, for a look at a small tree."""
        k = int(self.classes.max()) + 1
        rows = [SuffixTree(self.classes, self.levels[: d + 1]).of((level.contexts[:, None] << 8 | np.arange(k)).ravel()).reshape(-1, k) for d, level in enumerate(self.levels)]
        return np.concatenate(rows)

    def score(self, texts: list[bytes]) -> list[float]:
        """log10 of the probability of each text."""
        out = []
        for start, end in small_runs(texts, 2_000_000):
            code, begins = symbol_codes(texts[start:end], self.depth, self.classes)
            distinct, back = np.unique(code, return_inverse=True)
            out += np.add.reduceat(self.of(distinct)[back], begins).tolist()
        return out


def symbol_codes(texts: list[bytes], depth: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each symbol's class after the ``depth`` symbols before it, text after text, and where each text begins. A text begins after ``depth`` ends."""
    raw = np.frombuffer(b"".join(b"\n" * depth + t for t in texts), np.uint8)
    code = np.zeros(len(raw) - depth, np.int64)
    for j in range(depth):
        code = code << 8 | raw[j : j + len(code)]
    code = code << 8 | classes[raw[depth:]]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    own = np.arange(sizes.sum()) + np.repeat(depth * np.arange(len(texts)), sizes)
    return code[own], begins


def classes_of(symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A class for each byte seen ``LEAST_COUNT`` times, and one for all others: 0."""
    own = np.bincount(symbol, n, 256)
    classes, k = np.zeros(256, np.int64), 1
    for b in range(256):
        if own[b] >= LEAST_COUNT or b in (SPACE, END):
            classes[b], k = k, k + 1
    return classes


def grow(rows: dict[str, np.ndarray], depth: int = DEPTH, also: Iterable[int] = ()) -> SuffixTree:
    """The tree from (d, context, symbol, n): counts of symbols after contexts of d symbols, with all their suffixes. Contexts of the last level that are in ``also`` are kept anyway."""
    d, context, symbol, n = (rows[k] for k in ("d", "context", "symbol", "n"))
    classes = classes_of(symbol[d == 0], n[d == 0])
    k = int(classes.max()) + 1
    rare = 256 - (k - 1)
    uniform = np.full(k, 1 / 256)
    uniform[0] = rare / 256
    contexts, keep, back, codes, smooth = [], [], [], [], []
    for level in range(depth + 1):
        here = d == level
        code, at = np.unique(context[here].astype(np.int64) << 8 | classes[symbol[here]], return_inverse=True)
        count = np.bincount(at, n[here], len(code))
        if not level:
            seen = count > 0
            total, types = count.sum(), max(1, int(seen.sum()))
            p = types * uniform
            p[code[seen]] += count[seen]
            contexts, keep, back, codes, smooth = [np.zeros(1, np.int64)], [np.ones(1, bool)], [np.zeros(1)], [np.arange(k)], [p / (total + types)]
            continue
        known, row = np.unique(code >> 8, return_inverse=True)
        frequent = np.bincount(row, count, len(known)) >= LEAST_COUNT  # so are its suffixes, and none of its bytes is rare
        code, count = code[frequent[row]], count[frequent[row]]
        known, row = np.unique(code >> 8, return_inverse=True)
        over, found = find(codes[-1], code & ((1 << (8 * level)) - 1))
        if not found.all():
            raise ValueError("a context without its suffix")
        up = smooth[-1][over]
        total, types = np.bincount(row, count, len(known)), np.bincount(row, minlength=len(known))
        divergence = np.bincount(row, count * np.log(count / total[row] / up), len(known)) / np.maximum(total, 1)
        contexts.append(known)
        keep.append((divergence >= LEAST_DIVERGENCE) & (divergence * total >= LEAST_GAIN))
        back.append(np.log10(types / (total + types)))
        codes.append(code)
        smooth.append((count + types[row] * up) / (total + types)[row])
    at, found = find(contexts[depth], np.fromiter(also, np.int64))
    keep[depth][at[found]] = True
    for level in range(depth, 1, -1):  # a kept context keeps its suffixes
        at, _ = find(contexts[level - 1], contexts[level][keep[level]] & ((1 << (8 * (level - 1))) - 1))
        keep[level - 1][at] = True
    levels = []
    for known, kept, weight, code, p in zip(contexts, keep, back, codes, smooth, strict=True):
        use = kept[find(known, code >> 8)[0]]
        p = np.log10(np.where(code & 255 == 0, p / rare, p)[use])
        levels.append(Level(known[kept], weight[kept].astype(np.float32), code[use], p.astype(np.float32)))
    return SuffixTree(classes, levels)


def level_rows(codes: np.ndarray, n: np.ndarray, levels: Iterable[int]) -> dict[str, np.ndarray]:
    """(d, context, symbol, n) for contexts of each length, from strings with their counts."""
    out: list[tuple] = []
    for level in levels:
        code, at = np.unique(codes & ((1 << (8 * (level + 1))) - 1), return_inverse=True)
        out.append((np.full(len(code), level, np.int8), code >> 8, code & 255, np.bincount(at, n, len(code)).astype(np.int64)))
    return dict(zip(("d", "context", "symbol", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True))


#: The symbols of a context that say which task has it; all longer contexts with these last symbols are there too.
SHARED = 2
#: Rows of a tree (a kept context, or what one has seen) that are fetched and broadcast, 13 bytes each. A larger tree stays where it was grown.
MOST_FETCHED = 10_000_000
TREE = "d int, entry boolean, key long, value float"


def fit(rows: DataFrame, depth: int = DEPTH) -> SuffixTree:
    """The tree of the texts of ``rows`` (text), in one piece."""
    return whole(*grown(rows, depth))


def whole(head: SuffixTree, found: DataFrame) -> SuffixTree:
    """The tree of its upper levels and the fetched rows of the others."""
    t = found.toArrow()
    return with_levels(head, *(t.column(k).to_numpy() for k in ("d", "entry", "key", "value")))


def with_levels(head: SuffixTree, d: np.ndarray, entry: np.ndarray, key: np.ndarray, value: np.ndarray, depth: int = DEPTH) -> SuffixTree:
    deep = []
    for level in range(SHARED, max(depth, int(d.max(initial=0))) + 1):
        columns = []
        for kind in (False, True):
            at = np.flatnonzero((d == level) & (entry == kind))
            at = at[np.argsort(key[at])]
            columns += [key[at], value[at]]
        deep.append(Level(*columns))
    return SuffixTree(head.classes, head.levels + deep)


def grown(rows: DataFrame, depth: int = DEPTH) -> tuple[SuffixTree, DataFrame]:
    """The tree of the texts of ``rows`` (text): its levels of contexts of less than ``SHARED`` symbols, and the rows (``TREE``) of all others.

    Counts are summed over all texts; contexts are tested where they are counted, and only kept ones are rows.
    """
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            c, back = np.unique(np.concatenate([codes, *(x for x, _ in held)]), return_inverse=True)
            return c, np.bincount(back, np.concatenate([counts, *(y for _, y in held)]), len(c)).astype(np.int64)

        for b in batches:
            texts = strings(b.column(0))
            for start, end in small_runs(texts):
                held.append(gram_counts([symbols(words_of(t)) for t in texts[start:end]], depth))
                waiting += len(held[-1][0])
                if waiting > 2_000_000:
                    (codes, counts), held, waiting = merge(), [], 0
        codes, counts = merge()
        for k in range(0, len(codes), 50_000):
            yield batch(schema, [codes[k : k + 50_000], counts[k : k + 50_000]])

    grams = checkpointed(rows.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    pairs = grams.groupBy(F.col("code").bitwiseAND((1 << (8 * SHARED)) - 1).alias("code")).agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    top = level_rows(pairs.column("code").to_numpy(), pairs.column("n").to_numpy(), range(SHARED))
    told = pa.schema([("d", pa.int32()), ("entry", pa.bool_()), ("key", pa.int64()), ("value", pa.float32())])

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        own = level_rows(*map(np.concatenate, zip(*held, strict=True)), range(SHARED, depth + 1))
        tree = grow({k: np.concatenate([top[k], own[k]]) for k in top}, depth)
        for d in range(SHARED, depth + 1):
            contexts, back, codes, logp = tree.levels[d].columns()
            for entry, keys, values in ((False, contexts, back), (True, codes, logp)):
                for k in range(0, len(keys), 50_000):
                    part = keys[k : k + 50_000]
                    yield batch(told, [np.full(len(part), d, np.int32), np.full(len(part), entry), part, values[k : k + 50_000]])

    shared = F.shiftright(F.col("code"), 8).bitwiseAND((1 << (8 * SHARED)) - 1)
    found = checkpointed(grams.select("code", "n").repartition(text_partitions(rows), shared).mapInArrow(test, TREE))
    upper = F.col("key").bitwiseAND((1 << (8 * (SHARED - 1))) - 1)
    also = found.filter(~F.col("entry") & (F.col("d") == SHARED)).select(upper.alias("context")).distinct().toArrow()  # 256 at most
    return grow(top, SHARED - 1, also.column("context").to_numpy()), found


def looked_up(dealt: DataFrame, head: SuffixTree, found: DataFrame, tasks: int) -> DataFrame:
    """``part, word, value``: log10 of the probability of each distinct code of a group's symbols, from a tree that stays in its rows.

    Codes meet the part of the tree that has their last symbols; the groups are dealt over copies of it, so that no part is
    asked by all of them.
    """
    copies = max(1, tasks // 4096)
    upper = dealt.sparkSession.sparkContext.broadcast(head)
    asked, answer = pa.schema([("part", pa.int32()), ("word", pa.int64())]), pa.schema([("part", pa.int32()), ("word", pa.int64()), ("value", pa.float32())])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            parts, texts = b.column(0).to_numpy(), strings(b.column(3))
            for p in np.unique(parts).tolist():
                mine = [symbols(words_of(texts[i])) for i in np.flatnonzero(parts == p).tolist()]
                for start, end in small_runs(mine, 2_000_000):
                    held[p] = np.union1d(held.get(p, np.zeros(0, np.int64)), symbol_codes(mine[start:end], DEPTH, upper.value.classes)[0])
        for p, codes in held.items():
            for k in range(0, len(codes), 50_000):
                yield batch(asked, [np.full(len(codes[k : k + 50_000]), p, np.int32), codes[k : k + 50_000]])

    def tell(codes: pa.Table, rows: pa.Table) -> pa.Table:
        tree = with_levels(upper.value, *(rows.column(k).to_numpy(zero_copy_only=False) if k == "entry" else rows.column(k).to_numpy() for k in ("d", "entry", "key", "value")))
        word = codes.column("word").to_numpy()
        distinct, back = np.unique(word, return_inverse=True)
        return pa.table([codes.column("part"), codes.column("word"), pa.array(tree.of(distinct)[back], pa.float32())], schema=answer)

    mask = (1 << (8 * SHARED)) - 1
    context = lambda code: F.shiftright(F.col(code), 8).bitwiseAND(mask).cast("int")
    questions = dealt.mapInArrow(ask, "part int, word long").select("part", "word", context("word").alias("shared"), F.pmod("part", F.lit(copies)).alias("copy"))
    tree = found.withColumn("shared", F.when(F.col("entry"), context("key")).otherwise(F.col("key").bitwiseAND(mask).cast("int"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return questions.groupBy("shared", "copy").cogroup(tree.groupBy("shared", "copy")).applyInArrow(tell, "part int, word long, value float")


def word_keys(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n).view(np.int64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text, learning from the rows whose id's crc32 mod 7 is not 2.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row for each row of ``docs``. A
    null text is empty: one token, the end. A null id is not held out. Words are told apart by 64 bits of their hash.
    Without training rows every count is 0 and the tree is uniform. Repeated rows are learned as often as they stand; very
    long texts are read whole; an empty table gives no row; other columns are not read, whatever their names. A tree of more
    than ``MOST_FETCHED`` rows is neither fetched nor broadcast: groups of texts then ask it for the codes that they hold.
    """
    tasks = text_partitions(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", remainder_is("doc_id", 7, 2))
    head, found = grown(rows.filter(~F.col("held_out")))
    fetched = found.count() <= MOST_FETCHED
    tree = docs.sparkSession.sparkContext.broadcast(whole(head, found) if fetched else head)
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    dealt = rows.select(F.pmod(own, F.lit(2 * tasks)).cast("int").alias("part"), "doc_id", "held_out", "text").repartition(tasks, "part")
    asked = pa.schema([("word", pa.int64()), ("part", pa.int32()), ("n", pa.int64())])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Counter, set]] = {}
        for b in batches:
            for p, out, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strings(b.column(3)), strict=True):
                counts, others = held.setdefault(p, (Counter(), set()))
                (others if out else counts).update(words_of(text))
        for p, (counts, others) in held.items():
            counts.update(dict.fromkeys(others - counts.keys(), 0))
            words, n = list(counts), list(counts.values())
            for k in range(0, len(words), 50_000):
                part = words[k : k + 50_000]
                yield batch(asked, [word_keys(part, len(part)), np.full(len(part), p, np.int32), n[k : k + 50_000]])

    same = Window.partitionBy("word")  # a row for each group of texts at most
    counts = dealt.mapInArrow(ask, "word long, part int, n long").select("word", "part", F.sum("n").over(same).alias("n"), (F.min("part").over(same) == F.col("part")).alias("first"))
    if not fetched:
        chances = looked_up(dealt, head, found, tasks).select("word", "part", F.lit(None).cast("long").alias("n"), F.lit(False).alias("first"), "value")
        counts = counts.withColumn("value", F.lit(None).cast("float")).unionByName(chances)

    def tell(texts: pa.Table, answers: pa.Table) -> pa.Table:
        chances = None
        if not fetched:
            chances, answers = answers.filter(pc.is_valid(answers.column("value"))), answers.filter(pc.is_valid(answers.column("n")))
            codes, values = chances.column("word").to_numpy(), chances.column("value").to_numpy()
            order = np.argsort(codes)
            codes, values = codes[order], values[order].astype(np.float64)
        known, n = answers.column("word").to_numpy(), answers.column("n").to_numpy()
        order = np.argsort(known)
        known, n, gain = known[order], n[order], np.log10(n[order] + 1.0)
        ids, out, tokens, seen, base, spoken = [], texts.column("held_out").to_pylist(), [], [], [], []
        columns = texts.column("doc_id").to_pylist(), strings(texts.column("text"))
        for start, end in small_runs(columns[1], 1_000_000):
            split = [words_of(t) for t in columns[1][start:end]]
            for doc, words in zip(columns[0][start:end], split, strict=True):
                at = np.searchsorted(known, word_keys(words, len(words)))
                ids.append(doc)
                tokens.append(len(words) + 1)
                seen.append(int((n[at] > 0).sum()) if words else 0)
                base.append(float(gain[at].sum()) if words else 0.0)
            if chances is None:
                spoken += tree.value.score([symbols(w) for w in split])
            else:
                code, begins = symbol_codes([symbols(w) for w in split], DEPTH, tree.value.classes)
                spoken += np.add.reduceat(values[np.searchsorted(codes, code)], begins).tolist()
        distinct = int((answers.column("first").to_numpy(zero_copy_only=False) & (answers.column("n").to_numpy() > 0)).sum())
        kinds = [False] * len(ids) + [True]  # the last row is the group's own
        return pa.table([pa.array(x, t) for x, t in zip((kinds, [*ids, None], [*out, None], [*tokens, distinct], [*seen, 0], [*base, 0.0], [*spoken, 0.0]), (pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["own", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    told = checkpointed(dealt.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(tell, "own boolean, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"))
    trains = ~F.col("own") & ~F.col("held_out")
    texts, tokens, distinct = told.agg(F.count_if(trains), F.coalesce(F.sum(F.when(trains, F.col("n_tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("own"), F.col("n_tokens"))), F.lit(0))).first()
    distinct += texts > 0
    return told.filter(~F.col("own")).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + int(texts > 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(texts + 1) - F.col("n_tokens") * math.log10(tokens + distinct + 1)).alias("base_score"),
        "score",
    )
