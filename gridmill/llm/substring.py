"""Passages that an earlier document has, found by suffix automata and removed.

A passage is a window of so many consecutive words. Each window is pinned at its word n-gram of least hash, which any
other place of the same window has too. Three rounds go over texts that lie dealt into groups once:

1. A group asks, for each distinct pivot it holds, whether another document has it. An answer comes for those that do.
2. For these the group sends the words around the pivot, as far as windows with this pivot reach, each distinct piece
   once. All pieces of one pivot meet: they are a reference shard. A suffix automaton of the shard knows for each of its
   states the least document that holds the state's strings; the pieces stream through it for matching statistics, and
   where these reach the length of a window the state tells its first document. A pivot that very many documents have is
   not one shard: its windows are sent, each keyed by itself, so that a shard has a row for a group of documents at most.
3. A group takes the answers, and removes in each document the maximal spans of windows that an earlier document has.

Reference shards meet their documents by an exchange, as the automata of a corpus that is deduplicated against itself grow
with it. Where the reference is bounded (a benchmark), ``remove_reference`` broadcasts its automata.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import batch, small_runs, strings, text_partitions

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Pivots of more documents than this are sent window by window.
HOT = 1_000
#: Characters of texts whose words are hashed together, and bytes of a word that are.
RUN, LONG_WORD = 1_000_000, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_NO = np.iinfo(np.int64).max


class SuffixAutomaton:
    """Suffix automaton of sequences of words; each state knows the least number of a sequence that holds its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [_NO]

    def add(self, words: list, number: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
            else:
                if q is None:
                    new = self._state(length[last] + 1, {})
                    p = last
                    while p >= 0 and w not in nxt[p]:
                        nxt[p][w] = new
                        p = link[p]
                    if p < 0:
                        link[new] = 0
                    else:
                        q = nxt[p][w]
                        link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
                    last = new
                else:
                    last = self._clone(last, q, w)
            if number < first[last]:
                first[last] = number

    def _state(self, length: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        self.first.append(_NO)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        self.first[clone] = self.first[q]
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def finish(self) -> None:
        """Hands each state's least number on to its suffixes."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.first[s] < self.first[p]:
                self.first[p] = self.first[s]

    def statistics(self, words: list, most: int) -> Iterator[tuple[int, int]]:
        """For each word: the length of the longest match that ends there, up to ``most``, and the least number that holds it."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state, matched = nxt[state][w], matched + 1
            if matched > most:
                matched = most
            while state and length[link[state]] >= matched:
                state = link[state]
            yield matched, first[state]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word ``raw[start:end]``, eight bytes of all words at a time."""
    eights = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))
    length = ends - starts
    out = length.astype(np.uint64) * _MULTIPLIER
    for k in range(0, LONG_WORD, 8):
        some = np.flatnonzero(length > k)
        if not len(some):
            break
        part = eights[starts[some] + k] & _FIRST_BYTES[np.minimum(length[some] - k, 8)]
        h = (out[some] ^ part) * _MULTIPLIER
        out[some] = h ^ (h >> np.uint64(32))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * _MULTIPLIER + hashes[j : j + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class Texts:
    """Words of some texts at once, with single spaces between: where each lies, which text it is of, and its hash."""

    def __init__(self, raws: list[bytes], counts: list[int]):
        self.raw = b" ".join(raws)
        gaps = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 32)
        self.starts, self.ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(self.raw)]])
        self.owner = np.repeat(np.arange(len(raws)), counts)
        self.hashes = word_hashes(self.raw, self.starts, self.ends)

    def pieces(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The words from each ``first`` to its ``last``."""
        return [self.raw[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist(), strict=True)]


def each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` numbers from each ``first`` on, one range after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Windows:
    """How windows of ``size`` words are pinned at n-grams of ``gram`` words. Windows are numbered by their first words."""

    def __init__(self, size: int):
        if not 2 <= size <= 200:
            raise ValueError("a window has 2 to 200 words")
        self.size = size
        self.gram = min(size, 5 if size < 20 else 8)

    def pivots(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first window, last window) of each pivot of texts of at least ``size`` words; no window reaches into the next text."""
        grams = gram_hashes(texts.hashes, self.gram)
        low = np.uint64(255)
        best, reach, wanted = grams & ~low, 1, self.size - self.gram + 1
        while reach < wanted:  # the least of ``reach`` n-grams, with its place among them in the low byte
            step = min(reach, wanted - reach)
            best = np.minimum(best[:-step], best[step:] + np.uint64(step))
            reach += step
        inside = np.flatnonzero(texts.owner[: len(best)] == texts.owner[self.size - 1 :])
        at = inside + (best[inside] & low).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return (grams[at[starts]] & ~np.uint64(1)).view(np.int64), inside[starts], inside[np.concatenate([starts[1:], [len(at)]]) - 1]

    def alone(self, texts: Texts) -> np.ndarray:
        """The key of each window that is sent by itself; it is odd, those of pivots are even."""
        return (gram_hashes(texts.hashes, self.size) | np.uint64(1)).view(np.int64)


def plain(text: str) -> bytes:
    """The words, joined by single spaces."""
    raw = text.encode("utf-8", "surrogatepass").translate(_SPACES)
    return b" ".join(raw.split()) if b"  " in raw or raw[:1] == b" " or raw[-1:] == b" " else raw


def _some(windows: Windows, docs: list, texts: list[str]) -> Iterator[tuple[int, list[bytes], list[int], list[int], Texts | None]]:
    """Some texts at a time: the first one's place, all as ``plain``, their counts of words, which have an id and a window, and these as Texts."""
    for a, b in small_runs(texts, RUN):
        raws = [plain(t) for t in texts[a:b]]
        counts = [r.count(b" ") + 1 if r else 0 for r in raws]
        long = [i for i, n in enumerate(counts) if n >= windows.size and docs[a + i] is not None]
        yield a, raws, counts, long, Texts([raws[i] for i in long], [counts[i] for i in long]) if long else None


def split(text: str) -> list[bytes]:
    """Words: bytes that are none of the six ASCII spaces."""
    return text.encode("utf-8", "surrogatepass").split()


def _ask(windows: Windows):
    """Round 1: (hash, least id, greatest less least, documents) of each distinct pivot of a group. The least id tells the group."""
    schema = pa.schema([("hash", pa.int64()), ("low", pa.int64()), ("more", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            parts, docs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start, _, _, long, texts in _some(windows, docs, strings(b.column(2))):
                if texts is None:
                    continue
                h, first, _ = windows.pivots(texts)
                of = np.array([parts[start + i] for i in long])[texts.owner[first]]
                d = np.array([docs[start + i] for i in long], np.int64)[texts.owner[first]]
                for p in np.unique(of).tolist():
                    held.setdefault(p, []).append((h[of == p], d[of == p]))
        for parts in held.values():
            h, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d = h[new], d[new]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ends = np.concatenate([starts[1:], [len(h)]])
            for k in range(0, len(starts), 50_000):
                s, e = starts[k : k + 50_000], ends[k : k + 50_000]
                yield batch(schema, [h[s], d[s], d[e - 1] - d[s], e - s])

    return run


def _send(windows: Windows):
    """Round 2: (key, words, least id, greatest less least) of each distinct piece around an answered pivot."""
    schema = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("low", pa.int64()), ("more", pa.int64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return schema.empty_table()
        known, hot = answers.column("hash").to_numpy(), answers.column("hot").to_numpy(zero_copy_only=False)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        rows = [(i, t) for i, t in zip(docs.column("doc_id").to_pylist(), strings(docs.column("text")), strict=True) if i is not None]
        rows.sort(key=lambda r: r[0])
        ids, whole = [i for i, _ in rows], [t for _, t in rows]
        found: dict[bytes, tuple[int, int]] = {}  # a piece's words say its pivot, so its key too
        greatest: dict[bytes, int] = {}
        for start, _, _, long, texts in _some(windows, ids, whole):
            if texts is None:
                continue
            key, first, last = windows.pivots(texts)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            asked = np.flatnonzero(known[at] == key)
            key, first, last, alone = key[asked], first[asked], last[asked], hot[at[asked]]
            if alone.any():
                w = each(first[alone], last[alone] - first[alone] + 1)
                key, first, last = (np.concatenate([x[~alone], y]) for x, y in ((key, windows.alone(texts)[w]), (first, w), (last, w)))
                order = np.argsort(first, kind="stable")  # texts by ascending id
                key, first, last = key[order], first[order], last[order]
            of = np.array([ids[start + i] for i in long], np.int64)[texts.owner[first]]
            for k, piece, doc in zip(key.tolist(), texts.pieces(first, last + windows.size - 1), of.tolist(), strict=True):
                found.setdefault(piece, (k, doc))
                greatest[piece] = doc
        least = [d for _, d in found.values()]
        return pa.table([pa.array([k for k, _ in found.values()], pa.int64()), pa.array(list(found), pa.binary()), pa.array(least, pa.int64()), pa.array([y - x for x, y in zip(least, greatest.values(), strict=True)], pa.int64())], schema=schema)

    return run


def piece_hash(piece: bytes) -> int:
    return xxhash.xxh64_intdigest(piece, 1) - (1 << 63)


def first_holders(pieces: dict[bytes, int], size: int) -> dict[bytes, list[int]]:
    """For each piece, and each window of it: the least number of a piece that has this window. ``pieces`` has a number for each."""
    if len(pieces) == 1:  # a shard of one piece matches itself all along
        return {p: [d] * (p.count(b" ") + 2 - size) for p, d in pieces.items()}
    automaton, cut = SuffixAutomaton(), {p: p.split(b" ") for p in pieces}
    for p, d in pieces.items():
        automaton.add(cut[p], d)
    automaton.finish()
    return {p: [d for n, d in automaton.statistics(w, size) if n >= size] for p, w in cut.items()}


def _match(windows: Windows):
    """The reference shards, one key after the other: (part, key, hash of the piece, first document of each of its windows)."""
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("piece", pa.int64()), ("first", pa.binary())])

    def shard(key: int, rows: list[tuple]) -> Iterator[tuple]:
        pieces: dict[bytes, int] = {}
        for _, words, low, _ in rows:
            pieces[words] = min(low, pieces.get(words, low))
        first = {p: (min(f), piece_hash(p), array("q", f).tobytes()) for p, f in first_holders(pieces, windows.size).items()}
        for part, words, _, high in rows:
            least, piece, each_first = first[words]
            if least < high:
                yield part, key, piece, each_first

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if rows:
                        out += shard(key, rows)
                    key, rows = k, []
                    if len(out) >= 20_000:
                        yield batch(schema, zip(*out, strict=True))
                        out = []
                rows.append(row)
        if rows:
            out += shard(key, rows)
        if out:
            yield batch(schema, zip(*out, strict=True))

    return run


def covered(n: int, starts: list[int], size: int) -> np.ndarray:
    """Which of n words a window covers."""
    edge = np.zeros(n + 1, np.int32)
    at = np.array(starts, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:n]) > 0


def without(text: str, gone: np.ndarray) -> str:
    """The text without the words marked, and without the spaces that follow them."""
    raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
    starts = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        kept.append(raw[at : starts[a]])
        at = starts[b]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def _remove(windows: Windows, texts_out: bool):
    """Round 3: each document of a group without the windows that an earlier one has."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, answer, firsts = (answers.column(c).to_pylist() for c in ("key", "piece", "first"))
        index = dict(zip(zip(keys, answer, strict=True), range(len(keys)), strict=True))
        keys = np.unique(np.array(keys, np.int64))
        begin = np.cumsum([0, *(len(f) // 8 for f in firsts)])
        flat = np.frombuffer(b"".join(firsts), np.int64)
        held = lambda x: np.flatnonzero(keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x)
        ids, whole = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
        rows: list[list] = [[], [], [], []]
        for start, raws, counts, long, texts in _some(windows, ids, strings(docs.column("text"))):
            removed, left = [0] * len(raws), list(raws)
            if texts is not None and len(keys):
                key, first, last = windows.pivots(texts)
                some = held(key)
                key, first, last = key[some], first[some], last[some]
                if (keys & 1).any():
                    alone = windows.alone(texts)
                    w = held(alone)
                    w = w[texts.owner[w] == texts.owner[w + windows.size - 1]]
                    key, first, last = np.concatenate([key, alone[w]]), np.concatenate([first, w]), np.concatenate([last, w])
                hit = np.array([index.get(k, -1) for k in zip(key.tolist(), map(piece_hash, texts.pieces(first, last + windows.size - 1)), strict=True)], np.int64)
                first, n, hit = first[hit >= 0], (last - first + 1)[hit >= 0], hit[hit >= 0]
                w = each(first, n)
                of = np.array([ids[start + i] for i in long], np.int64)
                mark = np.zeros(len(texts.owner), np.int64)
                mark[w[flat[each(begin[hit], n)] < of[texts.owner[w]]]] = 1
                reach = np.cumsum(mark)
                gone = reach > np.concatenate([np.zeros(windows.size, np.int64), reach[: -windows.size]])
                ends = np.cumsum([counts[i] for i in long])
                for i, e, lost in zip(long, ends.tolist(), np.add.reduceat(gone.astype(np.int64), np.concatenate([[0], ends[:-1]])).tolist(), strict=True):
                    if lost:
                        s = e - counts[i]
                        removed[i] = lost
                        if texts_out:
                            left[i] = without(whole[start + i], gone[s:e])
                        else:
                            edge = s + np.flatnonzero(np.diff(np.concatenate([[1], gone[s:e].astype(np.int8), [1]])))
                            left[i] = b" ".join(texts.pieces(edge[::2], edge[1::2] - 1))
            rows[0] += ids[start : start + len(raws)]
            rows[1] += counts
            rows[2] += removed
            rows[3] += [x if lost else t for x, t, lost in zip(left, whole[start : start + len(raws)], removed, strict=True)] if texts_out else [hashlib.sha256(x).hexdigest() for x in left]
        return pa.table([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "text" if texts_out else "kept_sha256"])

    return run


def _rounds(docs: DataFrame, size: int, id_col: str, text_col: str, texts: bool) -> DataFrame:
    windows = Windows(size)
    tasks = text_partitions(docs)
    group = lambda hashed: F.pmod(hashed, F.lit(2 * tasks)).cast("int").alias("part")
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(group(own), "doc_id", "text").repartition(tasks, "part")
    asked = rows.mapInArrow(_ask(windows), "hash long, low long, more long, n long")
    same = Window.partitionBy("hash")  # a row for each group of documents at most
    answered = asked.select("hash", F.col("low").alias("own"), F.min("low").over(same).alias("low"), F.max(F.col("low") + F.col("more")).over(same).alias("high"), F.sum("n").over(same).alias("n"))
    answered = answered.filter("low < high").select(group(F.xxhash64("own")), "hash", (F.col("n") > HOT).alias("hot"))
    sent = rows.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(_send(windows), "key long, words binary, low long, more long")
    met = sent.repartition(F.col("key")).sortWithinPartitions("key").select("key", group(F.xxhash64("low")), "words", "low", (F.col("low") + F.col("more")).alias("high"))
    matched = met.mapInArrow(_match(windows), "part int, key long, piece long, first binary")
    return rows.groupBy("part").cogroup(matched.groupBy("part")).applyInArrow(_remove(windows, texts), f"doc_id long, n_words long, n_removed long, {'text' if texts else 'kept_sha256'} string")


def repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes from every text the words of windows of ``size`` words that also start in a document of smaller id.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` (of the kept words, joined by one space), one row for each row of
    ``docs``. Windows are judged on the input. A null text has no words. A row with a null id has no place in the order: it
    loses nothing and takes nothing from others. Rows of one id don't take from one another. Very long texts are read whole.
    An empty table gives no row; other columns are not read, whatever their names.
    """
    return _rounds(docs, size, id_col, text_col, False)


def remove_repeats(docs: DataFrame, size: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns and texts without repeated passages of ``size`` words; ``n_chars``, if there, counts the new text.

    A document of which nothing is left but had words goes. Ids must be distinct where they aren't null; a row with a null
    id, or a null or empty text, stays as it is. Very long texts are read whole; an empty table gives no row; names of other
    columns may be any.
    """
    long = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there is
    key, text, gone = f"id{long}", f"text{long}", f"gone{long}"
    new = _rounds(docs.filter(F.col(id_col).isNotNull()), size, id_col, text_col, True).filter("n_removed > 0")
    new = new.select(F.col("doc_id").alias(key), F.col("text").alias(text), (F.col("n_removed") == F.col("n_words")).alias(gone))
    out = docs.join(new, F.col(id_col) == F.col(key), "left").filter(~F.coalesce(F.col(gone), F.lit(False)))
    changed = {text_col: F.when(F.col(key).isNotNull(), F.col(text)).otherwise(F.col(text_col))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(key).isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


def remove_reference(docs: DataFrame, reference: DataFrame, size: int = 13, most_words: int = 1_000_000, shard_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """Removes from every text the words of windows of ``size`` words that a bounded reference has.

    The automata of the reference's shards are broadcast; ``most_words`` bounds them, and a larger reference is refused.
    Returns ``doc_id, n_words, n_removed, text``, one row for each row of ``docs``; a null text stays null.
    """
    count = F.coalesce(F.sum(F.length(reference_col)), F.lit(0))
    if reference.agg(count).first()[0] > 20 * most_words:
        raise ValueError(f"the reference has more than {most_words} words; use repeats() over both")
    shards, room = [], 0
    for r in reference.select(F.col(reference_col).alias("text")).collect():
        words = split(r["text"] or "")
        if len(words) >= size:
            if room < len(words):
                shards.append(SuffixAutomaton())
                room = shard_words
            shards[-1].add(words, 0)
            room -= len(words)
    automata = docs.sparkSession.sparkContext.broadcast(shards)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = split(text or "")
                starts = [i - size + 1 for a in automata.value for i, (n, _) in enumerate(a.statistics(words, size)) if n >= size]
                gone = covered(len(words), starts, size)
                rows.append((doc, len(words), int(gone.sum()), without(text, gone) if gone.any() else text))
            if rows:
                yield batch(schema, zip(*rows, strict=True))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
