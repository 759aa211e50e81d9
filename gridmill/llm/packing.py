"""Hierarchical packing of token sequences into windows of several lengths.

The tiers are windows of ``longest`` tokens, of half of it, and so on. The rows of a partition are packed as they stream by.
Whole windows of the longest tier are cut off a document first; what is left of it goes to the tier of the least window
that holds it, and waits there in a bounded pool. When the pools are full, the tier that has most windows waiting packs one of
its own length: its longest piece first, and the gap that stays is filled from the shorter tiers, the best fit first, or by
cutting a piece. At the end of a partition the last pieces are cut into windows that are powers of two, so that none is
padded. Finished windows of one length are dealt into step groups of equal tokens and nearly equal attention cost.
"""

from __future__ import annotations

import base64
import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridmill.llm.bpe import ByteBPE
from gridmill.llm.common import batch, strings

#: Pieces that wait in all tiers of a partition, at most.
MOST_WAITING = 2_000
#: Step groups that are filled side by side.
GROUPS = 4
ID_BITS = 32
#: The library's matcher goes one call deeper for each space of a run, and has no room for a million.
LONG_RUN = re.compile(r"\s{10000}")


def added_tokens(path: str) -> dict[str, int]:
    """The tokens of a tokenizer file that stand outside its merges, as text found anywhere, with their ids."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("an added token that is not found by its text alone")
    return {t["content"]: t["id"] for t in found}


class TokenBytes:
    """Ids of texts as little-endian unsigned 32-bit integers, by the ranks of a tiktoken file; ``special`` texts are cut out first and have ids of their own."""

    def __init__(self, path: str, pattern: str, special: dict[str, int] | None = None):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special or {}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.path, self.pattern, self.own = path, pattern, None

    def _ids(self, text: str) -> list[int]:
        if not LONG_RUN.search(text):
            return self.encoding.encode_ordinary(text)
        self.own = self.own or ByteBPE(self.path, self.pattern)
        return list(map(int, self.own.encode([text])[0].split()))

    def of(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return np.array(self._ids(text), "<u4").tobytes()
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids += [*self._ids(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return np.array(ids + self._ids(text[at:]), "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def _coder(path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> TokenBytes:
    return TokenBytes(path, pattern, dict(special))


def coder(path: str, pattern: str, special: dict[str, int] | None = None) -> TokenBytes:
    """A process's coder: the ranks are read once, not in each task."""
    return _coder(path, pattern, tuple(sorted((special or {}).items())))


class Packer:
    """Packs pieces ``(key, start, length)``; yields windows as their length and a list of ``(key, start, length)`` that fills it."""

    def __init__(self, longest: int, tiers: int = 4):
        if longest < 1 or longest & (longest - 1):
            raise ValueError("the longest window must be a power of two")
        #: Window lengths, the shortest first; for each a sorted list of (length, key, start) of what waits, and its tokens.
        self.windows = [longest >> k for k in range(min(tiers, longest.bit_length()))][::-1]
        self.tiers: list[list[tuple[int, int, int]]] = [[] for _ in self.windows]
        self.tokens = [0] * len(self.windows)
        self.waiting = 0

    def _wait(self, key: int, start: int, length: int) -> None:
        tier = bisect.bisect_left(self.windows, length)
        bisect.insort(self.tiers[tier], (length, key, start))
        self.tokens[tier] += length
        self.waiting += 1

    def _pop(self, tier: int, at: int) -> tuple[int, int, int]:
        piece = self.tiers[tier].pop(at)
        self.tokens[tier] -= piece[0]
        self.waiting -= 1
        return piece

    def add(self, key: int, length: int) -> Iterator[tuple[int, list]]:
        start, longest = 0, self.windows[-1]
        while length - start >= longest:
            yield longest, [(key, start, longest)]
            start += longest
        if start < length:
            self._wait(key, start, length - start)
        while self.waiting > MOST_WAITING:
            yield self._window()

    def _take(self, gap: int, upto: int) -> tuple[int, int, int]:
        """The longest piece of at most ``gap`` in the tiers up to ``upto``; else the shortest piece's beginning."""
        for tier in range(upto, -1, -1):
            at = bisect.bisect_right(self.tiers[tier], (gap, 1 << 70, 0))
            if at:
                return self._pop(tier, at - 1)
        tier = next(t for t in range(upto + 1) if self.tiers[t])
        length, key, start = self._pop(tier, 0)
        self._wait(key, start + gap, length - gap)
        return gap, key, start

    def _window(self) -> tuple[int, list]:
        """A window of the tier that has most of its windows waiting; of a shorter power of two if no tier and those below it can fill theirs."""
        below = np.cumsum(self.tokens)
        full = [t for t in range(len(self.windows)) if below[t] >= self.windows[t]]
        tier = max(full, key=lambda t: (self.tokens[t] / self.windows[t], t)) if full else len(self.windows) - 1
        window = self.windows[tier] if full else 1 << (int(below[-1]).bit_length() - 1)
        held, filled = [], 0
        while filled < window:
            length, key, start = self._take(window - filled, tier)
            held.append((key, start, length))
            filled += length
        return window, held

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.waiting:
            yield self._window()


class Steps:
    """Deals windows of one length into groups of ``step_tokens`` tokens, ``GROUPS`` at a time, the dearest window to the cheapest group. Attention costs the square of each piece."""

    def __init__(self, step_tokens: int):
        self.step_tokens, self.held, self.next = step_tokens, {}, {}

    def add(self, window: int, held: list) -> Iterator[tuple[int, int, list]]:
        some = self.held.setdefault(window, [])
        some.append(held)
        if len(some) >= GROUPS * max(1, self.step_tokens // window):
            yield from self._deal(window)

    def _deal(self, window: int) -> Iterator[tuple[int, int, list]]:
        some = self.held.pop(window, [])
        count = -(-len(some) // max(1, self.step_tokens // window))
        room, cost = [len(some) // count + (g < len(some) % count) for g in range(count)], [0] * count
        first = self.next.get(window, 0)
        self.next[window] = first + count
        price = lambda held: sum(n * n for _, _, n in held)
        for held in sorted(some, key=price, reverse=True):
            g = min((g for g in range(count) if room[g]), key=cost.__getitem__)
            room[g] -= 1
            cost[g] += price(held)
            yield first + g, window, held

    def rest(self) -> Iterator[tuple[int, int, list]]:
        for window in sorted(self.held):
            yield from self._deal(window)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0, longest: int = 1024, tiers: int = 4, step_tokens: int = 65_536, special: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Packs every text into windows of ``tiers`` lengths from ``longest`` tokens down by halves, without padding.

    A text is its ids by the ranks, then ``end_id``; where a text of ``special`` stands in it, that has its own id, as in the
    tokenizers library. A null text is empty and gives ``end_id`` alone. Returns one row for each piece: ``doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group`` (and ``ids`` if asked for). ``window`` is the
    length of the piece's sequence, a power of two, which the sequence fills; only what is left at the end of a partition
    comes in windows shorter than the shortest tier's. ``step_group`` numbers groups of windows of one length: a group holds
    ``step_tokens`` tokens, but for a partition's last ones, which are as even as can be. Rows are packed where they are
    read, without an exchange, and numbers have the partition in their upper bits, so a task that runs again gives the same
    rows. Repeated rows and repeated or null ids are packed each by itself; a very long text is cut into whole windows as it
    comes, whatever runs of spaces it has; an empty table gives no row; other columns are not read, whatever their names.
    A partition keeps at most ``MOST_WAITING`` pieces waiting, and ``GROUPS`` step groups of each window length.
    """
    fields = PIECES + (", ids array<int>" if ids else "")
    types = [pa.int64()] * 9 + [pa.list_(pa.int32())] * ids
    schema = pa.schema(list(zip([f.split()[0] for f in fields.split(", ")], types, strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded_by, packer, steps, base = coder(ranks_path, pattern, special), Packer(longest, tiers), Steps(step_tokens), TaskContext.get().partitionId() << ID_BITS
        end = np.array([end_id], "<u4").tobytes()
        rest: dict[int, tuple[int | None, int, bytes]] = {}  # the ids of a document from the last multiple of the longest on, while pieces of it wait
        rows: list[tuple] = []
        sequence = 0

        def put(found: Iterable[tuple[int, list]], key: int = -1, doc=None, coded: bytes = b"") -> Iterator[tuple[int, int, list]]:
            """Windows with what their rows need of the ids, so that nothing else is held while a step group fills."""
            for window, held in found:
                pieces = []
                for k, start, length in held:
                    d, total, whole = (doc, len(coded) // 4, coded) if k == key else rest[k]
                    at = total - len(whole) // 4
                    part = whole[4 * (start - at) : 4 * (start - at + length)]
                    pieces.append((d, start, length, zlib.crc32(part), total, part if ids else b""))
                yield from steps.add(window, [(p, 0, p[2]) for p in pieces])

        def write(dealt: Iterable[tuple[int, int, list]]) -> None:
            nonlocal sequence
            for group, window, held in dealt:
                offset = 0
                for (d, start, length, crc, total, part), _, _ in held:
                    rows.append((d, start, length, crc, total, base | sequence, offset, window, base | group << 6 | window.bit_length()) + ((np.frombuffer(part, "<u4").astype(np.int32).tolist(),) if ids else ()))
                    offset += length
                sequence += 1

        key = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                coded = coded_by.of(text) + end
                n = len(coded) // 4
                tail = coded[4 * (n - n % longest) :]
                if tail:
                    rest[key] = (doc, n, tail)
                write(put(packer.add(key, n), key, doc, coded))
                key += 1
                if len(rest) > 4 * MOST_WAITING:
                    held = {x[1] for tier in packer.tiers for x in tier}
                    rest = {k: v for k, v in rest.items() if k in held}
                if len(rows) >= 10_000:
                    yield batch(schema, zip(*rows, strict=True))
                    rows.clear()
        write(put(packer.rest()))
        write(steps.rest())
        for k in range(0, len(rows), 10_000):
            yield batch(schema, zip(*rows[k : k + 10_000], strict=True))

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, fields)
