"""Byte-level BPE: encoding and decoding of whole texts.

Each piece that the pattern cuts is merged by a segment tree over its byte positions. A leaf holds the rank of the pair
that starts there and its position; a node holds the least of its children, so the root is the leftmost pair of least
rank. A merge changes three leaves (the pair, its right part, the live neighbour to the left) and the path above each.
Short pieces are merged many at a time, one tree to a row of an array; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridmill.llm.common import batch, small_runs, strings

NONE = np.iinfo(np.int64).max
#: A leaf is rank << SHIFT | position.
SHIFT = 32
#: Characters that a worker remembers, of pieces and words and of their ids together; and of the longest piece that is remembered.
MOST_HELD, LONGEST_HELD = 64_000_000, 64
#: In texts of these characters only, ``re`` classes and Unicode properties agree, and the only spaces are " " and "\n".
OTHER = re.compile("[^\n -~À-ÖØ-öø-ɏ]")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def plain(text: str) -> bool:
    """Whether cutting at single spaces is the same as the pattern's own cuts: a space stands between words, or with no other space."""
    return bool(text) and not ("  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or OTHER.search(text))


class ByteBPE:
    """Ranks of a tiktoken file, with the pattern that cuts a text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {str(i): b for b, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        first = self.byte_id[:, None] << 20 | self.byte_id[None, :]
        self.first = self._ranks_of(first.ravel()).reshape(256, 256)
        self.pieces: dict[str, str] = {}
        self.heads: dict[str, str] = {}
        self.tails: dict[str, str] = {}
        self.held, self.long = 0, []

    # -- merging ------------------------------------------------------------

    def _ranks_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.values[at], NONE >> SHIFT)

    def _merge_rows(self, words: list[bytes], width: int) -> list[str]:
        """Ids of words of 2 to ``width`` bytes, a tree to a row."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(width, dtype=np.int64)
        ids = self.byte_id[raw]
        ids[place[None, :] >= length[:, None]] = -1
        after = np.where(place + 1 < length[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.first[raw[:, :-1], raw[:, 1:]]
        rank[place[None, 1:] >= length[:, None]] = NONE >> SHIFT
        tree[:, width : 2 * width - 1] = np.where(rank < NONE >> SHIFT, rank << SHIFT | place[:-1], NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            left = root & ((1 << SHIFT) - 1)
            right = after[rows, left]
            beyond = after[rows, right]
            ids[rows, left], ids[rows, right] = root >> SHIFT, -1
            after[rows, left] = beyond
            inside = beyond < width
            before[rows[inside], beyond[inside]] = left[inside]
            prior = before[rows, left]
            leaves = np.stack([left, right, np.maximum(prior, 0)])
            new = np.full(leaves.shape, NONE, np.int64)
            for k, (a, b, some) in enumerate(((left, beyond, inside), (None, None, None), (prior, left, prior >= 0))):
                if a is not None and some.any():
                    r = rows[some]
                    rank = self._ranks_of(ids[r, a[some]] << 20 | ids[r, b[some]])
                    new[k, some] = np.where(rank < NONE >> SHIFT, rank << SHIFT | a[some], NONE)
            new[2] = np.where(prior >= 0, new[2], new[0])
            leaves[2] = np.where(prior >= 0, leaves[2], left)
            for k in (1, 0, 2):
                tree[rows, leaves[k] + width] = new[k]
            nodes = (leaves + width) >> 1
            while nodes[0, 0]:
                for k in range(3):
                    tree[rows, nodes[k]] = np.minimum(tree[rows, 2 * nodes[k]], tree[rows, 2 * nodes[k] + 1])
                nodes >>= 1
            rows = rows[tree[rows, 1] < NONE]
        alive = ids >= 0
        shown = list(map(str, ids[alive].tolist()))
        ends = alive.sum(axis=1).cumsum().tolist()
        return [" ".join(shown[a:b]) for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _merge_long(self, word: bytes) -> str:
        """Ids of one word, with a tree of its own."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        pairs, ids = self.pairs, self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = NONE
        tree = [none] * (2 * width)

        def leaf(a: int) -> int:
            b = after[a]
            rank = pairs.get(ids[a] << 20 | ids[b]) if b < n else None
            return none if rank is None else rank << SHIFT | a

        for a in range(n):
            tree[width + a] = leaf(a)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, left = tree[1] >> SHIFT, tree[1] & ((1 << SHIFT) - 1)
            right = after[left]
            beyond = after[right]
            ids[left], ids[right], after[left] = rank, -1, beyond
            if beyond < n:
                before[beyond] = left
            tree[width + right] = none
            changed = [right, left]
            tree[width + left] = leaf(left)
            if before[left] >= 0:
                changed.append(before[left])
                tree[width + before[left]] = leaf(before[left])
            for at in changed:
                node = (width + at) >> 1
                while node:
                    least = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == least:
                        break
                    tree[node] = least
                    node >>= 1
        return " ".join(str(i) for i in ids if i >= 0)

    def merged(self, words: list[bytes]) -> list[str]:
        """Ids of each word, in decimal, joined by one space."""
        out: list[str] = [""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) < 2:
                out[i] = str(int(self.byte_id[w[0]])) if w else ""
            elif len(w) > 64:
                out[i] = self._merge_long(w)
            else:
                by_width.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, at in by_width.items():
            step = 200_000 // width
            for k in range(0, len(at), step):
                part = at[k : k + step]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    # -- texts --------------------------------------------------------------

    def _add(self, cache: dict[str, str], new: Iterable[tuple[str, str]]) -> None:
        for text, ids in new:
            cache[text] = ids
            self.held += len(text) + len(ids)
            if len(text) > LONGEST_HELD:
                self.long.append((cache, text))

    def _forget(self) -> None:
        """Long pieces, which seldom come again; and all, once they are too many."""
        for cache, text in self.long:
            self.held -= len(text) + len(cache.pop(text))
        self.long.clear()
        if self.held > MOST_HELD:
            self.pieces, self.heads, self.tails, self.held = {}, {}, {}, 0

    def _know(self, pieces: set[str]) -> None:
        new = list(pieces - self.pieces.keys())
        self._add(self.pieces, zip(new, self.merged([p.encode() for p in new]), strict=True))

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text, in decimal, joined by one space. Empty for an empty text."""
        out: list[str] = [""] * len(texts)
        for start, end in small_runs(texts):
            cut, odd = {}, {}
            for i in range(start, end):
                if plain(texts[i]):
                    cut[i] = texts[i].split(" ")
                elif texts[i]:
                    odd[i] = self.pattern.findall(texts[i])
            heads = {c[0]: PIECE.findall(c[0]) for c in cut.values() if c[0] not in self.heads}
            tails = {x: PIECE.findall(" " + x) for x in set().union(*cut.values()) - self.tails.keys()}
            self._know(set().union(*heads.values(), *tails.values(), *odd.values()))
            known = self.pieces.__getitem__
            self._add(self.heads, ((x, " ".join(map(known, p))) for x, p in heads.items()))
            self._add(self.tails, ((x, " ".join(map(known, p))) for x, p in tails.items()))
            tail = self.tails.__getitem__
            for i, p in odd.items():
                out[i] = " ".join(map(known, p))
            for i, c in cut.items():
                c_ids = list(map(tail, c))
                c_ids[0] = self.heads[c[0]]
                out[i] = " ".join(c_ids)
            self._forget()
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


@functools.lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteBPE:
    """One for all tasks of a worker, with the pieces that it remembers."""
    return ByteBPE(path, pattern)


def byte_bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row for each row of ``docs``. A null text counts as
    empty: no tokens, and the digests of nothing. Null ids, repeated rows and very long texts are rows like any other;
    an empty table gives none. Other columns are not read. Rows stay where they are read: there is no exchange. A worker
    remembers short pieces it has met, ``MOST_HELD`` characters of them, then starts anew.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            texts = strings(b.column(1))
            n, coded, decoded = [], [], []
            for start, end in small_runs(texts):
                for ids in bpe.encode(texts[start:end]):
                    n.append(ids.count(" ") + 1 if ids else 0)
                    coded.append(sha(ids.encode()))
                    decoded.append(sha(bpe.decode(ids)))
            yield batch(schema, [b.column(0), n, coded, decoded])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
