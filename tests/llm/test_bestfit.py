"""Best-fit decreasing against a plain queue, and the packing against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from test_llm import RANKS, SCHEMA, docs, empty, rows  # noqa: F401

from gridmill.llm import bestfit
from gridmill.llm.queries import ADDED


def plain_best_fit(lengths, longest):
    """Sequences of best-fit decreasing, one piece after the other."""
    capacities = []
    for x in sorted(lengths, reverse=True):
        k = min((k for k, c in enumerate(capacities) if c >= x), key=capacities.__getitem__, default=None)
        if k is None:
            k = len(capacities)
            capacities.append(longest)
        capacities[k] -= x
    return sorted(capacities)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    longest = rnd.choice([1, 2, 7, 32, 33, 100])
    lengths = [rnd.choice([rnd.randint(1, longest), rnd.randint(1, max(1, longest // 4)), 1 + longest // 3]) for _ in range(rnd.randint(0, 300))]
    lengths = [min(x, longest) for x in lengths]
    found, used, ranks = bestfit.plan(Counter(lengths), longest), defaultdict(list), defaultdict(list)
    for p in found:
        ranks[p.length].append((p.rank, p.count))
        for k in range(p.count):
            used[p.sequence + k // p.each].append((p.offset + k % p.each * p.length, p.length))
    for x, n in Counter(lengths).items():
        assert sum(c for _, c in ranks[x]) == n and sorted(ranks[x]) == ranks[x]
    for held in used.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= longest
    assert sorted(longest - sum(n for _, n in held) for held in used.values()) == plain_best_fit(lengths, longest)
    assert sorted(used) == list(range(len(used)))


def test_plan_of_very_many():
    """A billion pieces of each length make a plan of few rows."""
    found = bestfit.plan({x: 10**9 + x for x in range(1, 2049)}, 2048)
    assert len(found) < 20_000
    tokens = sum((10**9 + x) * x for x in range(1, 2049))
    assert max(p.sequence + -(-p.count // p.each) for p in found) * 2048 < tokens * 1.001


def test_tightest():
    rnd, tree, have = random.Random(1), bestfit.Capacities(37), Counter()
    for _ in range(2000):
        c = rnd.randint(0, 37)
        by = -1 if have[c] and rnd.random() < 0.6 else 1
        tree.add(c, by)
        have[c] += by
        ask = rnd.randint(1, 37)
        assert tree.tightest(ask) == min((c for c, n in have.items() if n and c >= ask), default=None)


@pytest.mark.parametrize("longest", [2048, 16])
def test_pack(docs, rows, longest):  # noqa: F811
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    lengths = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (start, length) in enumerate(bestfit.cut(len(ids), longest)):
            want[i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
            lengths.append(length)
    found = bestfit.pack(docs, RANKS, public_tokenizers.PATTERN, longest=longest, special=ADDED).collect()
    assert Counter(tuple(r)[:5] for r in found) == want
    used = defaultdict(list)
    for r in found:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in used.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
    assert sorted(longest - sum(n for _, n in held) for held in used.values()) == plain_best_fit(lengths, longest)


def test_cut():
    assert list(bestfit.cut(5, 8)) == [(0, 5)]
    assert list(bestfit.cut(16, 8)) == [(0, 8), (8, 8)]
    assert list(bestfit.cut(19, 8)) == [(0, 3), (3, 8), (11, 8)]


def test_nothing(empty):  # noqa: F811
    assert bestfit.pack(empty, RANKS, public_tokenizers.PATTERN).count() == 0
