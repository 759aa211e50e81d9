"""Which terms the factorization machine uses: pairs that tell, of whatever frequency."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from gridmill.llm import toxicity


def exactly_one(others: int, share: float, texts: int = 3000, seed: int = 1):
    """Texts whose label is whether exactly one of two terms is there; ``others`` terms are more frequent than these two."""
    rng = np.random.default_rng(seed)
    slots = rng.choice(1 << toxicity.BITS, others + 2, replace=False)
    a, b = slots[-2:].tolist()
    held, y = [], []
    for _ in range(texts):
        some = slots[:-2][rng.random(others) < share].tolist()
        one, two = rng.random() < 0.12, rng.random() < 0.12
        if rng.random() < 0.04:
            one = two = True
        held.append(np.unique(some + [a] * one + [b] * two).astype(np.int64))
        y.append(int(one != two) if one or two else int(rng.random() < 0.5))
    return held, y, a, b


@pytest.mark.parametrize(("others", "share"), [(1500, 0.2), (6000, 0.2)])
def test_pairs_below_many_frequent_terms(others, share):
    held, y, a, b = exactly_one(others, share)
    assert sorted(np.bincount(np.concatenate(held))[[a, b]])[1] < np.median(np.bincount(np.concatenate(held))[np.unique(np.concatenate(held))])
    m = toxicity.fit(held, y)
    say = lambda *slots: float(toxicity.sigmoid(m.raw([m.used(np.array(sorted(slots), np.int64))]))[0])
    assert min(say(a), say(b)) > 0.8 and say(a, b) < 0.1


def test_sums_of_all_pairs(monkeypatch):
    """Both ways give the sums over the texts that have both, cut into blocks or not."""
    rng = np.random.default_rng(4)
    for cells, events, block in ((4_000_000, 4_000_000, 1024), (60, 17, 7)):
        monkeypatch.setattr(toxicity, "CELLS", cells)
        monkeypatch.setattr(toxicity, "EVENTS", events)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        held = [np.sort(rng.choice(25, rng.integers(0, 12), replace=False)) for _ in range(80)]
        missed, unsure = rng.normal(size=80), rng.random(80)
        want, spread = np.zeros((25, 25)), np.zeros((25, 25))
        for h, m, u in zip(held, missed, unsure, strict=True):
            for i, j in itertools.combinations(h.tolist(), 2):
                want[i, j] += m
                spread[i, j] += u
        n = np.array(list(map(len, held)))
        for way in (toxicity._sparse_sums, toxicity._dense_sums):
            got, wide = np.zeros((25, 25)), np.zeros((25, 25))
            for rows, columns, a, b in way(np.concatenate(held), np.repeat(np.arange(80), n), np.cumsum(n), missed, unsure, 25):
                got[rows, columns] += a
                wide[rows, columns] += b
            upper = np.triu(np.ones((25, 25), bool), 1)
            assert np.allclose(got[upper], want[upper], atol=1e-4) and np.allclose(wide[upper], spread[upper], atol=1e-4)


def test_which_slots_are_kept():
    """Against all pairs counted one by one."""
    rng = np.random.default_rng(8)
    slots = np.sort(rng.choice(1 << toxicity.BITS, 60, replace=False))
    held = [np.sort(rng.choice(slots, rng.integers(2, 20), replace=False)) for _ in range(500)]
    missed = np.array([(0.7 if {slots[3], slots[9]} <= set(h.tolist()) else -0.7 if {slots[20], slots[21]} <= set(h.tolist()) else rng.normal() * 0.2) for h in held])
    unsure = np.full(500, 0.05)
    total, spread = np.zeros((60, 60)), np.zeros((60, 60))
    for h, m in zip(held, missed, strict=True):
        at = np.searchsorted(slots, h)
        for i, j in itertools.permutations(at.tolist(), 2):
            total[i, j] += m
            spread[i, j] += 0.05
    hit = total**2 >= 40 * np.maximum(spread, 1)
    want = slots[hit.any(axis=1)]
    assert {slots[3], slots[9], slots[20], slots[21]} <= set(want.tolist())
    assert toxicity.telling_pairs(held, missed, unsure, slots, 40.0).tolist() == want.tolist()
    assert toxicity.telling_pairs(held, missed * 0, unsure, slots, 40.0).size == 0
