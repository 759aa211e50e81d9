"""Spelling variants against a comparison of all words with each other."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from test_llm import SCHEMA, docs, empty, rows  # noqa: F401

from gridmill.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def wanted(rows, length=6, least=5, ratio=5, every=199):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= length and n >= least}
    forms, nears = {}, {}
    for w in words:
        others = [x for x in words if near(w, x)]
        nears[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, nears[w], words.get(forms[w])))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "", "", "", "") for i, t in rows], SCHEMA)


def test_rows(docs, rows):  # noqa: F811
    assert found(spelling.variants(docs, 2, 1, 2, every=7)) == wanted([r[:2] for r in rows], 2, 1, 2, 7)
    assert found(spelling.variants(docs, every=199)) == wanted([r[:2] for r in rows])


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "aeéÉÿÀ×"])
def test_random_words(spark, letters):
    """Few letters: most words have the same keys as others, double letters, and very many neighbours."""
    rnd = random.Random(len(letters))
    words = ["".join(rnd.choices(letters, k=rnd.randint(5, 8))) for _ in range(150)]
    words += [w[:k] + rnd.choice(letters) + w[k + (j % 2) :] for j, w in enumerate(words) for k in [rnd.randint(0, len(w) - 1)]]
    rows = [(i, "1".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=400))) for i in range(20)]
    want = wanted(rows, 6, 2, 2, 13)
    assert found(spelling.variants(table(spark, rows), 6, 2, 2, every=13)) == want
    assert len(want) > 20


def test_chain_of_forms(spark):
    """Each form is five times its word: roots stand several steps away."""
    chain = [("abcdef"[: 6 - k] + "z" * k, 5 ** (5 - k)) for k in range(6)]
    rows = [(1, " ".join(" ".join([w] * n) for w, n in chain)), (None, "ABCDEF Éabcdef"), (2, None), (3, "")]
    want = wanted(rows, 6, 1, 5, None)
    assert any(form is not None and form != root for _, form, root, *_ in want)
    assert found(spelling.variants(table(spark, rows), 6, 1, 5)) == want


def test_long_word_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(spelling, "AT_ONCE", 10)
    assert "".join(spelling.stretches("ab cdefghijklmnop qr stu" * 3)) == "ab cdefghijklmnop qr stu" * 3
    assert all(len(x) < 30 for x in spelling.stretches("ab cdefghijklmnop qr stu" * 3))
    word = "abcdefghij" * 5_000
    rows = [(k, " ".join([word] * 5 + [word[:777] + "x" + word[778:]] + ["x" + word])) for k in range(5)]
    got = {len(r["word"]): (r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(table(spark, rows)).filter("n > 5").collect()}
    assert got == {len(word): (25, 2, None)}


def test_nothing(empty):  # noqa: F811
    assert spelling.variants(empty).count() == 0


def test_orders_tell_places_apart():
    """What is left of two words is one order where they are one letter apart at that place."""
    rnd = random.Random(3)
    for _ in range(300):
        a = "".join(rnd.choices("abc", k=rnd.randint(2, 9)))
        every = set(map(ord, "abc"))
        rows = list(spelling.orders(a, every, every, True))
        assert {(rest, order) for kind, rest, _, order in rows if kind == spelling.WITHOUT} == {list(spelling.orders(a[:k] + a[k + 1 :], set(), set(), True))[0][1::2] for k in range(len(a))} or len(a) == 1
