"""The audit of filters against its definition, row by row."""

from __future__ import annotations

import itertools
import re

import pytest
from test_llm import SCHEMA, docs, empty, rows  # noqa: F401

from gridmill.llm import audit


def wanted(rows, labels):
    texts = [(i, t or "", p or "") for i, t, p in rows]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, bad = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    failed = []
    for i, t, p in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        letters = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": t in least and (i is None or i > least[t])}
        failed.append((p, {k for k, v in letters.items() if v}, i in good, i in bad))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [x[1:] for x in failed if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            kept = own
            for k, f in enumerate(order):
                here = [x for x in kept if f in x[0]]
                shapley[f] += len(here)
                early = sum(f in x[0] for x in own) - len(here)
                kept = [x for x in kept if f not in x[0]]
                out[part, order, k + 1] = [len(kept), len(here), early, sum(x[0] == {f} for x in own), sum(x[1] for x in here), sum(x[2] for x in here)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[x] for x in "kept removed redundant unique_fails good_lost toxic_lost shapley".split()) for r in df.collect()}


LABELS = [(0, 1, 0), (3, 0, 1), (3, 1, 1), (6, None, 1), (93, 1, 0), (None, 1, 1), (500_000, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("bits", [64, 1])
def test_audit(spark, docs, rows, labels, bits):  # noqa: F811
    """With class hashes of one bit texts of one length share classes, and only whole texts tell them apart."""
    assert found(audit.audit(docs, labels, bits=bits)) == wanted([(r[0], r[1], r[2]) for r in rows], LABELS)


def test_audit_of_equal_rows(spark, labels):
    """Rows of one id and text, a text with null ids only, long texts that differ in their last letter only, copies in several parts."""
    long = "AB c# " * 60_000
    rows = [(5, "x", "a"), (5, "x", "a"), (9, "x", "b"), (None, "only", "a"), (None, "only", "a"), (None, "x", None), (1, long + "a", "a"), (2, long + "b", "a"), (3, long + "a", ""), (3, long + "a", None), (0, "y", "b")]
    df = spark.createDataFrame([(i, t, p, "s", None, "", "", "", "") for i, t, p in rows], SCHEMA)
    assert found(audit.audit(df, labels)) == wanted(rows, LABELS)
    assert sorted(map(tuple, audit.exact_copies(df).collect()), key=str) == sorted([(9, 5), (None, 5), (3, 1), (3, 1)], key=str)
    assert sorted(map(tuple, audit.exact_copies(df, bits=1).collect()), key=str) == sorted([(9, 5), (None, 5), (3, 1), (3, 1)], key=str)


def test_audit_of_nothing(empty, labels):  # noqa: F811
    assert audit.audit(empty, labels).count() == 0
    assert audit.exact_copies(empty).count() == 0


def test_audit_without_labels(spark, docs, rows):  # noqa: F811
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(audit.audit(docs, none)) == wanted([(r[0], r[1], r[2]) for r in rows], [])
