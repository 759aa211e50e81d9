"""Tables by the hash of their key, and the trigram index over stored texts."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridmill.operators import store as S
from gridmill.operators import textindex as X
from gridmill.operators.hashed import PART, HashedTable

ROWS = [(k, f"c{k}", k * 10) for k in range(400)]


def files(table):
    return {p: p.stat().st_mtime_ns for p in Path(table.path.removeprefix("file:")).rglob("*.parquet")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def stored(spark, tmp_path):
    df = spark.createDataFrame([*ROWS, (None, "no key", 0)], "key long, content string, created long")
    return HashedTable.create(df, f"{tmp_path}/t", ["key"], buckets=16)


def test_a_bucket_is_a_folder_with_its_own_hash(stored):
    """The folder's number is that of the bucket in the file's name, so Spark may join by the layout."""
    names = [p.as_posix() for p in files(stored)]
    assert len(names) == 16
    assert all(int(x.split(f"{PART}=")[1].split("/")[0]) == int(x.split("_")[-1].split(".")[0]) for x in names)
    assert rows_of(stored.read()) == ROWS


def test_upsert_rewrites_touched_buckets_only(spark, stored):
    new = spark.createDataFrame([(3, "older", -1, 1), (3, "new", -1, 2), (1000, "added", 7, 0), (None, "lost", 1, 1)], "key long, content string, created long, at int")
    touched = stored.buckets_of(new)
    assert 1 <= len(touched) <= 2
    plan = plan_of(stored.merged(new, ["content"], [F.col("at")]))
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "Bucketed: true" in scan and "PartitionFilters: [bucket" in scan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("FileScan")  # of the changes; the stored side comes first
    before = files(stored)
    stored.upsert(new, ["content"], [F.col("at")])
    want = sorted([*(x for x in ROWS if x[0] != 3), (3, "new", 30), (1000, "added", 7)])
    assert rows_of(stored.read()) == want
    after = files(stored)
    same = {p for p in before if after.get(p) == before[p]}
    assert {int(p.parent.name.split("=")[1]) for p in same} == set(range(16)) - set(touched)
    stored.upsert(new, ["content"], [F.col("at")])
    assert rows_of(stored.read()) == want


def test_update_and_insert(spark, stored):
    stored.update(spark.createDataFrame([(5, "five"), (5, "fifth"), (5000, "nothing")], "key long, content string"))
    assert [r["content"] for r in stored.read().filter("key >= 5 and key < 6 or key > 900").collect()] == ["five"]  # of equal rank the greatest
    before = files(stored)
    stored.insert(spark.createDataFrame([(5, "ignored", 1), (700, "a", 1), (700, "b", 0)], "key long, content string, created long"))
    assert before.items() <= files(stored).items()
    assert rows_of(stored.read().filter("key in (5, 700)")) == [(5, "five", 50), (700, "b", 0)]
    stored.upsert(spark.createDataFrame([(700, "c", 9)], "key long, content string, created long"), ["content", "created"])
    assert rows_of(stored.read().filter("key = 700")) == [(700, "c", 9)] and stored.read().count() == 401


def test_another_session_opens_it(spark, stored):
    again = HashedTable.open(spark, stored.path, "key long, content string, created long", ["key"], 16)
    assert rows_of(again.read()) == ROWS
    again.upsert(spark.createDataFrame([(1, "x", 1)], "key long, content string, created long"), ["content"])
    assert rows_of(again.lookup(spark.createDataFrame([(1,), (None,)], "key long"))) == [(1, "x", 10)]


def test_two_keys_and_many_lookups(spark, tmp_path, monkeypatch):
    rows = [(str(a), b, a * b) for a in range(30) for b in range(9)]
    t = HashedTable.create(spark.createDataFrame(rows, "a string, b int, v int"), f"{tmp_path}/t", ["a", "b"], buckets=8)
    asked = [("3", 4), ("4", 3), ("99", 1)]
    want = [x for x in rows if x[:2] in asked]
    assert rows_of(t.lookup(spark.createDataFrame(asked, "a string, b int"))) == want
    monkeypatch.setattr("gridmill.operators.hashed.FEW", 1)
    found = t.lookup(spark.createDataFrame(asked, "a string, b int"))
    assert rows_of(found) == want
    assert t.lookup(spark.createDataFrame([], "a string, b int")).count() == 0


def test_insert_ignore_takes_the_least_row(spark):
    old = spark.createDataFrame([(1, "a")], "key long, v string")
    new = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b"), (2, None)], "key long, v string")
    assert rows_of(S.insert_ignore(old, new, ["key"])) == [(1, "a"), (2, "b")]


# -- the index --------------------------------------------------------------

LETTERS = "abAB çÇé%_\\\n🙂日x"


def texts(seed, n=120):
    rnd = random.Random(seed)
    rows = [(k % 40, ["scan", "table"][k % 2], k, "".join(rnd.choices(LETTERS, k=rnd.randint(0, 60)))) for k in range(n)]
    return [*rows, (1, "scan", n, None), (1, "scan", n + 1, ""), (2, "table", n + 2, "ab" * 3000 + "Needle"), (3, "scan", n + 3, "ab")]


FIELDS = "session_id long, kind string, page_index int, text string"
KEYS = ["session_id", "kind", "page_index"]


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def terms(rows, seed):
    rnd = random.Random(seed)
    long = [t for *_, t in rows if t and len(t) > 8]
    cut = [t[k : k + n] for t, k, n in ((t, rnd.randint(0, len(t) - 6), rnd.randint(1, 6)) for t in rnd.choices(long, k=10))]
    return [*cut, "", "a", "%", "needle", "NEEDLE", "aaaaaaa", "zzz", "🙂日x", "ababab", "é%_", "ÇÉ", "needles"]


@pytest.mark.parametrize("block", [X.BLOCK_PAIRS, 40])
def test_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK_PAIRS", block)
    monkeypatch.setattr(X, "AT_ONCE", 1000)
    rows = texts(1)
    index = X.TextIndex.create(spark.createDataFrame(rows, FIELDS).repartition(3), f"{tmp_path}/i", KEYS, buckets=4)
    for term in terms(rows, 2):
        want = sorted(r for r in rows if r[3] is not None and fold(term) in fold(r[3]))
        assert sorted(map(tuple, index.find(term, scan_above=1.0).collect())) == want, term
        if len(term) > 2:
            assert index.most(term) >= len(want)


def test_trigrams():
    assert X.trigrams("").size == X.trigrams("ab").size == 0
    assert X.trigrams("ABCabc").tolist() == X.trigrams("abcabc").tolist() and len(X.trigrams("abcabc")) == 3
    assert len(X.trigrams("É🙂é🙂")) == 2


def test_index_changes(spark, tmp_path):
    rows = texts(3)
    index = X.TextIndex.create(spark.createDataFrame(rows, FIELDS), f"{tmp_path}/i", KEYS, buckets=4)
    live = {r[:3]: r[3] for r in rows}
    changed = [(*rows[k][:3], f"changed needle {k}") for k in range(0, 60, 7)] + [(900, "scan", 0, "new Needle"), (901, "scan", 0, "other")]
    new = spark.createDataFrame(changed, FIELDS)
    for _ in range(2):  # the second time as after a crash
        index.add(new)
    live |= {r[:3]: r[3] for r in changed}
    gone = [rows[7], rows[20], changed[-1]]
    index.remove(spark.createDataFrame([r[:3] for r in gone], FIELDS.rsplit(",", 1)[0]))
    for r in gone:
        del live[r[:3]]
    for term in ("needle", "other", "changed n", "aba", "b"):
        want = sorted((*k, t) for k, t in live.items() if t is not None and fold(term) in fold(t))
        assert sorted(map(tuple, index.find(term).collect())) == want, term


def test_search_reads_candidates_only(spark, tmp_path):
    """Buckets without a candidate are not listed, and the scan has the candidates' numbers as its filter."""
    rows = [(k, "scan", 0, f"text {k} of many") for k in range(2000)] + [(5000, "scan", 0, "a needle here")]
    index = X.TextIndex.create(spark.createDataFrame(rows, FIELDS), f"{tmp_path}/i", KEYS, buckets=32)
    found = index.find("needle")
    assert [r["session_id"] for r in found.collect()] == [5000]
    scan = next(x for x in plan_of(found).split("\n") if "FileScan" in x and "bucket" in x)
    assert "InMemoryFileIndex(1 paths)" in scan and "PushedFilters: [" in scan and "EqualTo(entry" in scan.replace("In(entry", "EqualTo(entry")
    lists = next(x for x in plan_of(index.candidates("needle")).split("\n") if "FileScan" in x)
    assert "In(gram" in lists
    assert index.most("needle") == 1 and index.most("many") == 2000 and index.most("zzzz") == 0


def test_empty_index(spark, tmp_path):
    index = X.TextIndex.create(spark.createDataFrame([], FIELDS), f"{tmp_path}/i", KEYS, buckets=2)
    assert index.find("abc").count() == index.find("a").count() == 0
    index.add(spark.createDataFrame([(1, "scan", 0, "xabcx")], FIELDS))
    assert index.find("abc").count() == 1


def test_matches_of_sessions(spark, tmp_path):
    sessions = spark.createDataFrame([(1, "Needle"), (2, "b"), (3, "c"), (4, None)], "id long, title string")
    pages = spark.createDataFrame([(2, 1, "x NEEDLE"), (2, 0, "none"), (9, 0, "needle")], "session_id long, page_index int, full_text string")
    outputs = spark.createDataFrame([(3, 0, "a needle"), (2, 5, "needle 2"), (2, 4, "needle 1")], "session_id long, page_index int, csv_content string")
    index = X.index_pages(pages, outputs, f"{tmp_path}/i", buckets=2)
    for term in ("needle", "ne", "", "zzz"):
        assert rows_of(X.matches(sessions, index, term).select("id", "matched").fillna(False)) == rows_of(S.matches(sessions, pages, outputs, term).select("id", "matched").fillna(False))
        assert X.search_counts(sessions, index, term).first() == S.search_counts(sessions, pages, outputs, term).first()
    assert rows_of(X.first_texts(index, "needle").filter("id = 2")) == [(2, "x NEEDLE", "needle 1")]
    assert os.path.isdir(f"{tmp_path}/i/postings")
