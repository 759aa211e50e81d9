"""The source of OCR files in batches and as a stream, pages of latest sessions, trees of folders, versions of grids."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridmill.operators import history as H
from gridmill.operators import reports as R
from gridmill.operators.pages import LatestFirst
from gridmill.sources import ingest as I

HEAD = "level page_num block_num par_num line_num word_num left top width height conf text".replace(" ", "\t")


def page(root, doc, index, words):
    folder = root / f"doc_id={doc}" / f"page_index={index}"
    folder.mkdir(parents=True, exist_ok=True)
    lines = [f"5\t1\t1\t1\t1\t{k}\t{10 * k}\t20\t8\t9\t{50 + k}.5\t{w}" for k, w in enumerate(words)]
    (folder / "page.tsv").write_text("\n".join([HEAD, "1\t1\t0\t0\t0\t0\t0\t0\t100\t100\t-1\t", *lines]) + "\n")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_ocr_pages(spark, tmp_path):
    for doc in (1, 2, 30):
        for index in (0, 1):
            page(tmp_path, doc, index, ["Total", 'a "quote"', "naïve 日", str(doc)])
    read = I.read_ocr_pages(spark, str(tmp_path))
    assert read.count() == 30
    found = I.ocr_words(read.filter("doc_id in (2, 30) and page_index > 0"), F.lit(2.0)).filter("text like 'a%'")
    assert rows_of(found.select("doc_id", "page_index", "text", "confidence", "left")) == [(2, 1, 'a "quote"', 51.5, 5.0), (30, 1, 'a "quote"', 51.5, 5.0)]
    scan = next(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert "InMemoryFileIndex(2 paths)" in scan.replace("InMemoryFileIndex(6 paths)", "") or "doc_id#" in scan.split("PartitionFilters: [")[1].split("]")[0]
    I.write_ocr_pages(read, str(tmp_path / "again"))
    assert rows_of(I.read_ocr_pages(spark, str(tmp_path / "again")).fillna("")) == rows_of(read.fillna(""))


def test_ocr_stream_gives_what_a_batch_gives(spark, tmp_path):
    """Over restarts each file comes once."""
    root = tmp_path / "in"

    def run():
        q = I.stream_ocr_pages(spark, str(root), 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    page(root, 1, 0, ["one", "two"])
    run()
    page(root, 2, 0, ["three"])
    page(root, 1, 1, ["four"])
    run()
    run()
    want = I.read_ocr_pages(spark, str(root))
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select(want.columns).fillna("")) == rows_of(want.fillna("")) and want.count() == 7


# -- latest sessions --------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_pages_of_latest_sessions(spark, tmp_path, parts):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, *range(30)])) for k in rnd.sample(range(1000), 237)]
    stored = LatestFirst.create(spark.createDataFrame(rows, "id long, updated_at int"), str(tmp_path / "s"), parts)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    hits = {k for k, _ in rows if k % 3 == 0}
    hit_df = spark.createDataFrame([(k,) for k in [*hits, 5000]], "id long")
    ids = lambda df: [r["id"] for r in df.collect()]
    some = [r for r in order if r[0] in hits]
    for n in (1, 2, 13, 24, 99):
        k = min(n, 24)
        assert ids(stored.page(n)) == [r[0] for r in order[10 * k - 10 : 10 * k]]
        k = min(n, -(-len(some) // 10))
        assert ids(stored.page(n, hits=hit_df)) == [r[0] for r in some[10 * k - 10 : 10 * k]]
    for at in (0, 57, 200, 230):
        assert ids(stored.after(order[at][1], order[at][0])) == [r[0] for r in order[at + 1 : at + 11]]
        assert ids(stored.after(order[at][1], order[at][0], hits=hit_df)) == [r[0] for r in order[at + 1 :] if r[0] in hits][:10]
    if parts > 1:
        scans = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
        assert any("InMemoryFileIndex(1 paths)" in x or "InMemoryFileIndex(2 paths)" in x for x in scans(stored.page(13)))
        assert "LessThanOrEqual(updated_at" in scans(stored.after(5, 0))[0]


def test_page_of_nothing(spark, tmp_path):
    stored = LatestFirst.create(spark.createDataFrame([(1, 1)], "id long, updated_at int"), str(tmp_path / "s"), 2)
    assert stored.page(3, hits=spark.createDataFrame([], "id long")).count() == 0 and stored.page(0).count() == 1


# -- folders ----------------------------------------------------------------


def test_folder_sizes(spark):
    files = [("a/b/c/x", 5), ("a/b/y", 7), ("a/z", None), ("top", 3), ("/abs/f", 1), ("a/b2/w", 2)]
    df = spark.createDataFrame(files, "path string, length long")
    got = {r["folder"]: (r["depth"], r["bytes"], r["files"], r["own_files"]) for r in R.folder_sizes(df).collect()}
    assert got == {"a": (1, 14, 4, 1), "a/b": (2, 12, 2, 1), "a/b/c": (3, 5, 1, 1), "a/b2": (2, 2, 1, 1), "": (1, 1, 1, 0), "/abs": (2, 1, 1, 1)}
    assert rows_of(R.subtree(df, "a/b").select("path")) == [("a/b/c/x",), ("a/b/y",)]
    assert rows_of(R.subtree(df, "a/b/").select("path")) == [("a/b/c/x",), ("a/b/y",)]


# -- versions ---------------------------------------------------------------


def test_versions_of_grids(spark):
    rnd = random.Random(9)
    grids, rows, now = {}, [], {}
    for v in range(1, 3001):
        for _ in range(rnd.randint(0, 2)):
            cell = (rnd.randint(0, 3), rnd.randint(0, 2))
            value = rnd.choice([None, "", "x", str(v)])
            now = {k: x for k, x in now.items() if k != cell} | ({cell: value} if value is not None else {})
            rows = [r for r in rows if (r[4], r[2], r[3]) != (v, *cell)] + [(1, 0, *cell, v, value)]
        if v in (1, 5, 1023, 1024, 1025, 2999, 3000):
            grids[v] = now
    grids[9000] = now
    deltas = spark.createDataFrame(rows, "doc_id long, page_index int, row_index int, col_index int, version long, value string")
    asked = spark.createDataFrame([(1, 0, v) for v in grids] + [(1, 0, 0), (2, 0, 7), (1, 0, 5)], "doc_id long, page_index int, version long")
    got = {}
    for r in H.grids_at(deltas, asked).collect():
        got.setdefault(r["version"], {})[r["row_index"], r["col_index"]] = r["value"]
    assert got == {v: g for v, g in grids.items() if g}


def test_changes_make_the_next_grid(spark):
    cell = "doc_id long, page_index int, row_index int, col_index int, value string"
    old = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 0, 0, 1, "b"), (1, 0, 1, 0, None)], cell)
    new = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 0, 0, 1, "c"), (1, 0, 2, 2, "d")], cell)
    deltas = H.changes_between(old.limit(0), old, 1).unionByName(H.changes_between(old, new, 2))
    asked = spark.createDataFrame([(1, 0, 1), (1, 0, 2)], "doc_id long, page_index int, version long")
    assert rows_of(H.grids_at(deltas, asked)) == [(1, 0, 1, 0, 0, "a"), (1, 0, 1, 0, 1, "b"), (1, 0, 2, 0, 0, "a"), (1, 0, 2, 0, 1, "c"), (1, 0, 2, 2, 2, "d")]


def test_undo_of_a_million_actions(spark):
    """An editor's log streams by; what it had before a reset is not sent."""
    log = spark.range(1_000_000).select(F.lit(1).alias("user_id"), F.col("id").alias("seq"), F.when(F.col("id") == 600_000, "reset").when(F.col("id") % 3 == 2, "undo").otherwise("apply").alias("action"), F.col("id").cast("string").alias("grid"))
    log = log.unionAll(spark.createDataFrame([(2, 1, "undo", None), (2, 2, "apply", "a"), (2, 3, "apply", "b"), (2, 4, "undo", None), (2, 5, "redo", None), (2, 6, "undo", None)], "user_id int, seq long, action string, grid string"))
    assert rows_of(H.undo_state(log, ["user_id"])) == [(1, "999999", 50, 0), (2, "a", 0, 1)]
