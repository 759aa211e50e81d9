"""What shows in larger tables only, in small."""

from __future__ import annotations

import base64
import pickle
import random
from types import SimpleNamespace

from pyspark.sql import functions as F
import pyarrow as pa

from gridmill.operators import history as H
from gridmill.operators import match as M
from gridmill.operators import pagejoins as J
from gridmill.operators import reports as R
from gridmill.sources import ingest as I
from gridmill.sources import xlsx


def test_a_commit_sets_the_activity(spark):
    """Also where a later one was stored."""
    sessions = spark.createDataFrame([(1, 3000), (2, 10), (3, 7)], "id long, updated_at long")
    outputs = spark.createDataFrame([(1, 0, "old", None)], "session_id long, page_index int, csv_content string, cell_mappings_json string")
    cells = spark.createDataFrame([(1, 0, 0, 0, "x")], "doc_id long, page_index int, row_index int, col_index int, value string")
    at = spark.createDataFrame([(1, 2000), (1, 1500), (2, 2000)], "session_id long, ts long")
    new, touched = H.committed(outputs, sessions, cells, at)
    assert sorted(map(tuple, touched.collect())) == [(1, 2000), (2, 2000), (3, 7)] and [r["csv_content"] for r in new.collect()] == ["x"]


def test_a_mean_of_just_the_middle_is_not_dark(spark):
    """Added in any order, though sums of fractions differ by it."""
    r, g, b = 0.299, 0.587, 0.114
    found = [(p, q) for p in ((x, y, z) for x in range(90, 110) for y in range(100, 160) for z in range(200, 256, 5)) for q in [tuple(256 - c for c in p)] if (p[0] * r + p[1] * g + p[2] * b + q[0] * r + q[1] * g + q[2] * b) / 2 < 128]
    rows = [(k, *c) for k, two in enumerate(found[:20]) for c in two]
    assert rows and not any(x["dark"] for x in R.darkness(spark.createDataFrame(rows, "k int, r int, g int, b int"), ["k"]).collect())
    assert {x["k"]: x["dark"] for x in R.darkness(spark.createDataFrame([(1, 127, 128, 128), (2, 129, 128, 128)], "k int, r int, g int, b int"), ["k"]).collect()} == {1: True, 2: False}


def test_long_data_urls_are_one_line(spark):
    texts = ["", "a" * 57, "b" * 58, "ü" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(I.data_url("text/plain", F.col("t").cast("binary"))).collect()
    assert [r[0] for r in got] == ["data:text/plain;base64," + base64.b64encode(t.encode()).decode() for t in texts]

def test_ocr_files_do_not_grow_with_pages(spark, tmp_path):
    docs = [*range(40), 4095, 4096, 9000]
    rows = [(5, *[0] * 4, 1, 1, 2, 3, 4, 50.0, f"w{d} {p}", d, p) for d in docs for p in range(3)]
    I.write_ocr_groups(spark.createDataFrame(rows, I.OCR_PAGES), str(tmp_path / "ocr"))
    assert sorted(p.name for p in (tmp_path / "ocr").glob("doc_group=*")) == ["doc_group=0", "doc_group=1", "doc_group=2"]
    assert len(list((tmp_path / "ocr").rglob("*.csv"))) <= I.GROUP_FILES + 2 < len(rows)
    read = I.read_ocr_groups(spark, str(tmp_path / "ocr"), 5)
    assert sorted(map(tuple, read.select("doc_id", "page_index", "text").collect())) == sorted((r[12], r[13], r[11]) for r in rows if r[12] >= 5)
    assert I.read_ocr_groups(spark, str(tmp_path / "ocr"), 4096).inputFiles() and I.read_ocr_groups(spark, str(tmp_path / "ocr")).count() == len(rows)

def test_pages_are_taken_out_of_a_batch_by_and_by():
    whole = pa.RecordBatch.from_pydict({"k": list(range(1000))})
    taken = list(M.few([whole, whole.slice(0, 1)]))
    assert max(b.num_rows for b in taken) <= M.PAGES and [k for b in taken for k in b.column(0).to_pylist()] == [*range(1000), 0]

def test_a_task_of_many_workbooks_says_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx.TaskContext, "get", lambda: SimpleNamespace(taskAttemptId=lambda: 3))
    (tmp_path / "_5_p1.3.part").write_text("half")  # of another job, whose task had the same number
    writer = xlsx.XlsxWriter(str(tmp_path))
    said = writer.write(iter(SimpleNamespace(doc_id=k, page_index=0, row_index=0, col_index=0, value="x") for k in range(300)))
    assert len(pickle.dumps(said)) < 300
    writer.commit([said, None])
    assert {p.name for p in tmp_path.iterdir()} == {f"{k}_p1.xlsx" for k in range(300)}

def test_sketches_differ_by_no_more_than_edits_allow(spark):
    """And rows that meet carry no lists of letters."""
    rnd = random.Random(5)
    words = ["", "a", *("".join(rnd.choices("abc1", k=rnd.randint(1, 12))) for _ in range(60))]
    both = spark.createDataFrame([(a, b) for a in words for b in words], "v string, t string").select("v", "t", J._sketch("v").alias("x"), J._sketch("t").alias("y"))
    assert both.filter("bit_count(x ^ y) > 2 * levenshtein(v, t) - abs(length(v) - length(t))").count() == 0
    page = "doc_id long, page_index int, ord int"
    near = J.near_candidates(spark.createDataFrame([(1, 0, 0, "abc")], page + ", value string"), spark.createDataFrame([(1, 0, 0, "w", "abd")], page + ", word_id string, text string"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert near.count() > 0 and "v_sketch" in plan and "_letters" not in plan


def test_an_editor_is_one_row_however_its_log_was_exchanged(spark):
    """Spark may broadcast the resets once it has seen how few they are, and read the log as its mappers wrote it."""
    confs = {"spark.sql.optimizer.disableHints": "true", "spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    k = F.col("id")
    action = F.when(k == 4000, "reset").otherwise(F.element_at(F.array(*map(F.lit, ["apply", "apply", "undo", "apply", "redo", "undo", "apply"])), (k % 7 + 1).cast("int")))
    log = spark.range(0, 20000, 1, 5).select((k % 13).alias("user_id"), k.alias("seq"), action.alias("action"), F.floor(k / 2).cast("string").alias("grid"))
    want = {}
    for user, _, what, grid in log.orderBy("seq").collect():
        want.setdefault(user, H.Steps(H.DEPTH)).take(what, grid)
    was = {c: spark.conf.get(c, None) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        got = H.undo_state(log, ["user_id"]).collect()
    finally:
        for c, v in was.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert sorted(map(tuple, got)) == sorted((u, s.current, len(s.past), len(s.future)) for u, s in want.items())
