"""Streams against what a finished table gives, and the spreadsheet sink."""

from __future__ import annotations

import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from gridmill.streaming import flows as S


def write(folder, k, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{k}.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # a stream reads the older file first


@pytest.fixture(autouse=True)
def batches_with_data_only(spark):
    """A stream with timers runs on for them, and would not end with the data that is there. Here a timer is looked at when a file comes."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.fixture
def batches_without_data(spark, batches_with_data_only):
    """A watermark is applied by a batch of its own."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_token_stream(spark, tmp_path):
    from test_parse import LINES

    text = "\n".join(LINES) + "\nunended"
    cut = [text[i : i + 17] for i in range(0, len(text), 17)]
    half = len(cut) // 2
    write(tmp_path / "in", 0, [{"request_id": 7, "chunk_no": i, "chunk": c} for i, c in enumerate(cut[:half])])
    write(tmp_path / "in", 1, [{"request_id": 7, "chunk_no": i + half, "chunk": c} for i, c in enumerate(cut[half:])])
    stream = spark.readStream.schema("request_id long, chunk_no int, chunk string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rows = drain(spark, S.read_tokens(stream), "tokens_out")
    said = sorted((r["seq"], r["token"], r["logprob"], r["char_offset"]) for r in rows if r["token"])
    assert said == [(0, "He", -0.1, 0), (1, "llo", None, 2), (2, "!", None, 5)]
    assert [r["finish_reason"] for r in rows if r["finish_reason"]] == ["length"]


def state_of(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", str(checkpoint)).option("stateVarName", name).load().select("key.*", "value.*").collect()


def files_in(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_token_state_ends(spark, tmp_path):
    """A stream that said its end, and one of which nothing more came, leave no state; one that goes on does, over a restart."""
    line = lambda word: 'data: {"choices": [{"delta": {"content": "%s"}}]}\n' % word  # noqa: E731, UP031

    def run(idle):
        q = S.read_tokens(files_in(spark, tmp_path / "in", "request_id long, chunk_no int, chunk string"), idle).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    write(tmp_path / "in", 0, [{"request_id": 1, "chunk_no": 0, "chunk": line("a") + "data: [DO"}, {"request_id": 2, "chunk_no": 0, "chunk": line("b") + line("c")[:9]}, {"request_id": 3, "chunk_no": 0, "chunk": line("d")}])
    run(3600)
    assert {r["request_id"]: (r["buffer"], r["seq"], r["char_offset"]) for r in state_of(spark, tmp_path / "check", "open")} == {1: ("data: [DO", 1, 1), 2: (line("c")[:9], 1, 1), 3: ("", 1, 1)}
    write(tmp_path / "in", 1, [{"request_id": 1, "chunk_no": 1, "chunk": "NE]\n"}, {"request_id": 2, "chunk_no": 1, "chunk": line("c")[9:]}])
    run(0.001)
    time.sleep(0.1)
    assert {r["request_id"]: r["seq"] for r in state_of(spark, tmp_path / "check", "open")} == {2: 2, 3: 1}
    write(tmp_path / "in", 2, [{"request_id": 4, "chunk_no": 0, "chunk": line("e")}])
    run(3600)
    assert {r["request_id"]: r["seq"] for r in state_of(spark, tmp_path / "check", "open")} == {3: 1, 4: 1}  # 2 was given up; 3 waits for an hour yet
    said = sorted((r["request_id"], r["seq"], r["token"], r["char_offset"]) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert said == [(1, 0, "a", 0), (2, 0, "b", 0), (2, 1, "c", 1), (3, 0, "d", 0), (4, 0, "e", 0)]


def test_throttle_state_ends(spark, tmp_path):
    def run(idle):
        q = S.throttled_stream(files_in(spark, tmp_path / "in", "key long, t double, value double"), 0.1, idle).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    write(tmp_path / "in", 0, [{"key": 1, "t": 0.0, "value": 0.0}, {"key": 2, "t": 0.0, "value": 0.0}])
    run(0.2)
    write(tmp_path / "in", 1, [{"key": 2, "t": 0.05, "value": 1.0}, {"key": 3, "t": 0.0, "value": 0.0}])
    time.sleep(0.5)
    run(3600)
    assert sorted(r["key"] for r in state_of(spark, tmp_path / "check", "last") if r["key"] != 2) == [3]
    assert sorted((r["key"], r["t"]) for r in spark.read.json(str(tmp_path / "out")).collect()) == [(1, 0.0), (2, 0.0), (2, 0.05), (3, 0.0)]  # 2 began anew
    with pytest.raises(ValueError):
        S.throttled_stream(spark.readStream.schema("key long, t double, value double").json(str(tmp_path / "in")), 5.0, 1.0)


def test_cancels_as_a_stream(spark, tmp_path, batches_without_data):
    """Pages and cancels that come in any order, over a restart; what passes is what the finished tables give, and state ends."""
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}"
    page = lambda session, run, started, s: {"session_id": session, "run_id": run, "started": at(started), "at": at(s)}

    def run():
        pages = files_in(spark, tmp_path / "pages", "session_id long, run_id long, started timestamp, at timestamp")
        cancels = files_in(spark, tmp_path / "cancels", "session_id long, at timestamp")
        q = S.uncancelled_stream(pages, cancels, "5 minutes", "30 seconds").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return q.lastProgress

    first = [page(1, 1, 0, s) for s in (5, 10, 15, 20)] + [page(2, 1, 0, 8)]
    write(tmp_path / "pages", 0, first)
    write(tmp_path / "cancels", 0, [{"session_id": 9, "at": at(1)}])
    run()
    second = [page(1, 2, 14, s) for s in (16, 25)] + [page(1, 1, 0, 30)]
    write(tmp_path / "pages", 1, second)
    write(tmp_path / "cancels", 1, [{"session_id": 1, "at": at(12)}, {"session_id": 1, "at": at(13)}])  # after pages of theirs had come
    run()
    last = [page(3, 1, 1200, 1200), page(3, 1, 1200, 1800)]
    write(tmp_path / "pages", 2, last[:1])
    write(tmp_path / "cancels", 2, [{"session_id": 9, "at": at(1200)}])
    run()
    write(tmp_path / "pages", 3, last[1:])
    write(tmp_path / "cancels", 3, [{"session_id": 9, "at": at(1800)}, {"session_id": 2, "at": at(2)}])  # too late by far
    progress = run()
    ts = lambda df: df.select(*[F.col(c).cast("timestamp").alias(c) if c in ("at", "started") else F.col(c) for c in df.columns])
    got = {(r["session_id"], r["run_id"], r["at"]) for r in ts(spark.read.json(str(tmp_path / "out"))).collect()}
    rows = ts(spark.createDataFrame(first + second, "session_id long, run_id long, started string, at string"))
    heard = ts(spark.createDataFrame([(1, at(12)), (1, at(13))], "session_id long, at string"))
    want = {(r["session_id"], r["run_id"], r["at"]) for r in S.uncancelled(rows.drop("started"), rows.select("session_id", "run_id", "started").distinct(), heard).collect()}
    assert {x for x in got if x[0] != 3} == want
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) <= 6  # the rows of the last minutes


def test_throttle_stream(spark, tmp_path):
    times = [0.0, 0.05, 0.1, 0.15, 0.31]
    write(tmp_path / "in", 0, [{"key": 1, "t": t, "value": t} for t in times])
    stream = spark.readStream.schema("key long, t double, value double").json(str(tmp_path / "in"))
    got = sorted(r["t"] for r in drain(spark, S.throttled_stream(stream, 0.1), "throttled_out"))
    batch = spark.createDataFrame([(1, t) for t in times], "user_id long, t double")
    assert got == [0.0, 0.1, 0.31] == sorted(r["t"] for r in S.throttled(batch, "user_id", 0.1).collect())


def test_feed(spark):
    def after(state, *events):
        known = spark.createDataFrame(list(state.items()), "session_id string, seq long")
        open_, due = S.after_changes(known, spark.createDataFrame(list(events), "seq long, kind string, session_id string"))
        return {r["session_id"]: r["seq"] for r in open_.collect()}, due.first()[0]

    assert after({}, (1, "update", "a"), (2, "update", "b")) == ({"a": 1, "b": 2}, True)
    assert after({"a": 1, "b": 2}, (3, "update", "b")) == ({"a": 1, "b": 3}, False)
    assert after({"a": 1}, (4, "delete", "x")) == ({"a": 1}, False)
    assert after({"a": 1, "b": 2}, (4, "delete", "b")) == ({"a": 1}, True)
    assert after({"a": 1}, (4, "delete_all", None)) == ({}, True)
    assert after({"a": 1}, (4, "delete_all", None), (5, "update", "c")) == ({"c": 5}, True)


def test_feed_goes_on_after_a_restart(spark, tmp_path):
    """A second query over the same folder knows what the first one left."""
    seen = []

    def run():
        stream = spark.readStream.schema("seq long, kind string, session_id string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        S.watch_feed(stream, lambda open_: seen.append({r["session_id"]: r["seq"] for r in open_.collect()}), str(tmp_path / "feed")).awaitTermination(120)

    write(tmp_path / "in", 0, [{"seq": 1, "kind": "update", "session_id": "a"}, {"seq": 2, "kind": "update", "session_id": "b"}])
    run()
    write(tmp_path / "in", 1, [{"seq": 3, "kind": "update", "session_id": "b"}])
    write(tmp_path / "in", 2, [{"seq": 4, "kind": "delete", "session_id": "b"}])
    run()
    assert seen == [{"a": 1, "b": 2}, {"a": 1}]


def test_throttle_over_batches(spark):
    import random

    rnd = random.Random(2)
    rows = [(k, round(rnd.random() * 50, 3)) for k in (1, 2, 3) for _ in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(tuple(r) for r in S.throttled(spark.createDataFrame(rows, "user_id long, t double"), "user_id", 0.25).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for key in (1, 2, 3):
        last = None
        for t in sorted(t for k, t in rows if k == key):
            if last is None or t - last >= 0.25:
                want.append((key, t))
                last = t
    assert got == want


def test_debounce_stream(spark, tmp_path, batches_without_data):
    write(tmp_path / "in", 0, [{"key": 1, "ts": f"2024-01-01T00:00:0{s}", "value": s} for s in (0, 1, 6)] + [{"key": 2, "ts": "2024-01-01T01:00:00", "value": 9}])
    stream = spark.readStream.schema("key long, ts timestamp, value int").json(str(tmp_path / "in"))
    got = drain(spark, S.debounced_stream(stream, "3 seconds", "0 seconds"), "debounced_out")
    assert {(r["key"], r["value"], r["n"]) for r in got if r["key"] == 1} == {(1, 1, 2), (1, 6, 1)}


def test_windowed_counts(spark, tmp_path, batches_without_data):
    write(tmp_path / "in", 0, [{"event_id": i // 2, "ts": f"2024-01-01T00:0{i // 4}:00", "event_type": "a", "value": 1.0} for i in range(8)] + [{"event_id": 99, "ts": "2024-01-01T05:00:00", "event_type": "a", "value": 1.0}])
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").json(str(tmp_path / "in"))
    got = drain(spark, S.windowed_counts(stream, "1 minute", None, "0 seconds"), "counts_out")
    assert sorted(r["n"] for r in got) == [2, 2]


def test_xlsx(spark, tmp_path):
    from gridmill.sources.xlsx import column_name, write_pages

    cells = spark.createDataFrame([(1, 0, 0, 0, "Name"), (1, 0, 1, 0, "=A<1"), (2, 0, 0, 0, "x")], "doc_id long, page_index int, row_index int, col_index int, value string")
    write_pages(spark, cells, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1_p1.xlsx", "2_p1.xlsx"]
    sheet = zipfile.ZipFile(tmp_path / "out" / "1_p1.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert 's="1"><is><t xml:space="preserve">Name' in sheet and "=A&lt;1" in sheet and sheet.count('t="inlineStr"') == 2
    assert [column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_xlsx_attempts(spark, tmp_path):
    """A task that fails leaves nothing; parts of attempts that were given up go with the commit; a page is written over."""
    from gridmill.sources.xlsx import read_pages, write_pages

    fields, out = "doc_id long, page_index int, row_index int, col_index int, value string", tmp_path / "out"
    with pytest.raises(Exception):  # noqa: B017
        write_pages(spark, spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 1, 2_000_000, 0, "b"), (1, 2, 0, 0, "c")], fields).coalesce(1), str(out))
    assert list(out.iterdir()) == []
    (out / "_9_p1.77.part").write_text("half")
    write_pages(spark, spark.createDataFrame([(1, 0, 0, 0, "old"), (1, 0, 3, 27, None)], fields), str(out))
    write_pages(spark, spark.createDataFrame([(1, 0, 0, 0, "new"), (1, 0, 3, 27, "x<y ")], fields), f"file://{out}")
    assert [p.name for p in out.iterdir()] == ["1_p1.xlsx"]
    assert sorted(map(tuple, read_pages(spark, str(out)).collect())) == [(1, 0, 0, 0, "new", True), (1, 0, 3, 27, "x<y ", False)]


def test_rows_for_export(spark):
    from gridmill.operators.export import rows_for_export

    df = spark.createDataFrame([(1, 0, [["a"]], [["b"]]), (2, 0, [], [["b"]]), (3, 0, None, None)], "doc_id long, page_index int, cells array<array<string>>, stored array<array<string>>")
    assert {r["doc_id"]: r["rows"] for r in rows_for_export(df).collect()} == {1: [["a"]], 2: [["b"]], 3: []}
    assert df.select(F.lit(1)).count() == 3
