"""Column rules on hand-made values."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gridmill.functions import misc as M
from gridmill.functions import text as T
from gridmill.operators import score as S
from gridmill.operators import store
from gridmill.sources import ingest as I


def each(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_text(spark):
    assert each(spark, T.normalize, ["1,250", "Calc.", "  A-B ", "é"]) == ["1250", "calc", "ab", ""]
    assert each(spark, T.normalize_unicode, ["É-1"]) == ["é1"]
    assert each(spark, lambda v: T.similarity(v, F.lit("abcde")), ["abcdx", "", "abcde"]) == [0.8, 0.0, 1.0]
    assert each(spark, T.estimated_tokens, ["", "abcd", "abcde"]) == [0, 1, 2]
    assert each(spark, lambda v: T.excerpt(v, 2, 100), ["a\nb\nc\nd", "a\n\n b  c"]) == [f"a\nb\n{T.EXCERPT_MARK}", "a\nb c"]
    assert each(spark, lambda v: T.excerpt(v, 9, 4), ["abcdefgh"]) == ["abcd"]


def test_formula_guard(spark):
    risky, plain = ["=SUM(A1:A9)", "@x", "-1+cmd", "\tx"], ["-42", "-1,234.00", "-$42", "-42%", "+1.5E-10", "(1,234)", "", "a"]
    assert each(spark, T.guard_formula, risky + plain) == ["'" + x for x in risky] + plain
    assert each(spark, lambda v: T.escape_csv(T.guard_formula(v)), ["=a,b"]) == ['"\'=a,b"']


def test_stem(spark):
    stem = lambda v: T.file_stem(v, F.lit(0), F.lit(1))
    assert each(spark, stem, ["My Report.pdf", None, "!!a  b!!.csv", "x" * 80]) == ["My_Report_extract", "extraction_extract", "a_b_extract", "x" * 50 + "_extract"]
    assert each(spark, lambda v: T.file_stem(v, F.lit(2), F.lit(5)), ["doc"]) == ["doc_p3_extract"]


def test_search_text(spark):
    assert each(spark, T.escape_like, ["100%", "a_b", "c\\d"]) == ["100\\%", "a\\_b", "c\\\\d"]
    long = "x " * 40 + "NEEDLE" + " y" * 40
    got = each(spark, lambda v: T.snippet(v, "needle"), [long, "none", "needle"])
    assert got[0]["match"] == "NEEDLE" and got[0]["before"].startswith("…") and got[0]["after"].endswith("…") and len(got[0]["before"]) == 49
    assert got[1] is None and (got[2]["before"], got[2]["after"]) == ("", "")
    assert each(spark, lambda v: T.snippet(v, ""), ["a"]) == [None]
    assert each(spark, T.shown_timestamp, ["2024-03-01 10:00:00", "soon"]) == ["2024-03-01", "soon"]


@pytest.mark.parametrize("case, level", [(("disagree", 1, 1, 100), "low"), (("image_only", 0.9, 0.9, None), "medium"), (("image_only", 0.5, 0.5, None), "low"), (("agree", 1, 1, 100), "high"), (("agree", 1, 0.2, 100), "medium"), (("agree", 0.7, 0.7, 70), "medium"), (("agree", 0.4, 0.4, 40), "low"), (("agree", 0.9, 0.49, 100), "medium"), (("agree", 0.65, 0.65, 65), "medium"), (("agree", 1, 1, None), "low"), (("agree", None, None, 96), "high"), (("agree", None, None, 70), "medium"), (("agree", None, None, 40), "low"), (("image_only", None, None, None), "low")])
def test_trust(spark, case, level):
    df = spark.createDataFrame([tuple(float(x) if isinstance(x, int) else x for x in case)], "a string, m double, n double, o double")
    assert df.select(S.trust(F.col("a"), F.col("m"), F.col("n"), F.col("o"))).first()[0] == level


def test_token_credit(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 0, 2), (1, 0, 0, 1, 3, 6)], "doc_id long, page_index int, row_index int, col_index int, range_start int, range_end int")
    tokens = spark.createDataFrame([(1, 0, 0, "AB", -0.1, 0), (1, 0, 1, "\tC", -2.0, 2), (1, 0, 2, "DE", -0.05, 4)], "doc_id long, page_index int, seq int, token string, logprob double, char_offset int")
    got = {r["col_index"]: round(r["llm_mean"], 4) for r in S.llm_scores(S.tokens_of_cells(tokens, cells)).collect()}
    assert got == {0: 0.9048, 1: 0.9512}


def test_ingest(spark):
    assert each(spark, I.magic_type, [b"%PDF-1", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"no", b""], "binary") == ["pdf", "png", "jpg", None, None]
    assert each(spark, I.extension, ["a.JPEG", "b.png", "c", "d.tar.gz"]) == ["jpg", "png", "", "gz"]
    assert each(spark, I.page_count_error, [0, 1, 2000, 2001], "int") == ["no pages", None, None, "too many pages"]
    df = spark.createDataFrame([(1000, 800, True), (1500, 1500, True), (500, 500, False)], "w int, h int, ok boolean")
    assert [r[0] for r in df.select(I.upscale_factor(F.col("w"), F.col("h"), F.col("ok"))).collect()] == [2.0, 1.0, 1.0]
    assert each(spark, lambda v: I.original_coordinate(v, F.lit(2.0)), [101], "int") == [51]
    chunks = spark.createDataFrame([(1, i, bytes([65 + i]) * 3) for i in range(5)], "stream int, seq int, content binary")
    assert [bytes(r["content"]) for r in I.rechunked(chunks, 5).orderBy("block").collect()] == [b"AAABBB", b"CCCDDD", b"EEE"]


def test_read_ocr_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\t".join(f.split()[0] for f in I.OCR_FIELDS.split(", ")) + "\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t1\t10\t21\t30\t40\t96.5\t\"Hi\n")
    rows = I.ocr_words(I.read_ocr(spark, str(tmp_path / "a.tsv")), F.lit(2.0)).collect()
    assert [(r["text"], r["confidence"], r["left"], r["top"]) for r in rows] == [('"Hi', 96.5, 5.0, 11.0)]


def test_misc(spark):
    assert each(spark, M.gpu_vendor, ["NVIDIA GeForce RTX", "Radeon", "Apple M2", "Intel UHD", "?"]) == ["nvidia", "amd", "apple", "intel", None]
    assert each(spark, M.shown_eta, [None, 5, 90, 4000], "int") == ["unknown", "5 s", "2 min", "1 h 7 min"]
    assert each(spark, lambda v: M.setting(v, ["a", "b"], "a"), ["b", "z", None]) == ["b", "a", "a"]
    assert each(spark, lambda v: M.copyright_years(F.lit(2024), v), [2024, 2026], "int") == ["2024", "2024–2026"]
    assert each(spark, lambda v: M.backend_warning(v, F.lit("amd")), ["cuda", "rocm", "cpu"]) == ["cuda needs a GPU by nvidia", None, None]
    assert each(spark, lambda v: M.zoom_level(v)["place"], [25.0, 100.0, 900.0], "double") == pytest.approx([0, 0.5, 1])


def test_store_helpers():
    assert store.merged_order(["b", "a", "x"], ["n", "a", "b"]) == ["n", "b", "a"]


def test_column_labels_of_any_length(spark):
    def by_hand(i):
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    numbers = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 1 << 40, (1 << 63) - 1]
    df = spark.createDataFrame([(i,) for i in numbers], "i long").select("i", T.column_label(F.col("i")).alias("label"))
    assert {r["i"]: r["label"] for r in df.collect()} == {i: by_hand(i) for i in numbers}


def test_migrations_run_once(spark):
    from gridmill.operators import store

    steps = [(1, "create table if not exists mig_a (id int) using parquet"), (2, "create table if not exists mig_b (id int, name string) using parquet"), (2, "insert into mig_a values (7)")]
    assert store.run_migrations(spark, steps[:1], "mig_version") == 1
    assert store.run_migrations(spark, steps, "mig_version") == 2 == store.run_migrations(spark, steps, "mig_version")
    assert spark.table("mig_a").count() == 1 and spark.table("mig_b").columns == ["id", "name"]
    for t in ("mig_a", "mig_b", "mig_version"):
        spark.sql(f"drop table {t}")


def test_failed_image_fails_the_query(spark):
    import pytest

    from gridmill.sources.ingest import page_results

    pages = spark.createDataFrame([(1, 0, "Image", "broken")], "doc_id long, page_index int, kind string, error string")
    words = spark.createDataFrame([], "doc_id long, page_index int")
    with pytest.raises(Exception, match="could not be read"):
        page_results(pages, words).collect()


def test_overlay_of_none(spark):
    from gridmill.operators.layout import overlay

    words = spark.createDataFrame([(1, 50.0)], "doc_id long, confidence double")
    assert overlay(words, "none").count() == 0 and overlay(words, "all").first()["dim"] is False


def test_undo_by_hand(spark):
    from gridmill.operators.history import undo_state

    def state(*actions, depth=50):
        log = [(1, i, a, g) for i, (a, g) in enumerate(actions)]
        r = undo_state(spark.createDataFrame(log, "k int, seq int, action string, grid string"), ["k"], depth).first()
        return r["current"], r["undo"], r["redo"]

    edits = [("reset", "a"), ("apply", "b"), ("apply", "c")]
    assert state(*edits) == ("c", 2, 0) and state(*edits, ("apply", "c")) == ("c", 2, 0)
    assert state(*edits, ("undo", None)) == ("b", 1, 1) and state(*edits, ("undo", None), ("redo", None)) == ("c", 2, 0)
    assert state(*edits, ("undo", None), ("apply", "d")) == ("d", 2, 0)  # nothing can be redone
    assert state(*edits, ("redo", None)) == ("c", 2, 0) and state(("reset", "a"), ("undo", None)) == ("a", 0, 0)
    assert state(*edits, ("reset", "z")) == ("z", 0, 0)
    many = [("reset", "0"), *[("apply", str(i)) for i in range(1, 80)]]
    assert state(*many) == ("79", 50, 0) and state(*many, *[("undo", None)] * 60) == ("29", 0, 50)


def test_compact_takes_all_white_space(spark):
    from pyspark.sql import functions as F

    from gridmill.functions import text as T

    odd = ["", " ", "\n\n", " a  b \r\n\r\n\tc\x0b d  \n \n e\r f ", "x\r\r\ny", "﻿z　", None]
    want = []
    for t in odd:
        found = [" ".join(re.split(r"[\s﻿]+", x)).strip() for x in re.split(r"\r?\n", t or "")]
        want.append(None if t is None else "\n".join(x for x in found if x))
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", T.compact(F.col("t")).alias("c")).orderBy("i")
    assert [r["c"] for r in df.collect()] == want


def test_search_pages(spark):
    """Pages past the end are the last one; no hit is no row; an empty term is every session."""
    from gridmill.operators import store

    sessions = spark.createDataFrame([(i, f"title {i}", i % 7) for i in range(25)], "id long, title string, updated_at int")
    pages = spark.createDataFrame([(i, k, f"page {k} of {i} has Needle" if i % 2 else "hay") for i in range(25) for k in (1, 0)], "session_id long, page_index int, full_text string")
    outputs = spark.createDataFrame([(3, 0, "a,needle"), (4, 0, "needle")], "session_id long, page_index int, csv_content string")
    order = [i for _, i in sorted((-(i % 7), i) for i in range(25) if i % 2 or i == 4)]
    found = lambda term, page: sorted(store.search_page(sessions, pages, outputs, term, page, 5).collect(), key=lambda r: (-r["updated_at"], r["id"]))
    for page, want in ((1, order[:5]), (2, order[5:10]), (3, order[10:]), (99, order[10:]), (0, order[:5])):
        got = found("needle", page)
        assert [r["id"] for r in got] == want
        assert all(r["scan_match"] == (f"page 0 of {r['id']} has Needle" if r["id"] % 2 else None) and (r["table_match"] is not None) == (r["id"] in (3, 4)) for r in got)
    assert found("nowhere", 1) == [] and len(found("", 5)) == 5 and len(found("", 6)) == 5
    assert store.search_counts(sessions, pages, outputs, "needle").first()[:] == (13, 25)
