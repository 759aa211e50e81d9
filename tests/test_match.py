"""Hand-made and random pages: the matcher over tables of pages against one page at a time, and that against what it should say."""

from __future__ import annotations

import random

import numpy as np
import pytest

from plain_matcher import PlainPage, Word, match_page, normal

from gridmill.operators.match import LEAST_ROW, MISS_ROW, MOST_SPAN, SKIP_LINE, best_run, edit_distance, likeness, matched


def words(*spec) -> list[Word]:
    """(text, left, top, width) each; height 10."""
    return [Word(f"w{i}", t, left, top, width, 10) for i, (t, left, top, width) in enumerate(spec)]


def plain(*texts) -> list[Word]:
    return words(*[(t, 0, 0, 10) for t in texts])


def texts(found, made):
    by_id = {w.id: w.text for w in made}
    return [[(s, [by_id[i] for i in ids]) for s, ids in row] for row in found]


def test_normal_and_distance():
    assert [normal(x) for x in ("1,250", "Calc.", "  A-B ")] == ["1250", "calc", "ab"]
    assert edit_distance("kitten", "sitting") == 3


def test_walk():
    w = plain("Course", "Credits", "Math", "101", "3.0")
    assert texts(match_page([["Course", "Credits"], ["Math 101", "3.0"]], w), w)[1] == [("multi_word", ["Math", "101"]), ("matched", ["3.0"])]
    w = plain("A", "B", "A", "C")
    assert match_page([["A", "B"], ["A", "C"]], w)[1][0] == ("matched", ["w2"])
    w = plain("Alpha", "Gamma")
    assert [s for s, _ in match_page([["Alpha", "zzzzz", "Gamma"]], w)[0]] == ["matched", "unmatched", "matched"]


def test_fuzzy():
    w = plain("Calc", "for", "eng", "|")
    assert texts(match_page([["Calc for eng I"]], w), w)[0][0] == ("fuzzy", ["Calc", "for", "eng"])
    assert match_page([["abcde"]], plain("abcdx"))[0][0][0] == "fuzzy"
    assert match_page([["abcd"]], plain("abcx"))[0][0][0] == "unmatched"


def test_nothing():
    assert match_page([], []) == []
    assert match_page([["a", "b"]], []) == [[("unmatched", []), ("unmatched", [])]]
    assert match_page([["-"]], plain("x"))[0][0] == ("empty", [])


def test_rows_out_of_order():
    w = words(("H1", 0, 0, 10), ("H2", 100, 0, 10), ("A", 0, 20, 10), ("X", 100, 20, 10), ("Y", 100, 40, 10), ("B", 0, 40, 10))
    assert texts(match_page([["H1", "H2"], ["A", "X"], ["B", "Y"]], w), w)[2] == [("matched", ["B"]), ("matched", ["Y"])]


def test_band_recovers_overlapping_columns():
    w = words(("H1", 0, 0, 60), ("H2", 80, 0, 60), ("A", 0, 20, 90), ("X", 100, 20, 40), ("Y", 70, 40, 70), ("B", 0, 40, 60))
    assert texts(match_page([["H1", "H2"], ["A", "X"], ["B", "Y"]], w), w)[2][1] == ("matched", ["Y"])


def test_wrapped_cell():
    w = words(("Course", 0, 0, 60), ("Credits", 200, 0, 70), ("Linear", 0, 20, 50), ("Algebra", 60, 20, 60), ("and", 130, 20, 30), ("3.0", 200, 20, 30), ("Applications", 0, 40, 110), ("Physics", 0, 60, 60), ("4.0", 200, 60, 30))
    got = texts(match_page([["Course", "Credits"], ["Linear Algebra and Applications", "3.0"], ["Physics", "4.0"]], w, 70), w)
    assert got[1] == [("multi_word", ["Linear", "Algebra", "and", "Applications"]), ("matched", ["3.0"])]
    assert got[2] == [("matched", ["Physics"]), ("matched", ["4.0"])]


def test_repeated_row():
    w = words(("Item", 0, 0, 40), ("Qty", 200, 0, 30), ("Widget", 0, 20, 60), ("7", 200, 20, 10))
    got = match_page([["Item", "Qty"], ["Widget", "5"], ["Widget", "7"]], w)
    assert got[2] == [("matched", ["w2"]), ("matched", ["w3"])] and got[1][1][0] == "unmatched"


def test_title_and_right_justified():
    w = words(("Quarterly report", 10, 0, 220), ("Item", 0, 20, 40), ("Cost", 200, 20, 40), ("Bolt", 0, 40, 40), ("112.00", 180, 40, 70))
    got = match_page([["Item", "Cost"], ["Bolt", "112.00"]], w)
    assert [[s for s, _ in r] for r in got] == [["matched", "matched"]] * 2


def test_grid_given_up():
    w = words(("a", 0, 0, 10), ("b", 100, 0, 10), ("c", 0, 20, 10), ("d", 100, 20, 10))
    got = texts(match_page([["ab", "x"], ["cd", "y"]], w), w)
    assert got[0][0] == ("multi_word", ["a", "b"]) and got[1][0] == ("multi_word", ["c", "d"])


def test_empty_cells_show_overlooked_words():
    def page(*extra):
        w = words(("Item", 0, 0, 40), ("Qty", 200, 0, 30), ("Widget", 0, 20, 60), ("7", 200, 20, 10), ("Bolt", 0, 40, 40), *extra)
        return texts(match_page([["Item", "Qty"], ["Widget", "7"], ["Bolt", ""]], w), w)[2][1]

    assert page(("77", 200, 40, 20)) == ("empty", ["77"])
    assert page(("|", 200, 40, 5)) == ("empty", [])
    assert page() == ("empty", [])


def test_all_empty_column_between_full_ones():
    w = words(("Alpha", 0, 0, 50), ("Mid1", 100, 0, 40), ("Gamma", 200, 0, 50), ("a1", 0, 20, 20), ("Mid2", 100, 20, 40), ("c1", 200, 20, 20))
    got = texts(match_page([["Alpha", "", "Gamma"], ["a1", "", "c1"]], w), w)
    assert [r[1] for r in got] == [("empty", ["Mid1"]), ("empty", ["Mid2"])]


def test_no_word_twice_among_full_cells(spark, sf):
    from pyspark.sql import functions as F

    from gridmill.plans.match_queries import match_cells

    used = match_cells(spark, sf).filter("match_status != 'empty'").select("doc_id", F.explode(F.split("word_ids", " ")).alias("w")).filter("w != ''")
    assert used.count() == used.distinct().count()


def grid_page(rnd, rows, columns, misread=0.08):
    """Rows of values, and their words printed far apart, some misread."""
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 8))) for _ in range(60)]
    grid = [[rnd.choice(vocabulary) + " " + rnd.choice(vocabulary), *(rnd.choice(vocabulary) for _ in range(columns - 2)), str(rnd.randint(0, 99999))] for _ in range(rows)]
    spec = []
    for r, row in enumerate(grid):
        for c, value in enumerate(row):
            x = 220 * c
            for t in value.split():
                spec.append((t[:-1] + "x" if rnd.random() < misread else t, x, 20 * r, 6 * len(t)))
                x += 6 * len(t) + 4
    return grid, words(*spec)


def test_large_page_is_matched():
    grid, printed = grid_page(random.Random(1), 600, 6)
    found = match_page(grid, printed, 400)
    said = [(s, ids) for row in found for s, ids in row]
    assert {s for s, _ in said} <= {"matched", "multi_word", "fuzzy", "unmatched"}
    assert sum(s != "unmatched" for s, _ in said) > 0.95 * len(said)
    by_id = {w.id: w for w in printed}
    assert all(by_id[i].top == 20 * r and by_id[i].left >= 220 * c for r, row in enumerate(found) for c, (_, ids) in enumerate(row) for i in ids)


@pytest.mark.parametrize("seed", range(30))
def test_alignment_by_hand(seed):
    """The best total over all ways, without any bound; of equal ones the rule's order."""
    rnd = random.Random(seed)
    grid, printed = grid_page(rnd, rnd.randint(1, 5), 3, misread=0.4)
    extra = words(*[(rnd.choice(["zz", "total", "page"]), rnd.choice([0, 220, 440]), rnd.choice([5, 30, 45]), 20) for _ in range(rnd.randint(0, 3))])
    page = PlainPage(grid, printed + extra, 400)
    bands, lines = [0, 1, 2], [[i for i, w in enumerate(page.words) if w.top == t] for t in sorted({w.top for w in page.words})]
    for w in page.words:
        w.band = int(w.left // 220)
    text = lambda line, b: "".join(page.words[i].norm for i in line if page.words[i].band == b)

    def like(r, first, last):
        whole = weight = 0.0
        for b in range(3):
            a, t = page.cells[r][b].norm, "".join(text(line, b) for line in lines[first:last])
            w = max(len(a), len(t))
            if w:
                whole, weight = whole + likeness(a, t) * w, weight + w
        return whole / weight if weight else 0.0

    def best(r, k):
        if not r or not k:
            return (SKIP_LINE * k if not r else MISS_ROW * r), [[] for _ in range(r)]
        ways = [(best(r, k - 1)[0] + SKIP_LINE, best(r, k - 1)[1]), (best(r - 1, k)[0] + MISS_ROW, [*best(r - 1, k)[1], []])]
        for span in range(1, min(MOST_SPAN, k) + 1):
            s = like(r - 1, k - span, k)
            if s >= LEAST_ROW:
                ways.append((best(r - 1, k - span)[0] + s, [*best(r - 1, k - span)[1], sorted(i for line in lines[k - span : k] for i in line)]))
        first = max(range(len(ways)), key=lambda i: (ways[i][0], -i))
        return ways[first]

    assert page.align(bands, lines, 3) == best(len(grid), len(lines))[1]


# -- tables of pages --------------------------------------------------------

CELLS = "doc_id long, page_index int, row_index int, col_index int, value string"
WORDS = "doc_id long, page_index int, word_ord int, word_id string, text string, left double, top double, width double, height double"


def same_as_one_at_a_time(spark, pages, height=None):
    """``pages``: rows and words of each."""
    cells = [(d, 0, r, c, v) for d, (rows, _) in enumerate(pages) for r, row in enumerate(rows) for c, v in enumerate(row)]
    printed = [(d, 0, k, w.id, w.text, float(w.left), float(w.top), float(w.width), float(w.height)) for d, (_, words_) in enumerate(pages) for k, w in enumerate(words_)]
    found = {(r["doc_id"], r["row_index"], r["col_index"]): (r["match_status"], r["word_ids"]) for r in matched(spark.createDataFrame(cells, CELLS), spark.createDataFrame(printed, WORDS), height).collect()}
    assert len(found) == len(cells)
    for d, (rows, words_) in enumerate(pages):
        want = match_page(rows, words_, height)
        assert [[found[d, r, c] for c in range(len(row))] for r, row in enumerate(rows)] == want, (d, rows)
    return found


def test_hand_made_pages_as_a_table(spark):
    pages = [
        ([["Course", "Credits"], ["Math 101", "3.0"]], plain("Course", "Credits", "Math", "101", "3.0")),
        ([["A", "B"], ["A", "C"]], plain("A", "B", "A", "C")),
        ([["Alpha", "zzzzz", "Gamma"]], plain("Alpha", "Gamma")),
        ([["Calc for eng I"]], plain("Calc", "for", "eng", "|")),
        ([["abcd"], ["-"], [""]], plain("abcx", "x")),
        ([["a", "b"]], []),
        ([["H1", "H2"], ["A", "X"], ["B", "Y"]], words(("H1", 0, 0, 10), ("H2", 100, 0, 10), ("A", 0, 20, 10), ("X", 100, 20, 10), ("Y", 100, 40, 10), ("B", 0, 40, 10))),
        ([["H1", "H2"], ["A", "X"], ["B", "Y"]], words(("H1", 0, 0, 60), ("H2", 80, 0, 60), ("A", 0, 20, 90), ("X", 100, 20, 40), ("Y", 70, 40, 70), ("B", 0, 40, 60))),
        ([["Item", "Qty"], ["Widget", "5"], ["Widget", "7"]], words(("Item", 0, 0, 40), ("Qty", 200, 0, 30), ("Widget", 0, 20, 60), ("7", 200, 20, 10))),
        ([["ab", "x"], ["cd", "y"]], words(("a", 0, 0, 10), ("b", 100, 0, 10), ("c", 0, 20, 10), ("d", 100, 20, 10))),
        ([["Item", "Qty"], ["Widget", "7"], ["Bolt", ""]], words(("Item", 0, 0, 40), ("Qty", 200, 0, 30), ("Widget", 0, 20, 60), ("7", 200, 20, 10), ("Bolt", 0, 40, 40), ("77", 200, 40, 20))),
        ([["Alpha", "", "Gamma"], ["a1", "", "c1"]], words(("Alpha", 0, 0, 50), ("Mid1", 100, 0, 40), ("Gamma", 200, 0, 50), ("a1", 0, 20, 20), ("Mid2", 100, 20, 40), ("c1", 200, 20, 20))),
    ]
    found = same_as_one_at_a_time(spark, pages)
    assert found[10, 2, 1] == ("empty", ["w5"]) and found[9, 0, 0] == ("multi_word", ["w0", "w1"]) and found[7, 2, 1][0] == "matched"


@pytest.mark.parametrize("height", [None, 400.0])
def test_random_pages_as_a_table(spark, height):
    """Clean grids, torn ones, pages without channels, blank cells, ragged rows, words out of order."""
    rnd, pages = random.Random(21), []
    for k in range(60):
        grid, printed = grid_page(rnd, rnd.randint(1, 7), rnd.randint(2, 4), misread=rnd.choice([0, 0.1, 0.5]))
        if k % 3 == 1:  # no grid to speak of
            printed = [Word(w.id, w.text, rnd.randint(0, 300), w.top + rnd.randint(0, 30), w.width, w.height) for w in printed]
        if k % 4 == 2:
            grid = [[v if rnd.random() > 0.25 else rnd.choice(["", "-", "zz"]) for v in row] for row in grid]
        if k % 5 == 3:
            grid = [row[: rnd.randint(1, len(row))] for row in grid]
        if k % 6 == 4:
            rnd.shuffle(grid)
        printed = [w for w in printed if rnd.random() > 0.1]
        if k % 7 == 5:
            rnd.shuffle(printed)
        pages.append((grid, printed))
    found = same_as_one_at_a_time(spark, pages, height)
    assert {s for s, _ in found.values()} == {"matched", "multi_word", "fuzzy", "unmatched", "empty"}


def test_best_run(spark):
    from pyspark.sql import functions as F

    rnd, rows = random.Random(3), []
    text = lambda most: "".join(rnd.choices("ab1", k=rnd.randint(0, most)))
    for _ in range(400):
        norms = [text(4) for _ in range(rnd.randint(0, 7))]
        k = rnd.randint(0, len(norms))
        rows.append((rnd.choice(["".join(norms[k : k + 3]), text(9)]) or "a", norms))
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, wanted string, norms array<string>").select("i", best_run(F.col("wanted"), F.col("norms")).alias("b")).collect()
    got = {r["i"]: r["b"] for r in got}
    hits = 0
    for i, (wanted, norms) in enumerate(rows):
        page = PlainPage([[wanted]], [Word(str(k), t, 0, 0, 1, 1) for k, t in enumerate(norms)], None)
        want = page.best_run(wanted, np.arange(len(norms)))
        if want is None:
            assert got[i] is None or got[i]["like"] is None
        else:
            hits += 1
            assert (list(range(got[i]["first"], got[i]["after"])), got[i]["like"]) == want
    assert hits > 100
