from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st

from gridmill.operators import parse as P


def values(raw):
    rows: dict = {}
    for r, _, v, _, _ in P.tsv_cells(raw):
        rows.setdefault(r, []).append(v)
    return list(rows.values())


def test_tsv():
    assert [(s, e) for *_, s, e in P.tsv_cells("AB\tCD")] == [(0, 2), (3, 5)]
    assert values("```tsv\nA\tB\r\n\r\n c \t\r\n```\n") == [["A", "B"], ["c", ""]]
    assert values("a\tb\tc\nd") == [["a", "b", "c"], ["d"]]
    assert values("\t\n \nx") == [["x"]]
    assert values("") == values("```\n```") == []


@given(st.lists(st.lists(st.text("abc 1", min_size=1, max_size=4).filter(lambda s: s == s.strip()), min_size=2, max_size=3), max_size=4))
def test_tsv_round_trip(grid):
    assert values("\n".join("\t".join(r) for r in grid)) == grid


def test_csv():
    assert P.csv_rows('a,"b,c"\n"d ""q""",e') == [["a", "b,c"], ['d "q"', "e"]]
    assert P.csv_rows('"x\ny",2') == [["x\ny", "2"]]
    assert P.csv_rows("```csv\na,b\n```") == [["a", "b"]]
    assert P.csv_rows("a,b\n\n \nc,") == [["a", "b"], ["c", ""]]
    assert P.csv_rows("") == []


def test_clipboard():
    assert P.clipboard_rows('"a\tb"\tc') == [["a\tb", "c"]]
    assert P.clipboard_rows('"say ""hi"""') == [['say "hi"']]
    assert P.clipboard_rows("a\tb\r\nc\t\r\n") == [["a", "b"], ["c", ""]]
    assert P.clipboard_rows('5" pipe') == [['5" pipe']]


def test_divs():
    assert P.top_divs('</div><div a="1">x<div>y</div></div><div>open') == [(' a="1"', "x<div>y</div>")]


def test_blocks_boxes(spark):
    boxes = ["1 2 3 4", " 1.5  -2\n3e1 .5 ", "[1, 2, 3, 4]", "1 x 3 4", "1 2 3", "1 2 3 NaN", "1d 2 3 4", ""]
    html = "".join(f'<div data-label="L{k}" class="c" DATA-BBOX = "{b}"><p>a&nbsp;b</p>\n c</div>' for k, b in enumerate(boxes)) + '<div class="c"></div>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = P.blocks(df).orderBy("block_no").collect()
    assert [r["bbox"] for r in rows] == [[1.0, 2.0, 3.0, 4.0], [1.5, -2.0, 30.0, 0.5], *[None] * 7]
    assert [(r["label"], r["text"]) for r in rows] == [*[(f"L{k}", "a b c") for k in range(8)], ("", "")]
    loose = P.blocks(df, label="class", loose=True).orderBy("block_no").collect()
    assert [r["bbox"] for r in loose[:4]] == [[1.0, 2.0, 3.0, 4.0], [1.5, -2.0, 30.0, 0.5], [1.0, 2.0, 3.0, 4.0], None] and {r["label"] for r in loose} == {"c"}


LINES = ['data: {"choices":[{"logprobs":{"content":[{"token":"He","logprob":-0.1},{"token":"llo","logprob":null},{"token":"","logprob":-1}]}}]}', "noise", "data: {bad", 'data: {"choices":[{"delta":{"content":"!"}}]}', 'data: {"choices":[{"delta":{},"finish_reason":"length"}]}', "data: [DONE]"]


def test_stream(spark):
    lines = spark.createDataFrame([(7, i, x) for i, x in enumerate(LINES)], "request_id long, line_no int, line string")
    assert [(r["token"], r["logprob"], r["char_offset"]) for r in P.stream_tokens(lines).orderBy("seq").collect()] == [("He", -0.1, 0), ("llo", None, 2), ("!", None, 5)]
    assert tuple(P.stream_ends(lines).first()) == (7, "length", True)
    assert P.no_signal(P.stream_tokens(lines)).count() == 0


def test_chat_split(spark):
    say = lambda **d: 'data: {"choices":[{"delta":%s}]}' % __import__("json").dumps(d)
    lines = spark.createDataFrame([(1, 0, say(reasoning_content=" hm")), (1, 1, say(content="yes ")), (2, 0, say(content=""))], "request_id long, line_no int, line string")
    assert {r["request_id"]: (r["thinking"], r["content"]) for r in P.chat_split(lines).collect()} == {1: ("hm", "yes"), 2: ("", "(no answer)")}


def test_messages_with_image(spark):
    image = [("image/png", "eA==")]
    turns = spark.createDataFrame([(1, 0, "user", "hi", None), (1, 1, "user", "look", image), (1, 2, "assistant", "", image), (1, 3, "tool", "", [])], "conv_id long, turn long, role string, text string, attachments array<struct<type:string,data:string>>")
    got = {r["turn"]: (r["role"], r["content"]) for r in P.chat_messages(turns).collect()}
    part = '{"type":"image_url","image_url":{"url":"data:image/png;base64,eA=="}}'
    assert got == {0: ("user", "hi"), 1: ("user", f'[{part},{{"type":"text","text":"look"}}]'), 2: ("assistant", f"[{part}]"), 3: ("user", "[]")}
