"""Layout queries over the made pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import text as T
from gridmill.operators import layout as L
from gridmill.plans import synth
from gridmill.plans.registry import Registry

query = Registry()
H = synth.HEIGHT

LINED = (
    synth.SQL.rstrip()
    + """, gaps as (
  select *, top - lag(top) over (partition by doc_id, page_index order by top, word_ord) as gap from words
), line0 as (
  select *, cast(sum(case when gap > 2.0 then 1 else 0 end) over (partition by doc_id, page_index order by top, word_ord rows unbounded preceding) as int) as line_no from gaps
), lined as (
  select *, cast(row_number() over (partition by doc_id, page_index, line_no order by "left", top, word_ord) - 1 as int) as pos_in_line from line0
), widths as (
  select doc_id, page_index, coalesce(sum(width) / sum(length(text)), 8.0) as char_width from words where length(text) > 0 and width > 0 group by all
), before0 as (
  select l.*, char_width, lag("left" + width) over (partition by l.doc_id, l.page_index, line_no order by pos_in_line) as before from lined l join widths using (doc_id, page_index)
), starts as (
  select * from before0 where before is null or "left" - before > 3 * char_width
), scores as (
  select l.doc_id, l.page_index, l.line_no, (select count(*) from starts a where a.doc_id = l.doc_id and a.page_index = l.page_index and a.line_no = l.line_no
    and exists (select 1 from lined o where o.doc_id = a.doc_id and o.page_index = a.page_index and o.line_no <> a.line_no and abs(o."left" - a."left") <= a.char_width)) as score
  from (select distinct doc_id, page_index, line_no from lined) l
), best as (
  select * from (select *, row_number() over (partition by doc_id, page_index order by score desc, line_no) as n from scores) where n = 1
)
"""
)


@query(LINED + "select doc_id, page_index, word_id, line_no, pos_in_line from lined")
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_lines(synth.words(spark, sf_dir), H).select("doc_id", "page_index", "word_id", "line_no", "pos_in_line")


@query(LINED + "select doc_id, page_index, word_id, cast(row_number() over (partition by doc_id, page_index order by line_no, pos_in_line) - 1 as int) as reading_ord from lined")
def sort_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sorted_words(synth.words(spark, sf_dir), H).select("doc_id", "page_index", "word_id", "reading_ord")


@query(LINED + "select doc_id, page_index, line_no, string_agg(text, '|' order by pos_in_line) as texts, string_agg(word_id, '|' order by pos_in_line) as word_ids from lined group by all")
def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines(synth.words(spark, sf_dir), H).select("doc_id", "page_index", "line_no", F.array_join("texts", "|").alias("texts"), F.array_join("word_ids", "|").alias("word_ids"))


@query(LINED + "select doc_id, page_index, string_agg(line, chr(10) order by line_no) as full_text from (select doc_id, page_index, line_no, string_agg(text, ' ' order by pos_in_line) as line from lined group by all) group by all")
def reading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_text(synth.words(spark, sf_dir), H)


@query(LINED + "select doc_id, page_index, round(char_width, 6) as char_width from widths")
def char_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.char_width(synth.words(spark, sf_dir)).withColumn("char_width", F.round("char_width", 6))


@query(LINED + 'select doc_id, page_index, line_no, pos_in_line, "left" from starts')
def column_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = synth.words(spark, sf_dir)
    lined = L.with_lines(words, H).hint("merge").join(L.char_width(words), L.KEY)
    return L.column_starts(lined, F.col("char_width") * 3).select("doc_id", "page_index", "line_no", "pos_in_line", "left")


@query(LINED + "select doc_id, page_index, line_no, score from best")
def guide_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.guide_line(synth.words(spark, sf_dir), H)


TEXT = (
    LINED.rstrip()
    + """, line_starts as (select s.doc_id, s.page_index, list(s."left" order by s."left") as st from starts s join best b using (doc_id, page_index, line_no) group by all
), put as (
  select l.doc_id, l.page_index, l.line_no, pos_in_line, text, char_width, st, cast(greatest(0, len(list_filter(st, lambda a: a <= "left" + char_width / 2)) - 1) as int) as col
  from lined l join widths using (doc_id, page_index) join line_starts using (doc_id, page_index)
), spaced as (
  select doc_id, page_index, line_no, list_reduce(list_prepend({'t': '', 'c': -1, 'g': 0}, list({'t': text, 'c': col, 'g': cast(round(st[col + 1] / char_width) as int)} order by pos_in_line)),
    lambda acc, w: {'t': acc.t || case when w.c = acc.c then ' ' when acc.t = '' then repeat(' ', w.g) when length(acc.t) >= w.g then ' ' else repeat(' ', cast(w.g - length(acc.t) as int)) end || w.t, 'c': w.c, 'g': w.g}).t as line
  from put group by all
), table_texts as (select doc_id, page_index, string_agg(line, chr(10) order by line_no) as table_text from spaced group by all)
"""
)


@query(TEXT + "select * from table_texts")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_text(synth.words(spark, sf_dir), H)


@query(TEXT + "select doc_id, page_index, 'Format as table.' || chr(10) || chr(10) || table_text as prompt from table_texts")
def extraction_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prompt("Format as table.", L.table_text(synth.words(spark, sf_dir), H))


PIPED = """select doc_id, page_index, cast(row_number() over (partition by doc_id, page_index order by line_no, pos_in_line) - 1 as int) as word_ord, word_id,
  case when trim(regexp_replace(p, '^[|]+|[|]+$', '', 'g')) <> '' then trim(regexp_replace(p, '^[|]+|[|]+$', '', 'g')) else p end as text
  from (select *, case when word_ord % 3 = 0 then '|' || text || '||' when word_ord % 7 = 0 then '|' else text end as p from lined)"""


@query(LINED + PIPED)
def sanitized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = synth.words(spark, sf_dir)
    piped = words.withColumn("text", F.expr("case when word_ord % 3 = 0 then '|' || text || '||' when word_ord % 7 = 0 then '|' else text end"))
    return L.sanitized(piped, H).select("doc_id", "page_index", "word_ord", "word_id", "text")


@query(LINED + 'select doc_id, page_index, line_no, min("left") as "left", min(top) as top, max("left" + width) - min("left") as width, max(top + height) - min(top) as height from lined group by all')
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.union_box(L.with_lines(synth.words(spark, sf_dir), H), [*L.KEY, "line_no"])


@query(
    synth.SQL
    + """select g.doc_id, g.page_index, g.row_index, g.col_index, b."left", b.top, b.width, b.height
  from grid g left join (
    select e.doc_id, e.page_index, e.row_index, e.col_index, min("left") as "left", min(top) as top, max("left" + width) - min("left") as width, max(top + height) - min(top) as height
    from each e left join words w on w.doc_id = e.doc_id and w.word_id = concat_ws('-', e.doc_id, e.row_index, e.col_index, e.k)
    group by all having count(*) = count(w.word_id)
  ) b using (doc_id, page_index, row_index, col_index)"""
)
def source_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the words each cell was printed with; a cell that lost one has none."""
    ids = F.transform(F.sequence(F.lit(0), F.size(F.split("value", " ")) - 1), lambda k: F.concat_ws("-", F.col("doc_id"), F.col("row_index"), F.col("col_index"), k))
    cells = synth.grid(spark, sf_dir).select(*L.KEY, "row_index", "col_index", ids.alias("word_ids"))
    return L.source_boxes(cells, synth.words(spark, sf_dir))


@query(
    synth.SQL.rstrip()
    + """, after as (
  select doc_id, page_index, word_ord, word_id, case when word_ord % 11 = 5 then 'fixed' else text end as text, case when word_ord % 11 = 5 then 100.0 else confidence end as confidence, "left", top from words where word_ord % 11 not in (3, 7)
  union all select distinct doc_id, page_index, 1073741824, 'new', 'added', 100.0, 500.0, 340.0 from words
), gaps as (
  select *, top - lag(top) over (partition by doc_id, page_index order by top, word_ord) as gap from after
), line0 as (
  select *, sum(case when gap > 2.0 then 1 else 0 end) over (partition by doc_id, page_index order by top, word_ord rows unbounded preceding) as line_no from gaps
) select doc_id, page_index, word_id, text, confidence, cast(row_number() over (partition by doc_id, page_index order by line_no, "left", top, word_ord) - 1 as int) as reading_ord from line0"""
)
def edited_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = synth.words(spark, sf_dir)
    kind = F.expr("case word_ord % 11 when 3 then 'delete' when 5 then 'edit' when 7 then 'edit' end")
    text = F.expr("case word_ord % 11 when 5 then ' fixed ' when 7 then '  ' end")
    box = ["left", "top", "width", "height"]
    log = words.select(*L.KEY, "word_id", kind.alias("action"), text.alias("text"), *box).filter("action is not null")
    add = words.select(*L.KEY).distinct().select(*L.KEY, F.lit("new").alias("word_id"), F.lit("add").alias("action"), F.lit("added").alias("text"), *[F.lit(x).alias(n) for x, n in zip((500.0, 340.0, 50.0, 12.0), box, strict=True)])
    return L.edited_words(words, log.unionAll(add), H).select(*L.KEY, "word_id", "text", "confidence", "reading_ord")


@query(synth.SQL + "select doc_id, word_id, greatest(0.0, least(100.0, confidence)) / 100 * 120 as hue, confidence >= 85 as dim from words")
def word_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.overlay(synth.words(spark, sf_dir)).select("doc_id", "word_id", "hue", "dim")


@query(synth.SQL + "select doc_id, word_id, greatest(2.0, (300 + doc_id % 400) * 0.005) as threshold from words")
def line_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.words(spark, sf_dir).select("doc_id", "word_id", L.line_threshold((F.lit(300) + F.col("doc_id") % 400).cast("double")).alias("threshold"))


@query(synth.SQL + "select doc_id, word_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as normal from words")
def normalize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.words(spark, sf_dir).select("doc_id", "word_id", T.normalize(F.col("text")).alias("normal"))
