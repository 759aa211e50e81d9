"""Parsing, matching and scoring queries over the made pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.operators import layout as L
from gridmill.operators import match as M
from gridmill.operators import pagejoins as J
from gridmill.operators import parse as P
from gridmill.operators import score as S
from gridmill.plans import synth
from gridmill.plans.layout_queries import LINED
from gridmill.plans.registry import Registry, table

query = Registry()

RANGES = """, sized as (select *, sum(length(value) + 1) over (partition by doc_id, page_index order by row_index, col_index) - length(value) - 1 as range_start from model
), parsed as (select doc_id, page_index, row_index, col_index, value, cast(range_start as int) as range_start, cast(range_start + length(value) as int) as range_end from sized)
"""
OFFSETS = """, offs as (select *, cast(coalesce(sum(length(token)) over (partition by doc_id, page_index order by seq rows between unbounded preceding and 1 preceding), 0) as int) as char_offset from tokens)
"""
CREDITED = """, met as (select t.doc_id, t.page_index, seq, token, logprob, char_offset as t0, row_index, col_index, range_start, least(char_offset + length(token), range_end) - greatest(char_offset, range_start) as overlap
  from offs t join parsed p on p.doc_id = t.doc_id and p.page_index = t.page_index and char_offset < range_end and char_offset + length(token) > range_start
), credited as (select * from (select *, row_number() over (partition by doc_id, page_index, seq order by overlap desc, row_index, col_index) as n from met) where n = 1)
"""
IDS = """, ids as (select doc_id, page_index, row_index, col_index, value, range_start, range_end, case when value = '' and (doc_id + row_index) % 3 > 0 then '' else list_transform(range(len(string_split(g, ' '))), lambda k: concat_ws('-', doc_id, row_index, col_index, k)) end as word_ids
  from (select p.*, g.value as g from parsed p join grid g using (doc_id, page_index, row_index, col_index)))
"""
#: Matches by construction: each cell has the words that it was printed with.
GIVEN = """, cells as (select p.*, g.value as printed, case when p.value = '' then 'empty' when (p.doc_id + p.row_index + p.col_index) % 9 = 0 then 'fuzzy' when (p.doc_id + p.row_index * 2 + p.col_index) % 11 = 0 then 'unmatched' when strpos(g.value, ' ') > 0 then 'multi_word' else 'matched' end as match_status
  from parsed p join grid g using (doc_id, page_index, row_index, col_index)
), cell_words as (select doc_id, page_index, row_index, col_index, unnest(list_transform(range(len(string_split(printed, ' '))), lambda k: concat_ws('-', doc_id, row_index, col_index, k))) as word_id from cells where match_status <> 'unmatched' and (match_status <> 'empty' or (doc_id + row_index) % 3 = 0)
)"""
#: The match itself, on pages whose columns and lines are so far apart that a cell can only have words of its own place: the
#: best run of these, and for a blank cell what stands in the region that its row and column span.
FOUND = """, place as (select doc_id, page_index, row_index, col_index, concat_ws('-', doc_id, row_index, col_index, k) as word_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as n, "left" + width / 2 as cx, top + 6 as cy, "left" as x0, "left" + width as x1, top as y0, top + 12 as y1,
    row_number() over (partition by doc_id, page_index, row_index, col_index order by k) as pos from body where row_index >= 0
), want as (select *, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') as v from parsed
), tried as (select a.doc_id, a.page_index, a.row_index, a.col_index, a.pos as i, b.pos as j, string_agg(m.n, '' order by m.pos) as t
  from place a join place b using (doc_id, page_index, row_index, col_index) join place m using (doc_id, page_index, row_index, col_index) where a.pos <= b.pos and m.pos between a.pos and b.pos group by all
), alike as (select tried.*, case when t = v then 1.0::double else 1.0::double - levenshtein(t, v)::double / greatest(length(t), length(v)) end as likeness from tried join want using (doc_id, page_index, row_index, col_index) where t <> '' and v <> ''
), best as (select * from (select *, row_number() over (partition by doc_id, page_index, row_index, col_index order by likeness desc, i, j) as nth from alike where likeness >= 0.8::double) where nth = 1
), cells as (select w.*, case when v = '' then 'empty' when likeness is null then 'unmatched' when likeness < 1 then 'fuzzy' when i < j then 'multi_word' else 'matched' end as match_status from want w left join best using (doc_id, page_index, row_index, col_index)
), placed as (select p.* from place p join best b using (doc_id, page_index, row_index, col_index) where pos between i and j
), across as (select doc_id, page_index, col_index, min(x0) as x0, max(x1) as x1 from placed group by all
), down as (select doc_id, page_index, row_index, min(y0) as y0, max(y1) as y1 from placed group by all
), there as (select p.* from place p join want w using (doc_id, page_index, row_index, col_index) join across a using (doc_id, page_index, col_index) join down d using (doc_id, page_index, row_index) where v = '' and cx between a.x0 and a.x1 and cy between d.y0 and d.y1
), cell_words as (select doc_id, page_index, row_index, col_index, word_id, pos from placed union all
  select doc_id, page_index, row_index, col_index, word_id, pos from (select *, sum(length(n)) over (partition by doc_id, page_index, row_index, col_index) as chars from there) where chars >= 2
), said as (select doc_id, page_index, row_index, col_index, value, match_status, coalesce(ids, '') as word_ids from cells left join (select doc_id, page_index, row_index, col_index, string_agg(word_id, ' ' order by pos) as ids from cell_words group by all) using (doc_id, page_index, row_index, col_index)
)"""
STATUS = """, ocrs as (select c.doc_id, c.page_index, row_index, col_index, avg(confidence) as ocr from cell_words c join words w on w.doc_id = c.doc_id and w.word_id = c.word_id group by all
), has as (select distinct doc_id, page_index, row_index, col_index, true as held from cell_words
), llms as (select doc_id, page_index, row_index, col_index, exp(avg(logprob)) as llm_mean, exp(min(logprob)) as llm_min from credited where t0 >= range_start and logprob is not null group by all
), full0 as (select c.*, case when match_status <> 'empty' then ocr end as ocr, case when match_status <> 'empty' then llm_mean end as llm_mean, case when match_status <> 'empty' then llm_min end as llm_min,
    case when match_status = 'unmatched' then 'image_only' when match_status = 'empty' and held then 'disagree' else 'agree' end as agreement
  from cells c left join ocrs using (doc_id, page_index, row_index, col_index) left join llms using (doc_id, page_index, row_index, col_index) left join has using (doc_id, page_index, row_index, col_index)
), level as (select *, coalesce(ocr, 0.0::double) / 100 as o, 0.4::double * llm_mean + 0.6::double * (coalesce(ocr, 0.0::double) / 100) as blend from full0
), trusted as (select *, case when agreement = 'disagree' then 'low' when match_status = 'empty' then 'high' when agreement = 'image_only' then case when llm_mean >= 0.85::double then 'medium' else 'low' end
    when llm_mean is null then case when o >= 0.85::double then 'high' when o >= 0.65::double then 'medium' else 'low' end
    when blend >= 0.85::double and llm_min >= 0.5::double then 'high' when blend >= 0.65::double then 'medium' else 'low' end as t from level
), scored as (select *, case when match_status = 'fuzzy' then case when t = 'high' then 'medium' else 'low' end else t end as trust from trusted)
"""
PARSED = synth.SQL.rstrip() + RANGES.rstrip() + OFFSETS.rstrip() + CREDITED.rstrip()
SCORED = PARSED + GIVEN + STATUS


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parsed_tsv(synth.raw_output(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r, c, v = (F.col(x) for x in ("doc_id", "row_index", "col_index", "value"))
    grid = synth.grid(spark, sf_dir).withColumnRenamed("value", "printed")
    status = F.when(v == "", "empty").when((d + r + c) % 9 == 0, "fuzzy").when((d + r * 2 + c) % 11 == 0, "unmatched").when(F.col("printed").contains(" "), "multi_word").otherwise("matched")
    ids = F.transform(F.sequence(F.lit(0), F.size(F.split("printed", " ")) - 1), lambda k: F.concat_ws("-", d, r, c, k))
    full = parsed(spark, sf_dir).hint("merge").join(grid, S.CELL).withColumn("match_status", status)
    return full.withColumn("word_ids", F.when((F.col("match_status") == "unmatched") | ((F.col("match_status") == "empty") & ((d + r) % 3 != 0)), F.array().cast("array<string>")).otherwise(ids)).drop("printed")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored(cells(spark, sf_dir), P.token_offsets(synth.tokens(spark, sf_dir)), synth.words(spark, sf_dir)).withColumn("verified", F.col("row_index") == 3)


@query(synth.SQL.rstrip() + RANGES + "select * from parsed")
def tsv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir)


@query(synth.SQL.rstrip() + OFFSETS + "select doc_id, page_index, seq, token, round(logprob, 6) as logprob, char_offset from offs")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.token_offsets(synth.tokens(spark, sf_dir)).withColumn("logprob", F.round("logprob", 6))


@query(synth.SQL.rstrip() + RANGES.rstrip() + OFFSETS.rstrip() + CREDITED + "select doc_id, page_index, seq, row_index, col_index, cast(overlap as int) as overlap from credited")
def token_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tokens_of_cells(P.token_offsets(synth.tokens(spark, sf_dir)), parsed(spark, sf_dir)).select("doc_id", "page_index", "seq", "row_index", "col_index", "overlap")


@query(SCORED + "select doc_id, page_index, row_index, col_index, round(llm_mean, 9) as llm_mean, round(llm_min, 9) as llm_min from llms")
def llm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.llm_scores(S.tokens_of_cells(P.token_offsets(synth.tokens(spark, sf_dir)), parsed(spark, sf_dir)))
    return found.select(*S.CELL, F.round("llm_mean", 9).alias("llm_mean"), F.round("llm_min", 9).alias("llm_min"))


@query(SCORED + "select doc_id, page_index, row_index, col_index, round(ocr, 6) as ocr from ocrs")
def ocr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ocr_scores(cells(spark, sf_dir), synth.words(spark, sf_dir)).withColumn("ocr", F.round("ocr", 6))


@query(SCORED + "select doc_id, page_index, row_index, col_index, match_status, agreement, trust from scored")
def trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(*S.CELL, "match_status", "agreement", "trust")


@query(SCORED + """select doc_id, page_index, row_index, col_index, coalesce(lead(row_index || ':' || col_index) over w, first(row_index || ':' || col_index) over f) as next, coalesce(lag(row_index || ':' || col_index) over w, last(row_index || ':' || col_index) over f) as previous
  from scored where row_index <> 3 and trust <> 'high' window w as (partition by doc_id, page_index order by row_index, col_index), f as (partition by doc_id, page_index order by row_index, col_index rows between unbounded preceding and unbounded following)""")
def review_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.concat_ws(":", f"{c}.row_index", f"{c}.col_index").alias(c)
    return S.worklist(scored(spark, sf_dir)).select(*S.CELL, at("next"), at("previous"))


@query(SCORED + """select doc_id, page_index, row_index, col_index, case when row_index = 3 then 'high' when agreement = 'disagree' then 'low' when match_status = 'empty' then 'neutral' when agreement = 'image_only' then 'image_only' else trust end as shown,
  case when row_index = 3 then '✓' when agreement = 'disagree' then '!' when agreement = 'image_only' then '?' when match_status = 'fuzzy' then '≈' when trust = 'low' then '!' else '' end as badge from scored""")
def display_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.functions.misc import badge

    c = {x: F.col(x) for x in ("verified", "match_status", "word_ids", "value", "agreement", "trust")}
    shown = S.display_class(c["verified"], c["match_status"], c["word_ids"], c["value"], c["agreement"], c["trust"])
    return scored(spark, sf_dir).select(*S.CELL, shown.alias("shown"), badge(c["verified"], c["match_status"], S.overlooked(c["match_status"], c["word_ids"]), c["agreement"], c["trust"]).alias("badge"))


@query(SCORED + "select doc_id, page_index, row_index, col_index, 'Trust: ' || trust || '; model: ' || case when llm_mean is null then 'not scored' else cast(round(llm_mean * 100) as int) || '%' end || '; OCR: ' || case when ocr is null then 'N/A' else cast(round(ocr) as int) || '%' end as tip from scored")
def tooltips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(*S.CELL, S.tooltip(F.col("trust"), F.col("llm_mean"), F.col("ocr")).alias("tip"))


@query(synth.SQL + "select doc_id, page_index, count(logprob) as with_logprob, count(*) - count(logprob) as without_logprob, round(avg(logprob), 9) as mean, round(min(logprob), 9) as least, round(max(logprob), 9) as greatest, case when count(logprob) = count(*) then 'PASS' when count(logprob) > 0 then 'PARTIAL' else 'FAIL' end as verdict from tokens group by all")
def logprob_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.logprob_summary(synth.tokens(spark, sf_dir), P.KEY)
    return found.withColumns({c: F.round(c, 9) for c in ("mean", "least", "greatest")})


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each page as an event stream: a line a token, some without log-probability, an end and junk."""
    t = synth.tokens(spark, sf_dir)
    delta = F.struct(F.struct(F.col("token").alias("content")).alias("delta"))
    listed = F.struct(F.struct(F.array(F.struct("token", "logprob")).alias("content")).alias("logprobs"))
    body = F.when(F.col("logprob").isNull(), F.to_json(F.struct(F.array(delta).alias("choices")))).otherwise(F.to_json(F.struct(F.array(listed).alias("choices"))))
    lines = t.select(F.col("doc_id").alias("request_id"), (F.col("seq") + 1).alias("line_no"), F.concat(F.lit("data: "), body).alias("line"))
    ids = t.select(F.col("doc_id").alias("request_id")).distinct()
    ends = ids.select("request_id", F.lit(1 << 20).alias("line_no"), F.when(F.col("request_id") % 4 == 0, 'data: {"choices":[{"delta":{},"finish_reason":"length"}]}').otherwise('data: {"choices":[{"delta":{},"finish_reason":"stop"}]}').alias("line"))
    junk = ids.select("request_id", F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.lit(": ping").alias("line")), F.struct(F.lit(1 << 21).alias("line_no"), F.lit("data: [DONE]").alias("line")), F.struct(F.lit((1 << 21) + 1).alias("line_no"), F.lit("data: {broken").alias("line")))).alias("j")).select("request_id", "j.line_no", "j.line")
    return lines.unionAll(ends).unionAll(junk)


@query(synth.SQL.rstrip() + OFFSETS + "select doc_id as request_id, seq, token, round(logprob, 6) as logprob, char_offset from offs")
def stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stream_tokens(stream_lines(spark, sf_dir)).withColumn("logprob", F.round("logprob", 6))


@query(synth.SQL + "select distinct doc_id as request_id, case when doc_id % 4 = 0 then 'length' else 'stop' end as finish_reason, doc_id % 4 = 0 as truncated from tokens")
def stream_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stream_ends(stream_lines(spark, sf_dir))


@query("""select conv_id, turn, case when role = 'assistant' then 'assistant' else 'user' end as role, case when n = 0 and t <> '' then t when n = 0 then '[]' else
    '[' || array_to_string(list_transform(range(n), lambda i: '{"type":"image_url","image_url":{"url":"data:image/png;base64,' || base64(encode('img' || conv_id || '-' || i)) || '"}}') || case when t = '' then []::varchar[] else ['{"type":"text","text":"' || t || '"}'] end, ',') || ']' end as content
  from (select *, conv_id % 3 as n, case when (conv_id + turn) % 5 = 0 then '' else regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g') end as t from conversations)""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with none, one and two images, some without text."""
    c, t = table(spark, sf_dir, "conversations"), (F.col("conv_id") + F.col("turn")) % 5
    images = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (F.col("conv_id") % 3).cast("int")), lambda i: F.struct(F.lit("image/png").alias("type"), F.base64(F.concat(F.lit("img"), "conv_id", F.lit("-"), i).cast("binary")).alias("data")))
    return P.chat_messages(c.withColumns({"attachments": images, "text": F.when(t == 0, "").otherwise(F.regexp_replace("text", "[^A-Za-z0-9 .,]", ""))}))


@query("""with found as (select page_id, regexp_extract(html, '<div class="([^"]*)"', 1) as label, regexp_extract(html, '(?s)<div[^>]*>(.*?)</div>', 1) as body from pages where regexp_matches(html, '(?s)<div[^>]*>.*?</div>')
), made as (select page_id, 0 as block_no, label, null as bbox, body from found union all select page_id, 1, 'outer', '10|20|30|' || (page_id % 90 + 40) || '', '<b>' || label || '</b> in ' from found
  union all select page_id, 2, '', null, 'page ' || page_id from found
) select page_id, block_no, label, bbox, trim(regexp_replace(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\\s+', ' ', 'g')) as text from made""")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's first div, its class as its label; then one with a box and two divs in it, a closing tag too many, one without a label whose box is not four plain numbers, and one that is never closed."""
    label = F.regexp_extract("html", '<div class="([^"]*)"', 1)
    first = F.regexp_replace(F.regexp_extract("html", r"(?s)(<div[^>]*>.*?</div>)", 1), '<div class="', '<div data-label="')
    nested = F.concat(F.lit('<DIV data-label="outer" data-bbox="10 20 30 '), F.col("page_id") % 90 + 40, F.lit('"><div><b>'), label, F.lit("</b></div> in <div></div></DIV></div>"))
    rest = F.concat(F.lit('<div class="other" data-bbox="[1, 2, 3, 4]">page&nbsp;'), "page_id", F.lit("</div><div class='open'><div>never"))
    pages = table(spark, sf_dir, "pages").filter(first != "").select("page_id", F.concat(first, nested, rest).alias("html"))
    whole = lambda x: x.cast("int").cast("string")
    return P.blocks(pages).select("page_id", "block_no", "label", F.array_join(F.transform("bbox", whole), "|").alias("bbox"), "text")


DIALECT = """select p_partkey, string_agg(f, '|' order by i) as fields from (select p_partkey, unnest([{fields}]) as f, unnest([1, 2, 3, 4]) as i from part) group by p_partkey"""


@query(DIALECT.format(fields="p_name, 'a,' || p_brand, 'say \"' || p_type || '\"', 'two' || chr(10) || 'lines'") + " union all select p_partkey, p_brand || '|' from part")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fenced table with quotes, a comma, doubled quotes, a line break in quotes, blank rows and a field after the last comma."""
    raw = F.concat(F.lit("```csv\n  "), "p_name", F.lit(' ,"a,'), "p_brand", F.lit('","say ""'), "p_type", F.lit('""","two\nlines"\r\n\n   \n'), "p_brand", F.lit(",\n```  \n"))
    found = P.parsed_rows(table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw", "csv")
    return found.select("p_partkey", F.explode("rows").alias("row")).select("p_partkey", F.array_join("row", "|").alias("fields"))


@query(DIALECT.format(fields="' ' || p_name, 'a' || chr(9) || p_brand, 'in \"' || p_type || '\"', 'say \"x\"'") + " union all select p_partkey, p_brand || '|' from part")
def clipboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs in quotes, quotes inside a field, nothing trimmed, and a line end that makes no row."""
    raw = F.concat(F.lit(" "), "p_name", F.lit('\t"a\t'), "p_brand", F.lit('"\tin "'), "p_type", F.lit('"\t"say ""x"""\r\n'), "p_brand", F.lit("\t\n"))
    found = P.parsed_rows(table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw", "clipboard")
    return found.select("p_partkey", F.explode("rows").alias("row")).select("p_partkey", F.array_join("row", "|").alias("fields"))


@query("""select p_partkey as doc_id, 0 as page_index, row_index, col_index, value, cast(s as int) as range_start, cast(s + length(printed) as int) as range_end from (
  select p_partkey, row_index, col_index, trim(printed) as value, printed, lead_ + coalesce(sum(length(printed) + 1) over (partition by p_partkey, row_index order by col_index rows between unbounded preceding and 1 preceding), 0) as s from (
    select p_partkey, 0 as row_index, unnest([0, 1, 2]) as col_index, unnest([p_name, ' ' || p_brand || ' ', '']) as printed, 7 as lead_ from part
    union all select p_partkey, 1, 0, p_type, 7 + length(p_name) + length(p_brand) + 4 + 2 + 3 from part))""")
def ragged_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced output with rows of unlike length, an outer space, a trailing tab, a blank row, and both kinds of line end."""
    raw = F.concat(F.lit("```tsv\n"), "p_name", F.lit("\t "), "p_brand", F.lit(" \t\r\n \t\n"), "p_type", F.lit("\r\n```\n"))
    return P.parsed_tsv(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page_index"), raw.alias("raw")))


@query("select o_orderkey as request_id from orders where o_orderkey % 3 = 0 and o_orderkey % 7 <> 0")
def no_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of requests with and without text and log-probabilities, those with text only."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"))
    text = F.when(F.col("request_id") % 7 == 0, "").otherwise("word")
    return P.no_signal(o.select("request_id", text.alias("token"), F.when((F.col("request_id") % 3 > 0) & (F.col("seq") == 1), -0.5).alias("logprob")))


@query("""select o_orderkey as request_id, case when o_orderkey % 4 in (0, 1) then 'I think ' || o_orderkey else '' end as thinking, case when o_orderkey % 4 in (0, 2) then 'so ' || o_orderkey when o_orderkey % 4 = 3 then '(no answer)' else '' end as content from orders""")
def chat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that reason under each of the three names, say something, both, or neither; with junk between."""
    k = F.col("o_orderkey")
    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    name = F.element_at(F.array(*map(F.lit, ["reasoning", "thinking", "reasoning_content"])), (k % 3 + 1).cast("int"))
    delta = lambda body: F.concat(F.lit('data: {"choices":[{"delta":{'), body, F.lit("}}]}"))
    thought = [F.when(k % 4 < 2, delta(F.concat(quoted(name), F.lit(":"), quoted(x)))).otherwise(": none") for x in (F.lit("  I think "), k.cast("string"))]
    said = [F.when(k % 2 == 0, delta(F.concat(F.lit('"content":'), quoted(x)))).otherwise("data: [DONE]") for x in (F.lit("so "), F.concat(k, F.lit(" ")))]
    lines = F.array(*[F.struct(F.lit(i).alias("line_no"), x.alias("line")) for i, x in enumerate([*thought, F.lit("data: {junk"), *said])])
    return P.chat_split(table(spark, sf_dir, "orders").select(k.alias("request_id"), F.explode(lines).alias("l")).select("request_id", "l.*"))


# -- matching ---------------------------------------------------------------


@query(synth.SQL + """select doc_id, page_index, n as columns from (select doc_id, page_index, n, row_number() over (partition by doc_id, page_index order by count(*) desc, n desc) as nth from (
  select doc_id, page_index, row_index, count(*)::int as n from model where col_index < 5 - (doc_id + row_index * row_index) % 4 group by all) group by doc_id, page_index, n) where nth = 1""")
def expected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages whose rows are of unlike length, some of them as often as others."""
    return M.expected_columns(synth.model_cells(spark, sf_dir).filter("col_index < 5 - (doc_id + row_index * row_index) % 4"))


@query(synth.SQL.rstrip() + ", f as (select doc_id, page_index, col_index, bool_or(regexp_replace(lower(value), '[^a-z0-9]', '', 'g') <> '' and col_index <> doc_id % 7) as has_text from model group by all) select doc_id, page_index, col_index, cast(case when has_text then sum(has_text::int) over (partition by doc_id, page_index order by col_index) - 1 else -1 end as int) as band from f")
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = synth.model_cells(spark, sf_dir).withColumn("value", F.when(F.col("col_index") == F.col("doc_id") % 7, " -").otherwise(F.col("value")))
    return M.bands(some)


SWEEP = (
    LINED.rstrip()
    + """, ends as (select doc_id, page_index, "left" as x, 1 as d from words union all select doc_id, page_index, "left" + width, -1 from words
), folded as (select doc_id, page_index, x, sum(d) as d from ends group by all
), swept as (select *, sum(d) over (partition by doc_id, page_index order by x) as cover, min(x) over (partition by doc_id, page_index) as low, max(x) over (partition by doc_id, page_index) as high, lead(x) over (partition by doc_id, page_index order by x) as xto from folded
), nlines as (select doc_id, page_index, max(line_no) + 1 as n_lines from lined group by all
), tried as (select s.*, k, char_width, case when cover <= k then 1 else 0 end as under from swept s join nlines using (doc_id, page_index) join widths using (doc_id, page_index), (select unnest(range(0, 60)) as k) where k <= greatest(1, floor(n_lines * 0.2))
), begun as (select *, case when under = 1 and coalesce(lag(under) over (partition by doc_id, page_index, k order by x), 0) = 0 then 1 else 0 end as b from tried
), runs0 as (select *, sum(b) over (partition by doc_id, page_index, k order by x) as run from begun
), runs as (select doc_id, page_index, k, low, high, char_width, min(x) as a, max(xto) as z from runs0 where under = 1 group by doc_id, page_index, k, run, low, high, char_width
), good as (select *, count(*) over (partition by doc_id, page_index, k) as n from runs where a > low and z < high and z - a >= greatest(2.0, char_width * 0.5)
), at_k as (select *, min(k) over (partition by doc_id, page_index) as fk from good where n >= 4
), chosen as (select *, row_number() over (partition by doc_id, page_index order by a - z, a) as rk from at_k where k = fk
), seps as (select doc_id, page_index, (a + z) / 2 as s from chosen where rk <= 4)
"""
)


def _separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = synth.words(spark, sf_dir)
    n_lines = L.with_lines(words, synth.HEIGHT).groupBy(*L.KEY).agg((F.max("line_no") + 1).alias("n_lines"))
    return J.separators(words, n_lines, n_lines.select(*L.KEY, F.lit(5).alias("bands")))


@query(SWEEP + "select doc_id, page_index, string_agg(round(s, 3)::varchar, '|' order by s) as separators from seps group by all")
def column_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _separators(spark, sf_dir).select(*L.KEY, F.array_join(F.transform("separators", lambda s: F.round(s, 3).cast("string")), "|").alias("separators"))


@query(SWEEP + """select w.doc_id, w.page_index, word_id, cast(count(case when s < "left" + width / 2 then 1 end) as int) as band from words w join seps using (doc_id, page_index) group by all""")
def word_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.word_bands(synth.words(spark, sf_dir), _separators(spark, sf_dir))


@query(synth.SQL + """select doc_id, page_index, r as region_id, word_id from words, (select unnest([0, 1, 2, 3]) as r) where word_ord % 5 <> 0 and "left" + width / 2 between r * 200 and r * 200 + 150 and top + height / 2 between 110 and 200""")
def region_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = synth.words(spark, sf_dir)
    regions = words.select(*L.KEY).distinct().select(*L.KEY, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("region_id")).select("*", *[x.alias(n) for x, n in ((F.col("region_id") * 200, "x0"), (F.col("region_id") * 200 + 150, "x1"), (F.lit(110), "y0"), (F.lit(200), "y1"))])
    return J.words_in_regions(words, regions, words.filter("word_ord % 5 = 0"))


@query("""with w as (
  select l_orderkey // 2500 as doc_id, l_orderkey * 8 + l_linenumber as word_id, l_partkey * 7 % 2000 + (10 + l_linenumber) / 2 as cx, (l_orderkey * 13 + l_suppkey * 29 + l_linenumber * 101) % 3000 + 6 as cy, l_linenumber as n from lineitem
), r as (select o_orderkey // 2500 as doc_id, o_orderkey as region_id, o_orderkey * 17 % 1900 as x0, o_orderkey * 17 % 1900 + 100 + o_custkey % 100 as x1, o_orderkey * 23 % 2900 as y0, o_orderkey * 23 % 2900 + 60 as y1 from orders where o_orderkey % 50 = 0)
select r.doc_id, 0 as page_index, region_id, word_id from r join w on w.doc_id = r.doc_id and cx between x0 and x1 and cy between y0 and y1 where n <> 3""")
def dense_region_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty regions a page over pages of ten thousand words."""
    at = lambda n: F.expr(n).cast("double")
    words = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 2500").alias("doc_id"), F.lit(0).alias("page_index"), F.expr("l_orderkey * 8 + l_linenumber").alias("word_id"), "l_linenumber",
        at("l_partkey * 7 % 2000").alias("left"), at("(l_orderkey * 13 + l_suppkey * 29 + l_linenumber * 101) % 3000").alias("top"), at("10 + l_linenumber").alias("width"), F.lit(12.0).alias("height"),
    )
    regions = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(
        F.expr("o_orderkey div 2500").alias("doc_id"), F.lit(0).alias("page_index"), F.col("o_orderkey").alias("region_id"),
        at("o_orderkey * 17 % 1900").alias("x0"), at("o_orderkey * 17 % 1900 + 100 + o_custkey % 100").alias("x1"), at("o_orderkey * 23 % 2900").alias("y0"), at("o_orderkey * 23 % 2900 + 60").alias("y1"),
    )
    return J.words_in_regions(words, regions, words.filter("l_linenumber = 3"))


@query(SCORED + "select doc_id, page_index, word_id, min(row_index) as row_index, min(col_index) as col_index from cell_words group by all")
def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cells_of_words(cells(spark, sf_dir))


@query(
    synth.SQL.rstrip()
    + """, c as (select doc_id, page_index, row_index * 5 + col_index as cell_ord, lower(value) as v, (row_index * 5 + col_index)::double / (count(*) over (partition by doc_id, page_index) - 1) as p from model
), w as (select doc_id, page_index, word_ord, word_id, lower(text) as t, word_ord::double / (count(*) over (partition by doc_id, page_index) - 1) as q from words
), s as (select c.*, word_ord, word_id, levenshtein(v, t) + 5 * abs(p - q) as score from c join w using (doc_id, page_index) where v <> '' and levenshtein(v, t) <= greatest(2.0, length(v) * 0.4)
) select doc_id, page_index, cell_ord, word_id from (select *, row_number() over (partition by doc_id, page_index, cell_ord order by score, word_ord) as n from s) where n = 1"""
)
def nearest_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = synth.model_cells(spark, sf_dir).withColumn("ord", F.col("row_index") * 5 + F.col("col_index"))
    return J.nearest_like(model, synth.words(spark, sf_dir).withColumn("ord", F.col("word_ord")))


@query(synth.SQL.rstrip() + RANGES.rstrip() + FOUND + " select * from said")
def match_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = L.sanitized(synth.words(spark, sf_dir), synth.HEIGHT)
    return M.matched(parsed(spark, sf_dir), words, float(synth.HEIGHT)).withColumn("word_ids", F.array_join("word_ids", " "))


@query(PARSED + FOUND + STATUS + "select doc_id, page_index, row_index, col_index, s.value, s.match_status, word_ids, round(llm_mean, 9) as llm_mean, round(llm_min, 9) as llm_min, round(ocr, 6) as ocr, agreement, trust from scored c join said s using (doc_id, page_index, row_index, col_index)")
def provenance_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: parse, match, score."""
    words = L.sanitized(synth.words(spark, sf_dir), synth.HEIGHT)
    full = parsed(spark, sf_dir)
    out = S.scored(M.matched(full, words, float(synth.HEIGHT)), P.token_offsets(synth.tokens(spark, sf_dir)), words, full)
    return out.select(*S.CELL, "value", "match_status", F.array_join("word_ids", " ").alias("word_ids"), F.round("llm_mean", 9).alias("llm_mean"), F.round("llm_min", 9).alias("llm_min"), F.round("ocr", 6).alias("ocr"), "agreement", "trust")


# -- pages without a grid ---------------------------------------------------


def walked_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells and words of pages that no grid helps with: lists of one column, text whose words leave no channel, and tables printed with their columns swapped, whose grid places too little.

    Some words are misread, some are missing, and rules are read as a bar.
    """
    k, kind = F.col("p_partkey"), F.col("kind")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.floor(k / 8).cast("long").alias("doc_id"), F.lit(0).alias("page_index"), (k % 8).cast("int").alias("r"), F.pmod(F.floor(k / 8), F.lit(3)).cast("int").alias("kind"),
        F.slice(F.split("p_name", " "), 1, 2).alias("name"), F.concat("p_brand", F.lit("-"), "p_size").alias("code"),
    )
    both = F.posexplode(F.array(F.array_join("name", " "), "code")).alias("c", "value")
    cells = parts.select("doc_id", "page_index", "r", "kind", both).select(
        "doc_id", "page_index", F.when(kind == 0, 2 * F.col("r") + F.col("c")).otherwise(F.col("r")).alias("row_index"), F.when(kind == 0, 0).otherwise(F.col("c")).alias("col_index"), "value"
    )
    last = F.col("name")[1]
    misread = F.when(k % 7 == 3, F.concat(F.expr("left(name[1], length(name[1]) - 1)"), F.lit("x"))).otherwise(last)
    printed = [F.when((k % 5 == 1) & (kind < 2), "|"), F.col("name")[0], misread, F.when((k % 11 != 5) & (kind < 2), F.col("code"))]
    printed[0] = F.when(kind == 2, F.when(k % 11 != 5, F.col("code"))).otherwise(printed[0])
    slot, size = F.col("slot"), F.length("text")
    words = parts.select("*", F.posexplode(F.array(*printed)).alias("slot", "text")).filter("text is not null")
    left = F.when(kind == 2, F.when(slot == 0, 0).when(slot == 1, 500).otherwise(510 + 10 * F.length(F.col("name")[0]))).when(kind == 1, 10 * slot).otherwise(100 * slot)
    order = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("r", "slot")) - 1
    return cells, words.select(
        "doc_id", "page_index", order.cast("int").alias("word_ord"), F.concat_ws("-", "doc_id", "r", "slot").alias("word_id"), "text", left.cast("double").alias("left"),
        (100 + 20 * F.col("r")).cast("double").alias("top"), F.when(kind == 1, 400).otherwise(10 * size).cast("double").alias("width"), F.lit(12.0).alias("height"),
    )


#: The walk cell by cell, then the gaps cell by cell, each a recursion over all pages at once; then regions, where no two cells of these pages want the same word.
WALKED = """with recursive parts as (
  select p_partkey as p, p_partkey // 8 as doc_id, cast(p_partkey % 8 as int) as r, p_partkey // 8 % 3 as kind, string_split(p_name, ' ')[1] as n1, string_split(p_name, ' ')[2] as n2, p_brand || '-' || p_size as code from part
), printed as (
  select doc_id, r, kind, n1, 0 as slot, case when kind = 2 then case when p % 11 <> 5 then code end when p % 5 = 1 then '|' end as text from parts
  union all select doc_id, r, kind, n1, 1, n1 from parts union all select doc_id, r, kind, n1, 2, case when p % 7 = 3 then substr(n2, 1, length(n2) - 1) || 'x' else n2 end from parts
  union all select doc_id, r, kind, n1, 3, case when p % 11 <> 5 and kind < 2 then code end from parts
), boxed as (
  select *, case when kind = 2 then [0, 500, 510 + 10 * length(n1)][slot + 1] when kind = 1 then 10 * slot else 100 * slot end as x0, case when kind = 1 then 400 else 10 * length(text) end as width, 100 + 20 * r as y0 from printed where text is not null
), w as (
  select doc_id, row_number() over (partition by doc_id order by r, slot) - 1 as ord, concat_ws('-', doc_id, r, slot) as word_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as n, x0, x0 + width as x1, x0 + width / 2 as cx, y0, y0 + 12 as y1, y0 + 6 as cy from boxed
), c as (
  select doc_id, 2 * r + c as k, cast(case when kind = 0 then 2 * r + c else r end as int) as row_index, cast(case when kind = 0 then 0 else c end as int) as col_index, value, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') as v
  from (select doc_id, r, kind, unnest([0, 1]) as c, unnest([n1 || ' ' || n2, code]) as value from parts)
), ends as (select doc_id, row_number() over (partition by doc_id order by k) - 1 as k, row_index, col_index, value, v from c
), total as (select doc_id, count(*) as n_words from w group by all
), runs as (
  select a.doc_id, a.ord as i, b.ord as j, string_agg(m.n, '' order by m.ord) as t from w a join w b on b.doc_id = a.doc_id and b.ord between a.ord and a.ord + 5 join w m on m.doc_id = a.doc_id and m.ord between a.ord and b.ord group by all
), near as (
  select doc_id, k, i, j, case when t = v then 1.0::double else 1.0::double - levenshtein(t, v)::double / greatest(length(t), length(v)) end as likeness from ends join runs using (doc_id) where length(t) * 10 >= length(v) * 7 and length(t) * 7 <= length(v) * 10 and t <> ''
), alike as (select * from near where likeness >= 0.8::double
), walk as (
  select doc_id, -1::bigint as k, 0::bigint as at_, null::bigint as i, null::bigint as j from total
  union all
  select doc_id, k, coalesce(hit % 10000 + 1, at_), hit // 10000, hit % 10000 from (
    select s.doc_id, s.k + 1 as k, s.at_, min(e.i * 10000 + e.j) as hit from walk s join ends using (doc_id) left join alike e on e.doc_id = s.doc_id and e.k = s.k + 1 and e.likeness = 1 and e.i >= s.at_ and e.i < s.at_ + 12 where ends.k = s.k + 1 group by s.doc_id, s.k, s.at_)
), known as (
  select walk.doc_id, k, i, j, coalesce(min(i) over (partition by walk.doc_id order by k rows between 1 following and unbounded following), n_words) as after_ from walk join total using (doc_id) where k >= 0
), filled as (
  select doc_id, -1::bigint as k, -1::bigint as before, null::bigint as i, null::bigint as j, null::double as likeness from total
  union all
  select doc_id, k, coalesce(wj, b.j, before), coalesce(wi, b.i), coalesce(wj, b.j), case when wi is not null then 1.0::double else -b.l end from (
    select s.doc_id, s.k + 1 as k, s.before, o.i as wi, o.j as wj, min(case when e.i is not null then {'l': -e.likeness, 'i': e.i, 'j': e.j} end) as b from filled s join known o on o.doc_id = s.doc_id and o.k = s.k + 1
      left join alike e on e.doc_id = s.doc_id and e.k = s.k + 1 and o.i is null and e.i > s.before and e.j < o.after_ group by s.doc_id, s.k, s.before, o.i, o.j)
), placed as (select f.doc_id, f.k, row_index, col_index, likeness, w.* exclude (doc_id) from filled f join ends e on e.doc_id = f.doc_id and e.k = f.k join w on w.doc_id = f.doc_id and ord between i and j
), down as (select doc_id, row_index, min(y0) as y0, max(y1) as y1 from placed group by all
), across as (select doc_id, col_index, min(x0) as x0, max(x1) as x1 from placed group by all
), there as (
  select e.doc_id, e.k, v, w.ord, n, word_id, row_number() over (partition by e.doc_id, e.k order by w.ord) as pos from ends e join filled f on f.doc_id = e.doc_id and f.k = e.k and f.i is null join down d on d.doc_id = e.doc_id and d.row_index = e.row_index
    join across a on a.doc_id = e.doc_id and a.col_index = e.col_index join w on w.doc_id = e.doc_id and cx between a.x0 and a.x1 and cy between d.y0 and d.y1 where not exists (select 1 from placed p where p.doc_id = w.doc_id and p.ord = w.ord)
), tried as (select a.doc_id, a.k, a.v, a.pos as i, b.pos as j, string_agg(m.n, '' order by m.pos) as t from there a join there b using (doc_id, k) join there m using (doc_id, k) where a.pos <= b.pos and m.pos between a.pos and b.pos group by all
), best as (select *, case when t = v then 1.0::double else 1.0::double - levenshtein(t, v)::double / greatest(length(t), length(v)) end as likeness from tried where t <> '' qualify likeness >= 0.8::double and row_number() over (partition by doc_id, k order by likeness desc, i, j) = 1
), claims as (select doc_id, k, likeness, ord, word_id from placed union all select b.doc_id, b.k, likeness, t.ord, t.word_id from best b join there t on t.doc_id = b.doc_id and t.k = b.k and t.pos between b.i and b.j
), held as (select doc_id, k, min(likeness) as likeness, count(*) as n, string_agg(word_id, ' ' order by ord) as word_ids from claims group by all
)
select e.doc_id, 0 as page_index, row_index, col_index, value, coalesce(word_ids, '') as word_ids, case when n is null then 'unmatched' when likeness < 1 then 'fuzzy' when n = 1 then 'matched' else 'multi_word' end as match_status
  from ends e left join held using (doc_id, k)"""


@query(WALKED)
def walked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching where there is no grid, or one that places under a third of the cells and is given up: reading order, then gaps and regions."""
    cells, words = walked_pages(spark, sf_dir)
    return M.matched(cells, words, float(synth.HEIGHT)).withColumn("word_ids", F.array_join("word_ids", " "))
