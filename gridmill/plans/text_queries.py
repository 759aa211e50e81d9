"""Text, search and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import misc as M
from gridmill.functions import text as T
from gridmill.operators import export as X
from gridmill.plans import synth
from gridmill.plans.registry import Registry, table

query = Registry()

LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


@query("select p_partkey, regexp_replace(lower(p_name || ' / ' || p_brand || ' é'), '[^a-z0-9]', '', 'g') as normal from part")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize(F.concat("p_name", F.lit(" / "), "p_brand", F.lit(" é"))).alias("normal"))


@query("""select s_suppkey, levenshtein(s_name, 'Supplier#' || s_nationkey) as distance,
  round(1.0::double - levenshtein(s_name, 'Supplier#' || s_nationkey)::double / greatest(length(s_name), length('Supplier#' || s_nationkey)), 9) as likeness from supplier""")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("s_name"), F.concat(F.lit("Supplier#"), F.col("s_nationkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.levenshtein(a, b).alias("distance"), F.round(T.similarity(a, b), 9).alias("likeness"))


@query(f"select doc_id, array_to_string({LINES}, chr(10)) as compact from documents")
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.compact(F.col("text")).alias("compact"))


@query(f"""select doc_id, array_to_string(case when len(taken) < len(ls) then list_append(taken, '{T.EXCERPT_MARK}') else taken end, chr(10)) as excerpt from (
  select doc_id, ls, list_transform(list_filter(range(1, len(ls) + 1), lambda i: i <= 12 and 900 - used[i] > 0), lambda i: substr(ls[i], 1, (900 - used[i])::bigint)) as taken
  from (select doc_id, ls, list_transform(range(1, len(ls) + 1), lambda i: coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0)) as used from (select doc_id, {LINES} as ls from documents)))""")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 12, 900).alias("excerpt"))


@query("""select doc_id, cast(ceil(length(text) / 4.0) as bigint) as tokens, 1024 + cast(ceil(length(text) / 4.0) as bigint) as prompt_tokens,
  greatest(0, 8192 - 1024 - cast(ceil(length(text) / 4.0) as bigint)) as available_tokens, greatest(0, 8192 - 1024 - cast(ceil(length(text) / 4.0) as bigint)) < 256 as overflow from documents""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), T.budget(F.col("text")).alias("b")).select("doc_id", "tokens", "b.*")


@query("""select doc_id, greatest(256, least(case when doc_id % 3 = 0 then a else greatest(256, w * 4) end, a)) as target
  from (select doc_id, greatest(0, 7168 - cast(ceil(length(text) / 4.0) as bigint)) as a, len(string_split(text, ' ')) as w from documents)""")
def output_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.split("text", " ")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", T.output_target(words, T.budget(F.col("text"))["available_tokens"], F.col("doc_id") % 3 == 0).alias("target"))


@query("""select p_partkey, p_name, case when strpos(lower(text), lower(p_name)) > 0 then strpos(text, p_name) - 1 else -1 end as char_start from (
  select p_partkey, p_name, 'Item ' || p_brand || ': ' || p_name || ', ' || p_type as text from part)""")
def span_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of a value's first place in its source; -1 where it isn't found."""
    text = F.concat(F.lit("Item "), "p_brand", F.lit(": "), "p_name", F.lit(", "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", T.char_start(text, F.col("p_name")).alias("char_start"))


# -- export -----------------------------------------------------------------

FORMULA = "case when s_name_ like '=%' or s_name_ like '+%' or s_name_ like '-%' or s_name_ like '@%' then 1 else 0 end"
ODD_CELLS = """, odd as (
  select doc_id, page_index, row_index, col_index, case (doc_id + row_index * 3 + col_index) % 8 when 0 then '=' || value when 1 then value || ', "x"' when 2 then '-' || value when 3 then value || '|y' when 4 then '<' || value || '>&' else value end as value from grid
)
"""
CSV_CELL = """case when regexp_matches(v, '[,"\\r\\n]') then '"' || replace(v, '"', '""') || '"' else v end"""
GUARDED = """case when regexp_matches(value, '^[=+@\\t\\r-]') and not regexp_matches(value, '^[+-]?[$€£¥]?\\d[\\d,\\s]*(\\.\\d+)?([eE][+-]?\\d+)?%?$') then '''' || value else value end"""


def odd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.grid(spark, sf_dir).withColumn("value", F.expr("""case (doc_id + row_index * 3 + col_index) % 8 when 0 then concat('=', value) when 1 then concat(value, ', "x"') when 2 then concat('-', value) when 3 then concat(value, '|y') when 4 then concat('<', value, '>&') else value end"""))


def page_sql(cell: str, tab: str, line: str, name: str) -> str:
    return synth.SQL.rstrip() + ODD_CELLS + f"select doc_id, page_index, string_agg(l, {line} order by row_index) as {name} from (select doc_id, page_index, row_index, string_agg({cell}, {tab} order by col_index) as l from (select *, value as v from odd) group by all) group by all"


@query(page_sql(CSV_CELL, "','", "chr(13) || chr(10)", "csv"))
def csv_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.csv(odd_cells(spark, sf_dir))


@query(page_sql(CSV_CELL, "','", "chr(13) || chr(10)", "csv").replace("select *, value as v", f"select *, {GUARDED} as v"))
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.csv_for_export(odd_cells(spark, sf_dir))


@query(page_sql("v", "chr(9)", "chr(10)", "txt"))
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.plain_text(odd_cells(spark, sf_dir))


@query(page_sql("""case when regexp_matches(v, '[\\t"\\r\\n]') then '"' || replace(v, '"', '""') || '"' else v end""", "chr(9)", "chr(10)", "tsv"))
def clipboard_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.clipboard(odd_cells(spark, sf_dir))


ESC = """replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


@query(
    synth.SQL.rstrip() + ODD_CELLS + f"""select doc_id, page_index, '{X.HTML_HEAD}' || '  <thead>' || chr(10) || max(case when row_index = 0 then l end) || chr(10) || '  </thead>' || chr(10) || '  <tbody>' || chr(10)
  || string_agg(case when row_index > 0 then l end, chr(10) order by row_index) || chr(10) || '  </tbody>' || '{X.HTML_FOOT}' as html
  from (select doc_id, page_index, row_index, '    <tr>' || string_agg(case when row_index = 0 then '<th>' || {ESC} || '</th>' else '<td>' || {ESC} || '</td>' end, '' order by col_index) || '</tr>' as l from odd group by all) group by all"""
)
def html_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.html(odd_cells(spark, sf_dir))


@query(
    synth.SQL.rstrip() + ODD_CELLS.rstrip() + r""", esc as (select doc_id, page_index, row_index, col_index, replace(replace(value, '\', '\\'), '|', '\|') as v from odd
), sized as (select *, greatest(3, max(length(v)) over (partition by doc_id, page_index, col_index)) as w from esc
), md as (select doc_id, page_index, row_index::double as r, col_index, v || repeat(' ', (w - length(v))::int) as c from sized union all select doc_id, page_index, 0.5, col_index, repeat('-', w::int) from sized where row_index = 0)
select doc_id, page_index, string_agg('| ' || l || ' |', chr(10) order by r) as md from (select doc_id, page_index, r, string_agg(c, ' | ' order by col_index) as l from md group by all) group by all"""
)
def md_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.markdown(odd_cells(spark, sf_dir))


@query(f"select n, value, {GUARDED} as guarded from (select row_number() over (order by p_partkey) as n, ['=', '-', '+', '@', '-$', '', '('][p_partkey % 7 + 1] || case when p_partkey % 2 = 0 then p_name else floor(p_retailprice)::bigint::varchar || case when p_partkey % 3 = 0 then '%' else '' end end as value from part)")
def formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, ["=", "-", "+", "@", "-$", "", "("])), (F.col("p_partkey") % 7 + 1).cast("int"))
    tail = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.floor("p_retailprice").cast("long").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "%").otherwise("")))
    value = F.concat(head, tail)
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("n"), value.alias("value")).withColumn("guarded", T.guard_formula(F.col("value")))


@query(r"""select page_id, case when s = '' then 'extraction' else s end || case when page_id % 3 + 1 > 1 then '_p' || (page_id % 2 + 1) else '' end || '_extract' as stem
  from (select page_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '\.[^.]+$', ''), '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 50) as s from pages)""")
def file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.file_stem(F.col("url"), F.col("page_id") % 2, F.col("page_id") % 3 + 1).alias("stem"))


@query("with recursive r as (select p_partkey, n, '' as label from part, (select unnest([p_partkey, p_partkey * 1000003]) as n) union all select p_partkey, n // 26 - 1, chr((65 + n % 26)::int) || label from r where n >= 0) select p_partkey, label from r where n < 0")
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of small numbers, and of some with many letters."""
    numbers = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array("p_partkey", F.col("p_partkey") * 1000003)).alias("n"))
    return numbers.select("p_partkey", T.column_label(F.col("n")).alias("label"))


# -- helpers ----------------------------------------------------------------


@query("""select s_suppkey, case when v = 'nvidia' and (m is null or m >= 4096) then 'cuda' when v = 'amd' and o = 'linux' then 'rocm' when v = 'apple' then 'metal' else 'cpu' end as backend from (
  select s_suppkey, ['nvidia', 'amd', 'apple', 'intel'][s_nationkey % 4 + 1] as v, case when s_suppkey % 5 <> 0 then s_suppkey * 1024 % 9000 end as m, case when s_suppkey % 2 = 0 then 'linux' else 'windows' end as o from supplier)""")
def recommend_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendor = F.element_at(F.array(*map(F.lit, ["nvidia", "amd", "apple", "intel"])), F.col("s_nationkey") % 4 + 1)
    memory = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") * 1024 % 9000)
    return table(spark, sf_dir, "supplier").select("s_suppkey", M.recommended_backend(vendor, memory, F.when(F.col("s_suppkey") % 2 == 0, "linux").otherwise("windows")).alias("backend"))


@query("select o_orderkey, case when n < 1000 then n || ' B' when n < 1000000 then printf('%.1f KB', n / 1000.0) else printf('%.1f MB', n / 1000000.0) end as shown from (select o_orderkey, (o_orderkey * 100 + 37) as n from orders)")
def shown_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.replace(M.shown_bytes(F.col("o_orderkey") * 100 + 37), F.lit(","), F.lit("")).alias("shown"))


@query("select o_orderkey, case when s < 60 then s || ' s' when ceil(s / 60.0) < 60 then ceil(s / 60.0)::bigint || ' min' else ceil(s / 60.0)::bigint // 60 || ' h ' || ceil(s / 60.0)::bigint % 60 || ' min' end as eta from (select o_orderkey, o_orderkey * 7 % 20000 as s from orders)")
def shown_etas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", M.shown_eta(F.col("o_orderkey") * 7 % 20000).alias("eta"))


@query(synth.SQL + """select doc_id, word_id, case when w > 5 and h > 5 then cast(round(least("left", 200)) as int) end as box_left, case when w > 5 and h > 5 then cast(round(w) as int) end as box_width
  from (select *, abs("left" - 200) as w, abs(top - 140) as h from words)""")
def drawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = M.drawn_box(F.col("left"), F.col("top"), F.lit(200.0), F.lit(140.0))
    return synth.words(spark, sf_dir).select("doc_id", "word_id", box.alias("b")).select("doc_id", "word_id", F.col("b.left").alias("box_left"), F.col("b.width").alias("box_width"))


@query("select doc_id, substr(text, 1, s) as before, substr(text, s + 1, 10) as match from (select doc_id, text, (doc_id % 40)::int as s from documents) where length(text) >= s + 10 union all select doc_id, text, '' from documents where length(text) < doc_id % 40 + 10")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("doc_id") % 40).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", M.highlighted(F.col("text"), start, start + 10).alias("h")).select("doc_id", "h.before", "h.match")


@query("select doc_id, sha256(text) as digest, doc_id % 2 = 0 as matches from documents")
def verified_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("text").cast("binary"), 256)
    given = F.when(F.col("doc_id") % 2 == 0, F.upper(digest)).otherwise(F.lit("00"))
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"), M.digest_matches(F.col("text").cast("binary"), given).alias("matches"))
