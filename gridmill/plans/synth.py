"""Pages made from the table ``part``, as there are none with word boxes: eight parts a page, a header row, five columns.

Everything follows from keys by arithmetic, so SQL can make the same pages. Words are dropped, misread and moved a little at
fixed remainders; some pages have a title line; some cells of the model's output are blank though their words are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.plans.registry import table

HEADER = ["Name", "Brand", "Type", "Size", "Price"]
HEIGHT = 400
KEY = ["doc_id", "page_index"]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as printed: doc_id, page_index, row_index, col_index, value."""
    part = table(spark, sf_dir, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    price = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    doc = F.floor(F.col("p_partkey") / 8).cast("long").alias("doc_id")
    rows = part.select(doc, F.lit(0).alias("page_index"), (F.col("p_partkey") % 8 + 1).cast("int").alias("row_index"), F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"), price).alias("v"))
    heads = part.select(doc).distinct().select("doc_id", F.lit(0).alias("page_index"), F.lit(0).alias("row_index"), F.array(*map(F.lit, HEADER)).alias("v"))
    return rows.unionAll(heads).select(*KEY, "row_index", F.posexplode("v").alias("col_index", "value"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned words of the pages: doc_id, page_index, word_ord, word_id, text, confidence, left, top, width, height."""
    d, r, c, k = (F.col(x) for x in ("doc_id", "row_index", "col_index", "k"))
    cut = grid(spark, sf_dir).withColumn("w", F.split("value", " ")).select("*", F.posexplode("w").alias("k", "t"))
    offset = F.when(k > 0, F.length(F.array_join(F.slice("w", F.lit(1), k), " ")) + 1).otherwise(0)
    h = d * 31 + r * 7 + c * 3 + k
    text = F.when(h % 23 == 0, F.concat(F.col("t").substr(F.lit(1), F.length("t") - 1), F.lit("x"))).otherwise(F.col("t"))
    body = cut.filter(h % 17 != 0).select(
        *KEY, r, c, k, text.alias("text"), (40 + (d * 7 + r * 13 + c * 29) % 60).cast("double").alias("confidence"),
        (200 * c + 10 * offset).cast("double").alias("left"), (100 + 20 * r + (d + c) % 2).cast("double").alias("top"), (10 * F.length("t")).cast("double").alias("width"),
    )
    title = cut.filter((r == 0) & (c == 0) & (d % 31 == 0)).select(*KEY, F.lit(-1).alias("row_index"), F.lit(-1).alias("col_index"), k, F.lit("Parts").alias("text"), F.lit(99.0).alias("confidence"), F.lit(0.0).alias("left"), F.lit(60.0).alias("top"), F.lit(50.0).alias("width"))
    order = F.row_number().over(Window.partitionBy(*KEY).orderBy("col_index", "row_index", "k")) - 1
    return body.unionAll(title).select(*KEY, order.cast("int").alias("word_ord"), F.concat_ws("-", d, r, c, k).alias("word_id"), "text", "confidence", "left", "top", "width", F.lit(12.0).alias("height"))


def model_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as the model gave it: some cells blank."""
    blank = (F.col("row_index") > 0) & ((F.col("doc_id") * 13 + F.col("row_index") * 5 + F.col("col_index")) % 29 == 0)
    return grid(spark, sf_dir).withColumn("value", F.when(blank, "").otherwise(F.col("value")))


def raw_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, raw: the model's tab-separated text."""
    row = model_cells(spark, sf_dir).groupBy(*KEY, "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "value"))), lambda x: x["value"]), "\t").alias("line"))
    return row.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]), "\n").alias("raw"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, seq, token, logprob of the same text; in a third of the cells the tab or break is part of the token."""
    d, r, c = (F.col(x) for x in ("doc_id", "row_index", "col_index"))
    lead = F.when((r == 0) & (c == 0), "").when(c == 0, "\n").otherwise("\t")
    fused = (d + r + c) % 3 == 0
    parts = F.when(fused, F.array(F.concat(lead, F.col("value")))).otherwise(F.array(lead, F.col("value")))
    cut = model_cells(spark, sf_dir).select(*KEY, r, c, F.posexplode(parts).alias("k", "token")).filter("token != ''")
    logprob = F.when((d * 5 + r * 3 + c + F.col("k")) % 19 != 0, -((d * 3 + r * 5 + c * 7) % 50) / 100)
    seq = F.row_number().over(Window.partitionBy(*KEY).orderBy("row_index", "col_index", "k")) - 1
    return cut.select(*KEY, seq.cast("int").alias("seq"), "token", logprob.cast("double").alias("logprob"))


SQL = """
with grid as (
  select p_partkey // 8 as doc_id, 0 as page_index, cast(p_partkey % 8 + 1 as int) as row_index, col_index,
    case col_index when 0 then p_name when 1 then p_brand when 2 then p_type when 3 then cast(p_size as varchar)
      else cast(cast(round(p_retailprice * 100) as bigint) // 100 as varchar) || '.' || lpad(cast(cast(round(p_retailprice * 100) as bigint) % 100 as varchar), 2, '0') end as value
  from part, (select unnest([0, 1, 2, 3, 4]) as col_index)
  union all
  select doc_id, 0, 0, col_index, ['Name', 'Brand', 'Type', 'Size', 'Price'][col_index + 1]
  from (select distinct p_partkey // 8 as doc_id from part), (select unnest([0, 1, 2, 3, 4]) as col_index)
), cut as (
  select *, string_split(value, ' ') as w from grid
), each as (
  select doc_id, page_index, row_index, col_index, w, k - 1 as k, w[k] as t from (select *, unnest(generate_series(1, len(w))) as k from cut)
), body as (
  select doc_id, page_index, row_index, col_index, k,
    case when (doc_id * 31 + row_index * 7 + col_index * 3 + k) % 23 = 0 then substr(t, 1, length(t) - 1) || 'x' else t end as text,
    cast(40 + (doc_id * 7 + row_index * 13 + col_index * 29) % 60 as double) as confidence,
    cast(200 * col_index + 10 * (case when k > 0 then length(array_to_string(w[1:k], ' ')) + 1 else 0 end) as double) as "left",
    cast(100 + 20 * row_index + (doc_id + col_index) % 2 as double) as top, cast(10 * length(t) as double) as width
  from each where (doc_id * 31 + row_index * 7 + col_index * 3 + k) % 17 <> 0
  union all
  select doc_id, page_index, -1, -1, k, 'Parts', 99.0, 0.0, 60.0, 50.0 from each where row_index = 0 and col_index = 0 and doc_id % 31 = 0
), words as (
  select doc_id, page_index, cast(row_number() over (partition by doc_id, page_index order by col_index, row_index, k) - 1 as int) as word_ord,
    concat_ws('-', doc_id, row_index, col_index, k) as word_id, text, confidence, "left", top, width, 12.0::double as height from body
), model as (
  select doc_id, page_index, row_index, col_index, case when row_index > 0 and (doc_id * 13 + row_index * 5 + col_index) % 29 = 0 then '' else value end as value from grid
), model_lines as (
  select doc_id, page_index, row_index, string_agg(value, chr(9) order by col_index) as line from model group by all
), raw_output as (
  select doc_id, page_index, string_agg(line, chr(10) order by row_index) as raw from model_lines group by all
), token_parts as (
  select doc_id, page_index, row_index, col_index, value, case when row_index = 0 and col_index = 0 then '' when col_index = 0 then chr(10) else chr(9) end as lead from model
), token_each as (
  select doc_id, page_index, row_index, col_index, 0 as k, case when (doc_id + row_index + col_index) % 3 = 0 then lead || value else lead end as token from token_parts
  union all select doc_id, page_index, row_index, col_index, 1, value from token_parts where (doc_id + row_index + col_index) % 3 <> 0
), tokens as (
  select doc_id, page_index, cast(row_number() over (partition by doc_id, page_index order by row_index, col_index, k) - 1 as int) as seq, token,
    case when (doc_id * 5 + row_index * 3 + col_index + k) % 19 <> 0 then -((doc_id * 3 + row_index * 5 + col_index * 7) % 50) / 100.0::double end as logprob
  from token_each where token <> ''
)
"""
