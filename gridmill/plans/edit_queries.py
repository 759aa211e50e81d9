"""Edit queries over the made grids: each page's model cells, with fixed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators import edits as E
from gridmill.operators import parse as P
from gridmill.plans import synth
from gridmill.plans.registry import Registry

query = Registry()

CELLS = synth.SQL.rstrip() + ", c as (select doc_id, page_index, row_index, col_index, value, row_index % 2 = 0 as verified from model)\n"
#: Values before and after in SQL: row and column numbers run without a gap.
VALUES = "select doc_id, page_index, {r} as row_index, {c} as col_index, {v} as value from c {w}"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = P.blank_cell(F.col("row_index"), F.col("col_index"))
    base = synth.model_cells(spark, sf_dir)
    full = {"word_ids": F.array(F.concat_ws("-", "row_index", "col_index")), "match_status": F.lit("matched"), "ocr": (50 + F.col("col_index") * 10).cast("double"), "trust": F.when(F.col("col_index") == 1, "medium").otherwise("high"), "verified": F.col("row_index") % 2 == 0}
    return base.select(*E.CELL, "value", *[full.get(c, blank[c]).alias(c) for c in E.BODY[1:]])


def shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page_index", "row_index", "col_index", "value")


@query(CELLS + "select doc_id, page_index, row_index, col_index, case when row_index = 2 and col_index = 1 then 'X y' else value end as value, verified or (row_index = 2 and col_index = 1) as verified from c")
def set_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.set_value(cells(spark, sf_dir), 2, 1, "  X y ").select("doc_id", "page_index", "row_index", "col_index", "value", "verified")


@query(CELLS + "select doc_id, page_index, row_index, col_index, case when row_index between 1 and 2 and col_index between 1 and 3 then '' else value end as value, (row_index between 1 and 2 and col_index between 1 and 3 and value <> '') as edited from c")
def clear_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clear(cells(spark, sf_dir), (2, 3, 1, 1)).select("doc_id", "page_index", "row_index", "col_index", "value", "edited")


@query(CELLS + "select doc_id, page_index, row_index, col_index, case when row_index between 0 and 2 then (select not bool_and(d.verified) from c d where d.doc_id = c.doc_id and d.row_index between 0 and 2) else verified end as verified from c")
def toggle_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.toggle_verified(cells(spark, sf_dir), (0, 0, 2, 4)).select("doc_id", "page_index", "row_index", "col_index", "verified")


@query(CELLS + VALUES.format(r="case when row_index >= 2 then row_index + 2 else row_index end", c="col_index", v="value", w="") + " union all select doc_id, page_index, r, col_index, '' from (select distinct doc_id, page_index, col_index from c), (select unnest([2, 3]) as r)")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.insert_rows(cells(spark, sf_dir), 2, 2))


@query(CELLS + VALUES.format(r="case when row_index > 3 then row_index - 3 else row_index end", c="col_index", v="value", w="where row_index not between 1 and 3"))
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.delete_rows(cells(spark, sf_dir), 1, 3))


@query(CELLS + VALUES.format(r="case when row_index between 2 and 3 then row_index + 1 when row_index = 4 then 2 else row_index end", c="col_index", v="value", w=""))
def move_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.move_rows(cells(spark, sf_dir), 2, 3, 1))


@query(CELLS + VALUES.format(r="row_index", c="case when col_index >= 1 then col_index + 1 else col_index end", v="value", w="") + " union all select distinct doc_id, page_index, row_index, 1, '' from c")
def insert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.insert_columns(cells(spark, sf_dir), 1))


@query(CELLS + VALUES.format(r="row_index", c="case when col_index > 2 then col_index - 2 else col_index end", v="value", w="where col_index not between 1 and 2"))
def delete_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.delete_columns(cells(spark, sf_dir), 1, 2))


@query(CELLS + VALUES.format(r="row_index", c="case when col_index = 2 then 1 when col_index = 1 then 2 else col_index end", v="value", w=""))
def move_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.move_columns(cells(spark, sf_dir), 2, 2, -1))


FOLD = "(select string_agg(d.value, ' ' order by d.col_index) from c d where d.doc_id = c.doc_id and d.row_index = c.row_index and d.col_index between 1 and 2 and d.value <> '')"


@query(CELLS + VALUES.format(r="row_index", c="col_index", v=f"case when row_index between 1 and 4 and col_index = 1 then coalesce({FOLD}, '') when row_index between 1 and 4 and col_index = 2 then '' else value end", w=""))
def merge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.merge_cells(cells(spark, sf_dir), (1, 1, 4, 2)))


@query(
    CELLS
    + f"""select doc_id, page_index, row_index, case when col_index > 2 then col_index - 1 else col_index end as col_index, case when col_index = 1 then coalesce({FOLD}, '') else value end as value,
  case when col_index = 1 then row_index || '-1|' || row_index || '-2' else row_index || '-' || col_index end as word_ids, col_index <> 1 and row_index % 2 = 0 or col_index = 1 as verified from c where col_index <> 2"""
)
def merge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merge_columns(cells(spark, sf_dir), 2, 1).select("doc_id", "page_index", "row_index", "col_index", "value", F.array_join("word_ids", "|").alias("word_ids"), "verified")


@query(CELLS + VALUES.format(r="row_index", c="case when row_index between 1 and 2 and col_index > 2 then col_index - 2 else col_index end", v="value", w="where not (row_index between 1 and 2 and col_index between 1 and 2)") + " union all select distinct doc_id, page_index, row_index, k, '' from c, (select unnest([3, 4]) as k) where row_index between 1 and 2")
def shift_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.delete_shift_left(cells(spark, sf_dir), (1, 1, 2, 2)))


@query(
    CELLS
    + """, m as (select doc_id, page_index, row_index, case when row_index between 1 and 2 and col_index >= 1 then col_index + 1 else col_index end as col_index, value from c union all select distinct doc_id, page_index, row_index, 1, '' from c where row_index between 1 and 2)
, s as (select doc_id, page_index, max(case when value <> '' or col_index < 5 then col_index end) as w from m group by all)
select r.doc_id, r.page_index, r.row_index, k as col_index, coalesce(m.value, '') as value from (select distinct doc_id, page_index, row_index from c) r join s using (doc_id, page_index) join (select unnest([0, 1, 2, 3, 4, 5]) as k) on k <= w
left join m on m.doc_id = r.doc_id and m.row_index = r.row_index and m.col_index = k"""
)
def shift_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.insert_shift_right(cells(spark, sf_dir), (1, 1, 2, 1)))


@query(CELLS + VALUES.format(r="case when row_index > 2 then row_index - 1 else row_index end", c="case when col_index > 3 then col_index - 1 else col_index end", v="value", w="where row_index <> 2 and col_index <> 3"))
def remove_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third row and the fourth column are blanked first; they must go."""
    blanked = cells(spark, sf_dir).withColumn("value", F.when((F.col("row_index") == 2) | (F.col("col_index") == 3), " ").otherwise(F.col("value")))
    return shown(E.remove_empty(blanked))


@query(CELLS + "select doc_id, page_index, string_agg(l, '/' order by row_index) as block from (select doc_id, page_index, row_index, string_agg(value, '|' order by col_index) as l from c where row_index between 1 and 3 and col_index between 0 and 1 group by all) group by all")
def range_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.range_values(cells(spark, sf_dir), (1, 0, 3, 1))
    return rows.select("doc_id", "page_index", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("block"))


@query(
    CELLS
    + """, n as (select * from (values (1, 4, 'x'), (1, 5, 'y'), (2, 4, 'p'), (2, 5, 'q')) v(r, k, t))
select f.doc_id, f.page_index, f.row_index, f.k as col_index, coalesce(t, value, '') as value from (select distinct doc_id, page_index, row_index, k from c, (select unnest([0, 1, 2, 3, 4, 5]) as k)) f
left join c on c.doc_id = f.doc_id and c.row_index = f.row_index and c.col_index = f.k left join n on n.r = f.row_index and n.k = f.k"""
)
def paste_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(E.paste(cells(spark, sf_dir), [["x", "y"], ["p", "q "]], 1, 4))


@query(CELLS + "select doc_id, page_index, least(2, max(row_index)) as row0, least(1, max(col_index)) as col0, least(99, max(row_index)) as row1, least(99, max(col_index)) as col1 from c group by all")
def clamp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clamped(cells(spark, sf_dir), (99, 1, 2, 99))


@query(CELLS + "select doc_id, page_index, row_index, col_index, lead(row_index || ':' || col_index) over w as next, lag(row_index || ':' || col_index) over w as previous from c window w as (partition by doc_id, page_index order by row_index, col_index)")
def step_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.concat_ws(":", f"{c}.row_index", f"{c}.col_index")
    return E.neighbours(cells(spark, sf_dir)).select("doc_id", "page_index", "row_index", "col_index", F.when(F.col("next").isNotNull(), at("next")).alias("next"), F.when(F.col("previous").isNotNull(), at("previous")).alias("previous"))


@query(CELLS + "select doc_id, page_index, true as move_up, max(row_index) > 2 as move_down, max(col_index) > 3 as move_right, true as delete_rows, true as merge from c group by all")
def table_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.commands(cells(spark, sf_dir), (1, 2, 2, 3)).select("doc_id", "page_index", "move_up", "move_down", "move_right", "delete_rows", "merge")


@query(CELLS + "select doc_id, page_index, row_index, col_index, value from c")
def pad_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank cells at the ends of rows are dropped first; padding brings them back."""
    ragged = synth.model_cells(spark, sf_dir).filter("not (value = '' and col_index = 4)")
    return P.padded(ragged).select("doc_id", "page_index", "row_index", "col_index", "value")


@query(CELLS + """select doc_id, page_index, row_index, round(avg(case when trim(value) <> '' then 50 + 10 * col_index end), 6) as ocr, case when bool_or(col_index = 1 and trim(value) <> '') then 'medium' else 'high' end as trust,
  string_agg(row_index || '-' || col_index, '|' order by col_index) as ids from c where col_index <= 2 group by doc_id, page_index, row_index""")
def merged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merged column takes over: the mean OCR score and the least trust of its filled cells, and all their words."""
    kept = E.merge_columns(cells(spark, sf_dir), 0, 2).filter("col_index = 0")
    return kept.select("doc_id", "page_index", "row_index", F.round("ocr", 6).alias("ocr"), "trust", F.array_join("word_ids", "|").alias("ids"))
