"""Report queries and the rest of the small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import misc as M
from gridmill.operators import export as X
from gridmill.operators import reports as R
from gridmill.plans.registry import Registry, table

query = Registry()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files: a supplier's folder, an order's file."""
    o = table(spark, sf_dir, "orders")
    path = F.concat_ws("/", F.lit("run"), (F.col("o_custkey") % 10).cast("string"), F.concat(F.col("o_orderkey"), F.lit(".part")))
    return o.select("o_orderkey", path.alias("path"), (F.col("o_orderkey") % 1000).alias("length"), F.col("o_orderdate").alias("modified"))


@query("select 'run/' || o_custkey % 10 as folder, sum(o_orderkey % 1000)::bigint as bytes, count(*) as files from orders group by all")
def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tree_sizes(files(spark, sf_dir), 2)


@query("""with recursive f as (select 'run/' || o_custkey % 10 || '/' || case when o_orderkey % 3 = 0 then 'deep/' || o_orderkey % 7 || '/' else '' end || o_orderkey || '.part' as path, o_orderkey % 1000 as length from orders
), up as (select path, regexp_replace(path, '/[^/]*$', '') as folder, length, 1 as own from f
  union all select path, regexp_replace(folder, '/[^/]*$', ''), length, 0 from up where contains(folder, '/'))
select folder, len(string_split(folder, '/'))::int as depth, sum(length)::bigint as bytes, count(*) as files, sum(own)::bigint as own_files from up group by folder""")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder of a tree of several depths, with all that lies under it."""
    deeper = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("deep/"), F.col("o_orderkey") % 7, F.lit("/"))).otherwise("")
    path = F.concat(F.lit("run/"), F.col("o_custkey") % 10, F.lit("/"), deeper, "o_orderkey", F.lit(".part"))
    return R.folder_sizes(table(spark, sf_dir, "orders").select(path.alias("path"), (F.col("o_orderkey") % 1000).alias("length")))


@query("select sum(case when o_orderkey % 3 <> 0 then o_orderkey % 1000 end)::bigint as freed, count(case when o_orderkey % 3 = 0 then 1 end) as survivors, 'retry' as next from orders")
def removal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return R.removal_report(f, f.filter("o_orderkey % 3 = 0")).withColumn("next", R.after_removal(F.col("survivors"), F.lit("reset")))


@query("select 'run/' || o_custkey % 10 || '/' || o_orderkey || '.part' as path from orders where o_custkey % 10 = 1 and epoch(timestamp '1998-01-01') - epoch(o_orderdate) > 168 * 3600")
def expired_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("modified", F.col("modified").cast("timestamp"))
    return R.expired_paths(f, F.lit("1998-01-01").cast("timestamp"), "run/1/", 168)


@query("select p_name || p_partkey as name from part where p_size > 10 and p_partkey % 4 <> 0")
def missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("name"), (F.col("p_size") > 10).alias("needed"), "p_partkey")
    return R.missing_assets(p, p.filter("p_partkey % 4 = 0").select("name"))


@query("select s_nationkey as root, arg_min('x/' || s_suppkey, (length('x/' || s_suppkey) * 0, 'x/' || s_suppkey || '/ok')) as folder from supplier where s_suppkey % 3 = 0 group by s_nationkey")
def marker_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return R.under_prefix(s.select(F.col("s_nationkey").alias("root"), F.concat(F.lit("x/"), "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "/ok").otherwise("/no")).alias("path")), "ok")


@query("select n_regionkey, string_agg(n_name || ': ' || case when n_nationkey % 4 = 0 then 'unknown' else n_nationkey::varchar end, chr(10) order by n_nationkey) as report from nation group by n_regionkey")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return R.diagnostics(n.select("n_regionkey", F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey").cast("string")).alias("value")), ["n_regionkey"])


@query("select l_orderkey, avg(0.299::double * (l_partkey % 256) + 0.587::double * (l_suppkey % 256) + 0.114::double * (l_linenumber % 256)) < 128 as dark from lineitem group by l_orderkey")
def image_darkness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.darkness(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), (F.col("l_linenumber") % 256).alias("b")), ["l_orderkey"])


@query("select o_orderkey, case when o_orderkey % 3 > 0 then o_orderkey::int end as pid, o_orderkey * 2 as mb, case when o_orderkey % 2 = 0 then o_orderkey + 1 end as total from orders")
def tolerant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pid = F.when(k % 3 == 0, "none").otherwise(F.concat(F.lit(" "), k, F.lit("\n")))
    gpu = F.concat(F.lit("Card 7, "), k * 2, F.lit(" MiB\nother, 5 MiB"))
    header = F.when(k % 2 == 0, F.concat(F.lit("bytes 0-"), k, F.lit("/"), k + 1)).otherwise("bytes 0-1/*")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.pid_of(pid).alias("pid"), R.gpu_memory(gpu).alias("mb"), R.range_total(header).alias("total"))


LINES = """select doc_id, i - 1 as line_no, case when l = '' then l else case (doc_id + i) % 6 when 0 then '## ' || l when 1 then '- ' || l when 2 then '> ' || l when 3 then '  ' || l when 4 then '12. ' || l else l end end as line
  from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)"""


@query(
    f"""with k as (select *, case when trim(regexp_replace(line, '\\s', '', 'g')) = '' then 'blank' when regexp_matches(line, '^#{{1,4}} ') then 'h' || length(regexp_extract(line, '^#+')) when regexp_matches(line, '^\\s*(-{{3,}}|\\*{{3,}})\\s*$') then 'rule'
    when regexp_matches(line, '^\\s*[-*] ') then 'bullet' when regexp_matches(line, '^\\s*\\d+\\. ') then 'numbered' when starts_with(line, '>') then 'quote' when regexp_matches(line, '^ {{2,}}\\S') then 'continued' else 'paragraph' end as kind from ({LINES})
), b as (select *, lag(kind) over (partition by doc_id order by line_no) as p from k
) select doc_id, line_no, kind, block_no from (select doc_id, line_no, kind, cast(sum(case when kind = 'blank' or (kind = p and kind in ('quote', 'paragraph')) or (kind = 'continued' and p in ('bullet', 'numbered', 'continued', 'paragraph')) then 0 else 1 end) over (partition by doc_id order by line_no rows unbounded preceding) as int) as block_no from b) where kind <> 'blank'"""
)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = lambda l, i: F.when(l == "", l).otherwise(F.concat(F.element_at(F.array(*map(F.lit, ["## ", "- ", "> ", "  ", "12. ", ""])), ((F.col("doc_id") + i + 1) % 6 + 1).cast("int")), l))  # noqa: E731, E741
    text = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    return R.markdown_blocks(docs.select("doc_id", text.alias("text")), "doc_id", "text").select("doc_id", "line_no", "kind", "block_no")


@query("select p_partkey, case when d <= 0 then 0 else cast(round(least(1.0, d / 40.0) * 20) as int) end as step, greatest(25.0, least(400.0, p_partkey::double)) as zoom from (select p_partkey, p_partkey % 60 - 10 as d from part)")
def scroll_and_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", M.scroll_step(k % 60 - 10).alias("step"), M.zoom_level(k.cast("double"))["zoom"].alias("zoom"))


@query("select s_suppkey, case s_suppkey % 4 when 0 then 'nvidia' when 1 then 'amd' when 2 then 'apple' end as vendor, case when s_suppkey % 4 <> 0 then 'cuda needs a GPU by nvidia' end as warning from supplier")
def gpu_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["NVIDIA GeForce", "AMD Radeon", "Apple M2", "other"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    v = M.gpu_vendor(name)
    return table(spark, sf_dir, "supplier").select("s_suppkey", v.alias("vendor"), M.backend_warning(F.lit("cuda"), v).alias("warning"))


@query("""select page_id, '<div class="block" style="left:' || printf('%.1f%%', (page_id % 500) / 10.0) || ';top:10.0%;width:' || printf('%.1f%%', (page_id % 300) / 10.0) || ';height:5.0%" title="T&amp;1"></div>' as overlay from pages""")
def overlay_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    box = F.array(*[x.cast("double") for x in (k % 500, F.lit(100), k % 500 + k % 300, F.lit(150))])
    return X.overlay_html(table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("block_no"), F.lit("T&1").alias("label"), box.alias("bbox")))
