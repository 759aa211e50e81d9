"""Queries over what sessions keep: history, commits, lookups, migrations, feeds, runs, and the rest of the small rules."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import misc as M
from gridmill.operators import export as X
from gridmill.operators import history as H
from gridmill.operators import reports as R
from gridmill.operators import score as C
from gridmill.operators import store as S
from gridmill.plans import match_queries, synth
from gridmill.plans.match_queries import SCORED
from gridmill.plans.registry import Registry, table
from gridmill.plans.report_queries import files
from gridmill.plans.text_queries import CSV_CELL, GUARDED, ODD_CELLS, odd_cells, page_sql
from gridmill.sources import ingest as I
from gridmill.sources.shared import new_folder
from gridmill.sources.xlsx import read_pages, write_pages
from gridmill.streaming import flows as W

query = Registry()


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


# -- history ----------------------------------------------------------------


@query(
    """with e as (select user_id, event_id, case when event_id % 211 = 0 then 'reset' else ['apply', 'apply', 'undo', 'apply', 'redo', 'undo', 'apply'][event_id % 7 + 1] end as action, cast(event_id // 2 as varchar) as grid from events
), folded as (select user_id, list_reduce(list_prepend({'a': '', 'g': null::varchar, 'p': []::varchar[], 'f': []::varchar[]}, list({'a': action, 'g': grid, 'p': []::varchar[], 'f': []::varchar[]} order by event_id)), lambda s, x:
  case when x.a = 'reset' then {'a': '', 'g': x.g, 'p': []::varchar[], 'f': []::varchar[]}
    when x.a = 'apply' and x.g is distinct from s.g then {'a': '', 'g': x.g, 'p': (case when s.g is null then s.p else list_append(s.p, s.g) end)[-50:], 'f': []::varchar[]}
    when x.a = 'undo' and len(s.p) > 0 then {'a': '', 'g': s.p[-1], 'p': s.p[:-2], 'f': list_prepend(s.g, s.f)[:50]}
    when x.a = 'redo' and len(s.f) > 0 then {'a': '', 'g': s.f[1], 'p': list_append(s.p, s.g)[-50:], 'f': s.f[2:]} else s end) as s from e group by user_id)
select user_id, s.g as current, cast(len(s.p) as int) as undo, cast(len(s.f) as int) as redo from folded"""
)
def undo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    action = F.when(k % 211 == 0, "reset").otherwise(pick(["apply", "apply", "undo", "apply", "redo", "undo", "apply"], k % 7))
    log = table(spark, sf_dir, "events").select("user_id", k.alias("seq"), action.alias("action"), F.floor(k / 2).cast("string").alias("grid"))
    return H.undo_state(log, ["user_id"])


@query("""with d as (select l_orderkey // 64 as doc_id, l_linenumber as row_index, l_suppkey % 5 as col_index, l_orderkey % 64 as version, case when max(case when l_partkey % 7 = 0 then 1 else 0 end) = 1 then null else max(l_partkey) end::varchar as value from lineitem group by all
), asked as (select distinct doc_id, v as version from d, (select unnest([0, 17, 40, 63, 900]) as v)
), seen as (select a.version as wanted, d.*, row_number() over (partition by d.doc_id, a.version, row_index, col_index order by d.version desc) as n from asked a join d on a.doc_id = d.doc_id and d.version <= a.version)
select doc_id, 0 as page_index, wanted as version, row_index, col_index, value from seen where n = 1 and value is not null""")
def grid_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are changes of a grid's cells: 64 versions of each, five of which are asked for, one of them to come."""
    items = table(spark, sf_dir, "lineitem")
    value = F.when(F.max(F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)) == 0, F.max("l_partkey").cast("string"))
    cell = [F.expr("l_orderkey div 64").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("row_index"), (F.col("l_suppkey") % 5).alias("col_index"), (F.col("l_orderkey") % 64).alias("version")]
    deltas = items.groupBy(*cell).agg(value.alias("value"))
    asked = deltas.select("doc_id", "page_index").distinct().withColumn("version", F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 17, 40, 63, 900)])))
    return H.grids_at(deltas, asked)


@query(synth.SQL + "select doc_id, page_index, row_index, col_index, least(row_index + 2, max(row_index) over (partition by doc_id, page_index)) as to_row, greatest(col_index - 1, 0) as to_col from grid")
def moved_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.moved_focus(synth.grid(spark, sf_dir), 2, -1)


@query(
    synth.SQL.rstrip() + ODD_CELLS + f"""select doc_id as session_id, page_index, doc_id % 3 = 0 as mapped, case when doc_id % 2 = 0 then 2000 else 1000 + doc_id end as updated_at,
  case when doc_id % 3 <> 0 then 'old' else string_agg(l, chr(13) || chr(10) order by row_index) end as csv
  from (select doc_id, page_index, row_index, string_agg({CSV_CELL}, ',' order by col_index) as l from (select *, value as v from odd) group by all) group by doc_id, page_index"""
)
def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page is written anew; every second session was used later than stored."""
    cells = odd_cells(spark, sf_dir)
    ids = cells.select(F.col("doc_id").alias("session_id"), "page_index").distinct()
    outputs = ids.select("session_id", "page_index", F.lit("old").alias("csv_content"), F.lit(None).cast("string").alias("cell_mappings_json"))
    sessions = ids.select(F.col("session_id").alias("id"), (F.col("session_id") + 1000).alias("updated_at"))
    at = ids.filter("session_id % 2 = 0").select("session_id", F.lit(2000).cast("long").alias("ts"))
    new, touched = H.committed(outputs, sessions, cells.filter("doc_id % 3 = 0"), at)
    mapped = F.coalesce(F.size(F.from_json("cell_mappings_json", "array<struct<value:string>>")) > 0, F.lit(False))
    return new.hint("merge").join(touched.withColumnRenamed("id", "session_id"), "session_id").select("session_id", "page_index", mapped.alias("mapped"), "updated_at", F.col("csv_content").alias("csv"))


@query(SCORED + """, f as (select doc_id, page_index, row_index, col_index, row_index * 100 + col_index as pos from scored where row_index <> 3 and trust <> 'high'
), asked as (select distinct doc_id, page_index, cast(doc_id % 9 as int) as r, cast(doc_id % 5 as int) as c from scored
), near as (select a.*, coalesce(min(case when pos > r * 100 + c then pos end), min(pos)) as n, coalesce(max(case when pos < r * 100 + c then pos end), max(pos)) as p from asked a join f using (doc_id, page_index) group by all
) select doc_id, page_index, r as row_index, c as col_index, n // 100 || ':' || n % 100 as next, p // 100 || ':' || p % 100 as previous from near""")
def next_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a selected cell of each page, flagged or not, to the flagged ones about it."""
    cells = match_queries.scored(spark, sf_dir)
    asked = cells.select("doc_id", "page_index").distinct().select("*", (F.col("doc_id") % 9).cast("int").alias("row_index"), (F.col("doc_id") % 5).cast("int").alias("col_index"))
    at = lambda c: F.concat_ws(":", f"{c}.row_index", f"{c}.col_index").alias(c)
    return C.next_flagged(cells, asked).select(*C.CELL, at("next"), at("previous"))


# -- store ------------------------------------------------------------------


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers' orders as sessions' files and tables, lines as pages."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    session = F.col("o_custkey").alias("session_id")
    image = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("p/"), F.col("l_suppkey"))).otherwise("")
    return {
        "sessions": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")),
        "files": orders.select(F.col("o_orderkey").alias("id"), session, F.concat(F.lit("n"), "o_orderkey").alias("file_name"), F.concat(F.lit("f/"), "o_orderkey").alias("file_path")),
        "csv_outputs": orders.groupBy(session).agg(F.max("o_orderpriority").alias("csv_content")).select("session_id", F.lit(0).alias("page_index"), "csv_content"),
        "document_pages": items.select(F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") - 1).alias("page_index"), image.alias("image_path")),
        "document_page_sets": items.groupBy(F.col("l_orderkey").alias("session_id")).agg(F.count("*").alias("page_count")),
    }


@query("""select 'path' as kind, path, 1::bigint as n from (select distinct 'p/' || l_suppkey as path from lineitem where l_orderkey % 11 = 0 and l_linenumber % 3 > 0)
  union all select 'pages', null, count(*) from lineitem where l_orderkey % 11 <> 0 union all select 'markers', null, count(distinct l_orderkey) from lineitem where l_orderkey % 11 <> 0 union all select 'files', null, count(*) from orders""")
def discarded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = store(spark, sf_dir)
    left, paths = S.discarded_pages(all_, all_["document_page_sets"].filter("session_id % 11 = 0").select(F.col("session_id").alias("id")))
    count = lambda kind, name: left[name].agg(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("path"), F.count("*").alias("n"))
    return paths.select(F.lit("path").alias("kind"), "path", F.lit(1).cast("long").alias("n")).unionAll(count("pages", "document_pages")).unionAll(count("markers", "document_page_sets")).unionAll(count("files", "files"))


@query("""select c_custkey as session_id, 'n' || o as file_name, 'f/' || o as file_path, csv_content, coalesce(images, 0) as images from customer
  left join (select o_custkey, min(o_orderkey) as o, max(o_orderpriority) as csv_content from orders group by o_custkey) on o_custkey = c_custkey
  left join (select l_orderkey, count(*) as images from lineitem where l_linenumber % 3 > 0 group by l_orderkey) on l_orderkey = c_custkey""")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = store(spark, sf_dir)
    return S.looked_up(all_, all_["sessions"].select("id"), 0)


@query("""select 'session' as kind, c_custkey as id, c_name as name from customer union all select 'file', o_orderkey, 'n' || o_orderkey from orders
  union all select unnest(['session', 'file']), unnest([s_suppkey + 1000000, s_suppkey + 2000000]), unnest([s_name, s_name || '.pdf']) from supplier where s_suppkey % 3 <> 0""")
def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sessions with their files; every third upload fails."""
    all_, s = store(spark, sf_dir), table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("long")
    new = s.select((k + 1000000).alias("id"), F.col("s_name").alias("title"), (k + 2000000).alias("file_id"), F.concat("s_name", F.lit(".pdf")).alias("file_name"), F.lit("x").alias("file_path"), (k % 3 == 0).alias("failed"))
    sessions, held = S.inserted(all_["sessions"], all_["files"], new)
    return sessions.select(F.lit("session").alias("kind"), "id", F.col("title").alias("name")).unionAll(held.select(F.lit("file").alias("kind"), "id", F.col("file_name").alias("name")))


@query("""with s as (select s_nationkey as nation, list(s_suppkey order by s_suppkey) as shown, list_filter(list(s_suppkey + (case when s_suppkey % 4 = 0 then 100000 else 0 end) order by s_suppkey % 5, s_suppkey), lambda x: x % 7 <> 0) as fresh from supplier group by s_nationkey
), m as (select nation, list_reduce(list_prepend({'l': list_filter(shown, lambda x: list_contains(fresh, x)), 'x': 0::bigint, 'i': 0::bigint}, list_filter(list_transform(fresh, lambda x, i: {'l': []::bigint[], 'x': x, 'i': i - 1}), lambda e: not list_contains(shown, e.x))),
  lambda a, e: {'l': list_concat(a.l[1:least(e.i, len(a.l))], list_concat([e.x], a.l[least(e.i, len(a.l)) + 1:])), 'x': e.x, 'i': e.i}).l as l from s)
select nation, array_to_string(l, ',') as merged from m""")
def merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists on show, and fresh ones in which some entries went, some are new and the order is another."""
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey").cast("long"))
    fresh = F.struct(F.col("k") % 5, F.col("k"), (F.col("k") + F.when(F.col("k") % 4 == 0, 100000).otherwise(0)).alias("x"))
    lists = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.sort_array(F.collect_list("k")).alias("shown"), F.filter(F.transform(F.sort_array(F.collect_list(fresh)), lambda e: e["x"]), lambda x: x % 7 != 0).alias("fresh"))
    return lists.select("nation", F.array_join(S.merged_orders(F.col("shown"), F.col("fresh")), ",").alias("merged"))


@query("select cast(o_orderkey % 97 as int) as version, o_orderkey as step, 'step ' || o_orderkey as text, cast(row_number() over (order by o_orderkey % 97, o_orderkey) as int) as turn from orders where o_orderkey % 97 > 90")
def pending_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    statements = table(spark, sf_dir, "orders").select((k % 97).cast("int").alias("version"), k.alias("step"), F.concat(F.lit("step "), k).alias("text"))
    return S.pending_migrations(statements, spark.range(91).select(F.col("id").cast("int").alias("version")))


# -- ingest and flows -------------------------------------------------------


@query("""with d as (select o_orderkey as doc_id, o_orderkey % 9 as kind, cast(o_orderkey % 4 + 1 as int) as n from orders
), r as (select *, case when kind = 0 then 'too large' when kind = 1 then 'unknown type' when kind = 2 then 'content is not of its type' when kind = 3 then 'too many pages' end as reason from d
), p as (select doc_id, n, unnest(range(n)) as page from r where reason is null
) select doc_id, 'page' as what, cast(page as int) as page_index, case when (doc_id + page) % 5 = 0 then 0 else (doc_id + page) % 3 end as n, case when (doc_id + page) % 5 = 0 then 'render failed' end as said from p
  union all select doc_id, 'event', page::int + 1, n, null from p union all select doc_id, 'refused', null, null, reason from r where reason is not null""")
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF, PNG and JPEG uploads, some refused; pages that fail; progress."""
    k = F.col("o_orderkey")
    kind = k % 9
    ext = pick(["pdf", "png", "jpeg"], k % 3)
    magic = pick(["255044462D", "89504E470D0A1A0A00", "FFD8FFE0"], k % 3)
    content = F.unhex(F.when(kind == 2, F.lit("00112233")).otherwise(magic))
    n = F.when(kind == 3, F.lit(2001)).otherwise((k % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit(1).alias("n_files"), F.when(kind == 0, I.MOST_BYTES + 1).otherwise(5).cast("long").alias("length"), F.lit("").alias("mime"), F.concat(F.lit("a."), F.when(kind == 1, "exe").otherwise(ext)).alias("name"), content.alias("content"), n.alias("n_pages"))
    docs = docs.withColumn("content", F.when(F.col("doc_id") % 9 == 1, F.unhex(F.lit("00"))).otherwise(F.col("content")))
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.least("n_pages", F.lit(4)) - 1)).alias("page_index")).select("*", F.lit("Pdf").alias("kind"), F.when((F.col("doc_id") + F.col("page_index")) % 5 == 0, "render failed").alias("error"))
    words = pages.filter("(doc_id + page_index) % 3 > 0").select("doc_id", "page_index", F.explode(F.sequence(F.lit(1), (F.col("doc_id") + F.col("page_index")) % 3)).alias("w"))
    results, events, refused = I.ingested(docs, pages, words)
    none = F.lit(None)
    shown = results.select("doc_id", F.lit("page").alias("what"), "page_index", F.col("n_words").alias("n"), F.col("error").alias("said"))
    shown = shown.unionAll(events.select("doc_id", F.lit("event"), "current", F.col("total").cast("long"), none.cast("string")))
    return shown.unionAll(refused.select("doc_id", F.lit("refused"), none.cast("int"), none.cast("long"), "reason"))


@query("""with s as (select l_orderkey as stream, l_linenumber as seq, repeat('x', cast(l_linenumber * l_suppkey % 7 as int)) || l_linenumber as content from lineitem
), f as (select stream, list_reduce(list_prepend({'b': 0, 'u': 0, 'o': []::int[], 'n': 0}, list({'b': 0, 'u': 0, 'o': []::int[], 'n': length(content)::int} order by seq, content)), lambda a, x: {'b': a.b + case when a.u + x.n >= 8 then 1 else 0 end, 'u': case when a.u + x.n >= 8 then 0 else a.u + x.n end, 'o': list_append(a.o, a.b), 'n': 0}).o as o, list(content order by seq, content) as c from s group by stream
) select stream, block, string_agg(content, '' order by i) as content from (select stream, unnest(o) as block, unnest(c) as content, generate_subscripts(c, 1) as i from f) group by stream, block""")
def rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    content = F.concat(F.repeat(F.lit("x"), (k * F.col("l_suppkey") % 7).cast("int")), k)
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream"), F.struct(k, content).alias("seq"), content.cast("binary").alias("content"))
    return I.rechunked(chunks, 8).withColumn("content", F.col("content").cast("string"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""with e as (select user_id, event_id, event_type, epoch_us(ts) as us from events
), runs as (select user_id, event_id as run_id, us as started from e where event_id % 10 = 0
), cancels as (select user_id, us from e where event_type = 'click'
), ends as (select user_id, run_id, min(c.us) as done from runs join cancels c using (user_id) where c.us > started group by all
), pages as (select user_id, run_id, unnest(range(1, 6)) as page, started from runs)
select p.user_id as session_id, p.run_id, p.page from pages p left join ends using (user_id, run_id) where done is null or started + page * 3600000000 < done""")
def uncancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of five pages, an hour each; a click cancels."""
    e = timed(spark, sf_dir).withColumnRenamed("user_id", "session_id")
    runs = e.filter("event_id % 10 = 0").select("session_id", F.col("event_id").alias("run_id"), F.col("us").alias("started"))
    pages = runs.select("session_id", "run_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page"), "started").withColumn("at", F.col("started") + F.col("page") * 3_600_000_000)
    return W.uncancelled(pages, runs, e.filter("event_type = 'click'").select("session_id", F.col("us").alias("at"))).select("session_id", "run_id", "page")


@query("""with j as (select user_id, epoch_us(ts) // 1000000 as a, epoch_us(ts) // 1000000 + event_id % 50 * 600 as z from events
), b as (select user_id, max(z) over (partition by user_id order by a, z rows unbounded preceding) as e, lead(a) over (partition by user_id order by a, z) as n from j)
select user_id, e + 3600 as at from b where n is null or n > e + 3600""")
def idle_unloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor(F.col("us") / 1_000_000)
    return W.idle_unloads(timed(spark, sf_dir).select("user_id", start.alias("start"), (start + F.col("event_id") % 50 * 600).alias("end")), "user_id", 3600)


@query("""with p as (select l_orderkey, l_linenumber * 30 as t, case when l_suppkey % 5 = 0 then 'healthy' when l_suppkey % 11 = 0 then 'exited' else 'loading' end as status from lineitem
), f as (select l_orderkey, min(case when t < 180 and status <> 'loading' then (t, status) end) as f from p group by l_orderkey
) select l_orderkey, case when f is null then 'timeout' when f[2] = 'exited' then 'exited' else 'ready' end as state, coalesce(f[1], 180) as at from (select l_orderkey, case when f is null then null else [f[1]::varchar, f[2]] end as f from f) t(l_orderkey, f)""".replace("f[1], 180) as at", "f[1]::bigint, 180) as at"))
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_suppkey") % 5 == 0, "healthy").when(F.col("l_suppkey") % 11 == 0, "exited").otherwise("loading")
    return W.readiness(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 30).alias("t"), status.alias("status")), "l_orderkey")


@query("select p_partkey, case when p_size * 10 <= p_partkey % 300 then 0 when p_partkey % 4 > 0 then greatest(1, cast(round((p_size * 10 - p_partkey % 300)::double / (p_partkey % 4 * 100)) as bigint)) end as eta from part")
def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rate = F.when(k % 4 > 0, (k % 4 * 100).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", W.eta(rate, k % 300, F.col("p_size") * 10).alias("eta"))


@query("""with e as (select user_id, event_id as seq, case when event_id % 41 = 0 then 'delete_all' when event_id % 5 = 0 then 'delete' else 'update' end as kind from events
), c as (select coalesce(max(case when kind = 'delete_all' then seq end), 0) as done from e
), last as (select user_id, max(seq) as seq, arg_max(kind, seq) as kind from (select user_id, seq, kind from e where kind <> 'delete_all' union all select distinct user_id, -user_id, 'update' from events) group by user_id
) select user_id as session_id, seq, true as due from last, c where kind = 'update' and seq > done""")
def session_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that were open before, and a round of changes."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 41 == 0, "delete_all").when(F.col("event_id") % 5 == 0, "delete").otherwise("update")
    known = e.select(F.col("user_id").alias("session_id")).distinct().select("session_id", (-F.col("session_id")).alias("seq"))
    open_, due = W.after_changes(known, e.select(F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").alias("session_id")))
    return open_.join(due)


@query("""with known as (select distinct user_id as session_id, -user_id as seq from events
), e as (select event_id as seq, user_id, event_id % 6 as round from events
), c as (select seq, round, case round when 1 then 'update' when 2 then 'delete' when 3 then 'delete' when 4 then 'delete_all' else 'update' end as kind,
    case round when 0 then (select min(session_id) from known) when 2 then -user_id - 1 else user_id end as session_id from e where round < 5
), r as (select unnest([0, 1, 2, 3, 4, 5]) as round)
select round, (exists (select 1 from c where c.round = r.round and kind = 'delete' and session_id in (select session_id from known))
  or exists (select 1 from c where c.round = r.round and (kind = 'delete_all' or kind = 'update' and session_id <> (select min(session_id) from known)))) as due from r""")
def feed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of changes of several kinds, from the same sessions: only updates of the leader, of others, deletes of sessions unknown and known, an end of all, and nothing."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 6).alias("round"), F.col("user_id").alias("session_id"))
    known = e.select("session_id").distinct().select("session_id", (-F.col("session_id")).alias("seq"))
    leader = known.agg(F.min("session_id").alias("leader"))
    kinds, due = ["update", "update", "delete", "delete", "delete_all", "update"], []
    for k, kind in enumerate(kinds):
        own = e.filter((F.col("round") == k) & F.lit(k < 5)).select("seq", F.lit(kind).alias("kind"), (-F.col("session_id") - 1 if k == 2 else F.col("session_id")).alias("session_id"))
        if k == 0:
            own = own.drop("session_id").join(F.broadcast(leader)).withColumnRenamed("leader", "session_id")  # one row
        due.append(W.after_changes(known, own)[1].select(F.lit(k).alias("round"), "due"))
    return functools.reduce(DataFrame.unionAll, due)


# -- export and small rules -------------------------------------------------


@query(synth.SQL + "select doc_id, page_index, row_index, col_index, value, row_index = 0 as bold from grid")
def xlsx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as workbooks, read again."""
    folder = new_folder(spark, "sheets")
    write_pages(spark, synth.grid(spark, sf_dir), folder)
    return read_pages(spark, folder)


@query(
    " union all ".join(
        f"(with {name}_x as (" + sql + f") select doc_id, page_index, '{name}' as format, {name} as content from {name}_x)"
        for name, sql in (("csv", page_sql(CSV_CELL, "','", "chr(13) || chr(10)", "csv").replace("select *, value as v", f"select *, {GUARDED} as v")), ("txt", page_sql("v", "chr(9)", "chr(10)", "txt")))
    )
)
def export_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = odd_cells(spark, sf_dir)
    return X.exported(cells, "csv").unionAll(X.exported(cells, "txt"))


@query(synth.SQL.rstrip() + ODD_CELLS + "select doc_id, page_index, case doc_id % 3 when 0 then string_agg(value, '|' order by row_index, col_index) when 1 then 'stored' else '' end as shown from odd group by doc_id, page_index")
def rows_for_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.operators.edits import range_values

    held = range_values(odd_cells(spark, sf_dir)).select("*", F.when(F.col("doc_id") % 3 < 2, F.array(F.array(F.lit("stored")))).alias("stored"))
    cells = F.when(F.col("doc_id") % 3 == 0, F.col("rows")).when(F.col("doc_id") % 3 == 1, F.slice("rows", 1, 0))
    return X.rows_for_export(held.withColumn("cells", cells)).select("doc_id", "page_index", F.array_join(F.flatten("rows"), "|").alias("shown"))


@query("select doc_id, sha256(encode(substr(t, 4, 10))) as digest from (select doc_id, regexp_replace(text, '[^ -~]', '', 'g') as t from documents)")
def range_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.regexp_replace("text", "[^ -~]", "").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", M.digest_of_range(content, F.lit(3), F.lit(13)).alias("digest"))


@query("""select p_partkey, least(greatest(p_partkey % 500 - 50.0, 11.0), 299.0) as x, least(greatest(p_size * 3.0, 21.0), 99.0) as y, case when p_size > 26 then '2026–' || (2000 + p_size) else '2026' end as years,
  case when p_size % 4 = 1 then 'light' when p_size % 4 = 2 then 'dark' else 'system' end as theme, round(ln(greatest(25.0, least(400.0, p_partkey::double)) / 25.0) / ln(16.0), 9) as place, case when p_size % 3 > 0 then 'Make Markdown.' || chr(10) || chr(10) || p_name end as request from part""")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points pulled into a box, years, settings, a slider's place, and requests for texts with something to read."""
    k, size = F.col("p_partkey"), F.col("p_size")
    n = lambda x: F.lit(float(x))
    at = M.clamped_point((k % 500 - 50).cast("double"), (size * 3).cast("double"), n(10), n(20), n(300), n(100))
    years, years_to = F.lit(2026), F.lit(2000) + size
    theme = M.setting(pick(["", "light", "dark", "blue"], size % 4), ["light", "dark", "system"], "system")
    text = F.when(size % 3 > 0, F.col("p_name")).otherwise(" \n")
    rows = table(spark, sf_dir, "part").select("p_partkey", at.alias("at"), M.copyright_years(years, years_to).alias("years"), theme.alias("theme"), F.round(M.zoom_level(k.cast("double"))["place"], 9).alias("place"), M.markdown_request(text, "Make Markdown.").alias("request"))
    return rows.select("p_partkey", "at.x", "at.y", "years", "theme", "place", "request")


@query("""select s_suppkey, backend, case when need is not null and v is distinct from need then backend || ' needs a GPU by ' || need end as warning from (
  select s_suppkey, ['nvidia', 'amd', 'apple', null][s_suppkey % 4 + 1] as v, unnest(['cuda', 'rocm', 'metal', 'cpu']) as backend, unnest(['nvidia', 'amd', 'apple', null]) as need from supplier)""")
def backend_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendor = M.gpu_vendor(pick(["NVIDIA GeForce", "AMD Radeon", "Apple M2", "other"], F.col("s_suppkey") % 4))
    backend = F.explode(F.array(*map(F.lit, ["cuda", "rocm", "metal", "cpu"])))
    return table(spark, sf_dir, "supplier").select("s_suppkey", vendor.alias("v"), backend.alias("backend")).select("s_suppkey", "backend", M.backend_warning(F.col("backend"), F.col("v")).alias("warning"))


@query("select s_suppkey, case when s_suppkey % 3 > 0 then 'retry' when s_suppkey % 2 = 0 then 'restart' else 'quit' end as next from supplier")
def after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.after_removal(k % 3, F.when(k % 2 == 0, "reset").otherwise("uninstall")).alias("next"))


@query("select 'run/' || o_custkey % 10 || '/' || o_orderkey || '.part' as path, 'kept/' || o_orderkey || '.part' as \"to\" from orders where o_custkey % 10 = 1")
def copied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.copied(files(spark, sf_dir), "run/1/", "kept")


@query("""select doc_id, array_to_string(regexp_extract_all('see **' || source || '** and *' || lang || '* or `code ' || doc_id || '` at [the ' || lang || '](http://x/' || doc_id || ') end', '\\*\\*[^*]+\\*\\*|\\*[^*]+\\*|`[^`]+`|\\[[^\\]]+\\]\\([^)]+\\)'), '|') as spans from documents""")
def markdown_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see **"), "source", F.lit("** and *"), "lang", F.lit("* or `code "), "doc_id", F.lit("` at [the "), "lang", F.lit("](http://x/"), "doc_id", F.lit(") end"))
    return R.markdown_blocks(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text").select("doc_id", F.array_join("spans", "|").alias("spans"))


@query(synth.SQL + "select doc_id as session_id, page_index, row_index, col_index, value, concat_ws('-', row_index, col_index) as word_ids, 'matched' as match_status, row_index % 2 = 0 as verified from model")
def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.plans.edit_queries import cells

    body = F.struct("row_index", "col_index", "value", "word_ids", "match_status", "trust", "verified")
    held = cells(spark, sf_dir).groupBy(F.col("doc_id").alias("session_id"), "page_index").agg(F.to_json(F.collect_list(body)).alias("cell_mappings_json"))
    return I.stored_cells(held).select("session_id", "page_index", "row_index", "col_index", "value", F.array_join("word_ids", "|").alias("word_ids"), "match_status", "verified")
