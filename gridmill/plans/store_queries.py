"""Search and store queries. Conversations stand for sessions' pages, documents for stored tables, orders for keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import text as T
from gridmill.operators import store as S
from gridmill.operators import textindex as X
from gridmill.operators.hashed import HashedTable
from gridmill.operators.pages import LatestFirst
from gridmill.plans.registry import Registry, table
from gridmill.sources.shared import new_folder

query = Registry()
TERM = "THE"

BASE = """with sessions as (
  select doc_id as id, 'Title ' || source || ' ' || lang as title, timestamp '2024-01-01' + to_minutes((doc_id * 7919 % 100003)::bigint) as updated_at from documents
), outputs as (select doc_id as session_id, 0 as page_index, text as csv_content from documents
), pgs as (select conv_id as session_id, turn::int as page_index, text as full_text from conversations
), hits as (select s.*, (contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the')
   or exists (select 1 from pgs p where p.session_id = s.id and contains(translate(full_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the'))
   or exists (select 1 from outputs o where o.session_id = s.id and contains(translate(csv_content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the'))) as matched from sessions s)
"""


def store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    minutes = F.expr("make_interval(0, 0, 0, 0, 0, cast(doc_id * 7919 % 100003 as int), 0)")
    sessions = docs.select(F.col("doc_id").alias("id"), F.concat_ws(" ", F.lit("Title"), "source", "lang").alias("title"), (F.lit("2024-01-01").cast("timestamp_ntz") + minutes).alias("updated_at"))
    outputs = docs.select(F.col("doc_id").alias("session_id"), F.lit(0).alias("page_index"), F.col("text").alias("csv_content"))
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("page_index"), F.col("text").alias("full_text"))
    return sessions, pages, outputs


#: Indexes made in this session, by its id and the tables.
_INDEXES: dict[tuple[str, str], X.TextIndex] = {}
#: A term that a few texts of a hundred have.
RARE = "unGEN"
HAS_RARE = "contains(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ungen')"
RARE_HITS = BASE.replace("'the'", "'ungen'")


def stored_index(spark: SparkSession, sf_dir: str) -> X.TextIndex:
    """The index of all pages and tables, made when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _, pages, outputs = store(spark, sf_dir)
        _INDEXES[key] = X.index_pages(pages, outputs, new_folder(spark, "index"))
    return _INDEXES[key]


@query(BASE + "select id, title, matched from hits")
def content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term that most texts have: posting lists say so by their lengths, and the texts are scanned."""
    return X.matches(store(spark, sf_dir)[0], stored_index(spark, sf_dir), TERM).select("id", "title", "matched")


@query(BASE + "select sum(case when matched then 1 else 0 end)::bigint as matching, count(*) as total from hits")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.search_counts(store(spark, sf_dir)[0], stored_index(spark, sf_dir), TERM)


@query(RARE_HITS + "select id, title, matched from hits")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.matches(store(spark, sf_dir)[0], stored_index(spark, sf_dir), RARE).select("id", "title", "matched")


@query(RARE_HITS + "select sum(case when matched then 1 else 0 end)::bigint as matching, count(*) as total from hits")
def indexed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.search_counts(store(spark, sf_dir)[0], stored_index(spark, sf_dir), RARE)


@query(f"""select doc_id as id, (select arg_min(text, turn) from conversations where conv_id = doc_id and {HAS_RARE.format("text")}) as scan_match, case when {HAS_RARE.format("text")} then text end as table_match
  from documents where {HAS_RARE.format("text")} or doc_id in (select conv_id from conversations where {HAS_RARE.format("text")})
  union all select conv_id, arg_min(text, turn), null from conversations where {HAS_RARE.format("text")} and conv_id not in (select doc_id from documents) group by conv_id""")
def indexed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_texts(stored_index(spark, sf_dir), RARE)


@query(f"""select doc_id as session_id, 'table' as kind, 0 as page_index from documents where contains({HAS_RARE.format("text").removeprefix("contains(").removesuffix(", 'ungen')")}, 'th')
  union all select conv_id, 'scan', turn::int from conversations where contains({HAS_RARE.format("text").removeprefix("contains(").removesuffix(", 'ungen')")}, 'th')""")
def short_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two letters have no trigram: the stored texts are scanned."""
    return stored_index(spark, sf_dir).find("tH").drop("text")


@query(f"""with texts as (
  select doc_id as session_id, 'table' as kind, 0 as page_index, case when doc_id % 10 = 1 then 'Changed ' || lang || 'ungen' else text end as text from documents where doc_id % 10 <> 2
  union all select doc_id + 1000000000, 'table', 0, 'New JUNGEN ' || doc_id from documents where doc_id % 10 = 3
  union all select conv_id, 'scan', turn::int, text from conversations
) select * from texts where {HAS_RARE.format("text")}""")
def changed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are changed, added and removed after the index was made."""
    _, pages, outputs = store(spark, sf_dir)
    index = X.index_pages(pages, outputs, new_folder(spark, "index"))
    docs = table(spark, sf_dir, "documents")
    row = lambda where, key, text: docs.filter(where).select(key.alias("session_id"), F.lit("table").alias("kind"), F.lit(0).alias("page_index"), text.alias("text"))
    index.add(row("doc_id % 10 = 1", F.col("doc_id"), F.concat(F.lit("Changed "), "lang", F.lit("ungen"))).unionAll(row("doc_id % 10 = 3", F.col("doc_id") + 1000000000, F.concat(F.lit("New JUNGEN "), "doc_id"))))
    index.remove(row("doc_id % 10 = 2", F.col("doc_id"), F.col("text")))
    return index.find(RARE)


@query(BASE + """select id, title, updated_at::varchar as updated_at,
  (select full_text from pgs p where p.session_id = h.id and contains(translate(full_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') order by page_index limit 1) as scan_match,
  (select csv_content from outputs p where p.session_id = h.id and contains(translate(csv_content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') order by page_index limit 1) as table_match
  from (select * from hits where matched order by updated_at desc, id limit 10 offset 10) h""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_page(*store(spark, sf_dir), TERM, 2).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(BASE + """select n, id, title, updated_at::varchar as updated_at from (
  select *, 10 as size, row_number() over (order by updated_at desc, id) as turn, 'all' as list from sessions union all select id, title, updated_at, 10, row_number() over (order by updated_at desc, id), 'hits' from hits where matched
) join (select 'all' as list, 9 as n union all select 'hits', 7) using (list) where turn > (n - 1) * size and turn <= n * size
  union all select 1000000, id, title, updated_at::varchar from (select *, row_number() over (order by updated_at desc, id) as turn, count(*) over () as total from sessions) where turn > 10 * (ceil(total / 10) - 1)""")
def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 9 of all sessions, page 7 of those that match, and the last one, asked for by a number far too high."""
    sessions, pages, outputs = store(spark, sf_dir)
    stored = LatestFirst.create(sessions, new_folder(spark, "latest"))
    hits = S.matches(sessions, pages, outputs, TERM).filter("matched").select("id")
    some = [stored.page(n, hits=h).withColumn("n", F.lit(n)) for n, h in ((9, None), (7, hits), (1_000_000, None))]
    return some[0].unionByName(some[1]).unionByName(some[2]).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(BASE + """, turned as (select *, row_number() over (order by updated_at desc, id) as turn from sessions) select id, title, updated_at::varchar as updated_at from turned where turn > 100 and turn <= 110""")
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sessions after the hundredth, whose values are all that is known of it."""
    stored = LatestFirst.create(store(spark, sf_dir)[0], new_folder(spark, "latest"))
    last = stored.page(10).tail(1)[0]
    return stored.after(last["updated_at"], last["id"]).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""select doc_id, case when a > 0 then case when a - 48 > 1 then '…' else '' end || substr(flat, greatest(1, a - 48)::bigint, (a - greatest(1, a - 48))::bigint) end as before,
  case when a > 0 then substr(flat, a, 3) end as match, case when a > 0 then substr(flat, a + 3, 48) || case when a + 3 + 48 <= length(flat) then '…' else '' end end as after
  from (select doc_id, {FLAT} as flat, strpos(lower({FLAT}), 'the') as a from documents)""")
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), TERM).alias("s")).select("doc_id", "s.before", "s.match", "s.after")


FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(BASE + f""", shown as (select * from hits where matched order by updated_at desc, id limit 10
), texts as (select id, title, coalesce(
    (select full_text from pgs p where p.session_id = h.id and contains({FOLDED.format("full_text")}, 'the') order by page_index limit 1),
    (select csv_content from outputs p where p.session_id = h.id and contains({FOLDED.format("csv_content")}, 'the') order by page_index limit 1)) as text from shown h
), flats as (select id, title, {FLAT} as flat, strpos(lower({FLAT}), 'the') as a from texts)
select id, title, case when a > 0 then case when a - 48 > 1 then '…' else '' end || substr(flat, greatest(1, a - 48)::bigint, (a - greatest(1, a - 48))::bigint) end as before,
  case when a > 0 then substr(flat, a, 3) end as match, case when a > 0 then substr(flat, a + 3, 48) || case when a + 3 + 48 <= length(flat) then '…' else '' end end as after from flats""")
def search_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.excerpts(S.search_page(*store(spark, sf_dir), TERM, 1), TERM).select("id", "title", "excerpt.before", "excerpt.match", "excerpt.after")


@query(r"""select page_id, replace(replace(replace(url, '\', '\\'), '%', '\%'), '_', '\_') as escaped from pages""")
def escape_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.escape_like(F.col("url")).alias("escaped"))


@query("select event_id, case when event_id % 5 = 0 then 'n/a' else strftime(ts, '%Y-%m-%d') end as shown from events")
def shown_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", T.shown_timestamp(stored).alias("shown"))


@query("select user_id as id, max(ts)::varchar as updated_at from events group by user_id order by max(ts) desc, user_id limit 10")
def recent_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("updated_at"))
    return S.recent(users).withColumn("updated_at", F.regexp_replace(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0*\z", ""))


@query("select c_custkey as id, greatest(date '1990-01-01', coalesce(max(o_orderdate)::date, date '1990-01-01'))::varchar as updated_at from customer left join orders on o_custkey = c_custkey group by c_custkey")
def touch_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("1990-01-01").cast("date").alias("updated_at"))
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").cast("date").alias("ts"))
    return S.touched(sessions, events).withColumn("updated_at", F.col("updated_at").cast("string"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("content"), F.col("o_custkey").alias("created"))


@query("select o_orderkey as key, case when o_orderkey % 2 = 0 then 'new ' || o_orderkey else o_orderpriority end as content, o_custkey as created from orders union all select o_orderkey + 1000000000, 'new', 7 from orders where o_orderkey % 4 = 1")
def upsert_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _orders(spark, sf_dir)
    new = old.filter("key % 2 = 0").select("key", F.concat(F.lit("new "), "key").alias("content"), F.lit(-1).cast("long").alias("created"))
    new = new.unionAll(old.filter("key % 4 = 1").select(F.col("key") + 1000000000, F.lit("new"), F.lit(7).cast("long")))
    return S.upsert(old, new, ["key"], ["content"])


@query("select o_orderkey as key, o_orderpriority as content, o_custkey as created from orders union all select o_orderkey + 1000000000, 'new', 7 from orders where o_orderkey % 4 = 1")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _orders(spark, sf_dir)
    new = old.select(F.when(F.col("key") % 4 == 1, F.col("key") + 1000000000).otherwise(F.col("key")).alias("key"), F.lit("new").alias("content"), F.lit(7).cast("long").alias("created"))
    return S.insert_ignore(old, new, ["key"])


@query("select o_orderkey as key, case when o_orderkey % 3 = 0 then 'edited' else o_orderpriority end as content, o_custkey as created from orders")
def update_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _orders(spark, sf_dir)
    return S.update_where(old, old.filter("key % 3 = 0").select("key", F.lit("edited").alias("content")).unionAll(old.select(F.col("key") + 1000000000, F.lit("lost"))), ["key"])


CHANGED = "o_orderkey % 50 = 7 or o_orderkey between 100 and 120"


@query(f"select o_orderkey as key, case when {CHANGED} then 'new ' || o_orderkey else o_orderpriority end as content, o_custkey as created from orders union all select o_orderkey + 1000000000, 'new', 7 from orders where o_orderkey % 64 = 1")
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``upsert_outputs`` of a stored table: buckets with changes are rewritten, others stay as they are. Older rows of a key come too."""
    old = _orders(spark, sf_dir)
    stored = HashedTable.create(old, new_folder(spark, "outputs"), ["key"])
    new = old.filter(CHANGED.replace("o_orderkey", "key")).select("key", F.concat(F.lit("new "), "key").alias("content"), F.lit(-1).cast("long").alias("created"), F.lit(2).alias("at"))
    older = new.select("key", F.lit("older").alias("content"), "created", F.lit(1).alias("at"))
    added = old.filter("key % 64 = 1").select((F.col("key") + 1000000000).alias("key"), F.lit("new").alias("content"), F.lit(7).cast("long").alias("created"), F.lit(0).alias("at"))
    stored.upsert(new.unionAll(older).unionAll(added), ["content"], [F.col("at")])
    return stored.read()


@query(f"select o_orderkey as key, case when {CHANGED} then 'edited' else o_orderpriority end as content, o_custkey as created from orders")
def stored_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _orders(spark, sf_dir)
    stored = HashedTable.create(old, new_folder(spark, "outputs"), ["key"])
    stored.update(old.filter(CHANGED.replace("o_orderkey", "key")).select("key", F.lit("edited").alias("content")).unionAll(old.select(F.col("key") + 1000000000, F.lit("lost"))))
    return stored.read()


@query("select o_orderkey as key, o_orderpriority as content, o_custkey as created from orders union all select o_orderkey + 1000000000, 'new', 7 from orders where o_orderkey % 64 = 1")
def stored_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``insert_ignore`` of a stored table: what is stored is read as keys only, and no file of it changes."""
    old = _orders(spark, sf_dir)
    stored = HashedTable.create(old, new_folder(spark, "outputs"), ["key"])
    stored.insert(old.filter("key % 64 < 2").select(F.when(F.col("key") % 64 == 1, F.col("key") + 1000000000).otherwise(F.col("key")).alias("key"), F.lit("new").alias("content"), F.lit(7).cast("long").alias("created")))
    return stored.read()


@query(f"select o_orderkey as key, o_orderpriority as content, o_custkey as created from orders where {CHANGED}")
def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _orders(spark, sf_dir)
    stored = HashedTable.create(old, new_folder(spark, "outputs"), ["key"])
    return stored.lookup(old.filter(CHANGED.replace("o_orderkey", "key")).select("key"))


@query("select o_custkey as key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order from orders group by o_custkey")
def last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("last_order"), "o_orderdate")
    return S.last_write(rows, ["key"], [F.col("o_orderdate"), F.col("last_order")]).select("key", "last_order")


def _store_of_orders(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    session = F.col("o_orderkey").alias("session_id")
    return {
        "sessions": orders.select(F.col("o_orderkey").alias("id")),
        "files": orders.select(session, F.concat(F.lit("f/"), F.col("o_custkey")).alias("file_path")),
        "document_pages": items.select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_linenumber") > 2, F.concat(F.lit("p/"), F.col("l_suppkey"))).otherwise("").alias("image_path")),
        "csv_outputs": orders.select(session),
        "document_page_sets": orders.select(session),
    }


@query("""select 'path' as kind, path, 1::bigint as n from (select 'f/' || o_custkey as path from orders where o_orderkey % 5 = 0 union select 'p/' || l_suppkey from lineitem where l_orderkey % 5 = 0 and l_linenumber > 2)
  union all select 'pages', null, count(*) from lineitem where l_orderkey % 5 <> 0 union all select 'sessions', null, count(*) from orders where o_orderkey % 5 <> 0""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = _store_of_orders(spark, sf_dir)
    left, paths = S.without_sessions(all_, all_["sessions"].filter("id % 5 = 0"))
    counts = [left[t].agg(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("path"), F.count("*").alias("n")) for k, t in (("pages", "document_pages"), ("sessions", "sessions"))]
    return paths.select(F.lit("path").alias("kind"), "path", F.lit(1).cast("long").alias("n")).unionAll(counts[0]).unionAll(counts[1])


@query("select l_orderkey as session_id, count(*) = 1 + l_orderkey % 7 as complete from lineitem group by l_orderkey")
def cache_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    return S.cache_complete(pages, pages.distinct().withColumn("page_count", 1 + F.col("session_id") % 7))


@query("select user_id, event_id as version from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n <= 50")
def undo_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.retained_versions(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version")), ["user_id"])
