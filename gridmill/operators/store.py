"""The store of sessions, pages and tables: search, upserts, deletes, migrations. Tables are DataFrames; a change gives the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions.text import contains_folded, snippet

PAGE_SIZE = 10


def matches(sessions: DataFrame, pages: DataFrame, outputs: DataFrame, term: str) -> DataFrame:
    """Sessions with ``matched``: the term is in the title, a page or a table of theirs. An empty term matches all."""
    hit = lambda df, col: df.filter(contains_folded(F.col(col), term)).select(F.col("session_id").alias("id")).distinct()
    found = hit(pages, "full_text").unionAll(hit(outputs, "csv_content")).distinct().withColumn("_hit", F.lit(True))
    joined = sessions.join(found, "id", "left")
    return joined.withColumn("matched", contains_folded(F.col("title"), term) | F.col("_hit").isNotNull() | F.lit(term == "")).drop("_hit")


def search_counts(sessions: DataFrame, pages: DataFrame, outputs: DataFrame, term: str) -> DataFrame:
    """One row: ``matching`` and ``total`` sessions."""
    return matches(sessions, pages, outputs, term).agg(F.count_if("matched").alias("matching"), F.count("*").alias("total"))


def first_match(rows: DataFrame, col: str, term: str, name: str) -> DataFrame:
    """The text of each session's first page, by index, that has the term."""
    return rows.filter(contains_folded(F.col(col), term)).groupBy("session_id").agg(F.min_by(col, "page_index").alias(name)).withColumnRenamed("session_id", "id")


def search_page(sessions: DataFrame, pages: DataFrame, outputs: DataFrame, term: str, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of matching sessions, the latest first (ties by id), with the texts that matched; a page past the end is the last.

    Texts are scanned once to find what matches, without an exchange of them. The first rows up to the page asked for say
    whether there is such a page. Its ids, ``size`` at most, then select whose texts are read for the excerpts.
    """
    page = max(1, page)
    found = matches(sessions, pages, outputs, term).filter("matched").drop("matched")
    latest = [F.col("updated_at").desc(), F.col("id")]
    first = found.orderBy(*latest).limit(page * size)  # so many rows at most
    turn, n = F.row_number().over(Window.orderBy(*latest)), F.count("*").over(Window.partitionBy())
    last = F.least(F.lit(page), F.ceil(n / size))
    numbered = first.withColumns({"_turn": turn, "_last": last}).filter(F.ceil(F.col("_turn") / size) == F.col("_last")).drop("_turn", "_last")
    shown = sessions.sparkSession.createDataFrame(numbered.collect(), numbered.schema)
    ids = [r["id"] for r in shown.select("id").collect()]
    texts = lambda rows, col, name: first_match(rows.filter(F.col("session_id").isin(ids)), col, term, name)
    return shown.join(texts(pages, "full_text", "scan_match"), "id", "left").join(texts(outputs, "csv_content", "table_match"), "id", "left")


def excerpts(found: DataFrame, term: str) -> DataFrame:
    """Adds ``excerpt``: from the page that matched, else from the table."""
    return found.withColumn("excerpt", F.coalesce(snippet(F.col("scan_match"), term), snippet(F.col("table_match"), term)))


def recent(sessions: DataFrame, n: int = 10) -> DataFrame:
    return sessions.orderBy(F.col("updated_at").desc(), "id").limit(n)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` whose key isn't stored are added; of several of one key the first by ``order``, of equal ones the least by all columns, nulls last."""
    rank = [c.asc_nulls_last() for c in [*(order or []), *[F.col(c) for c in new.columns if c not in keys]]] or [F.lit(0).asc()]
    one = new.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank))).filter("_turn = 1").drop("_turn")
    return stored.unionByName(one.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def last_write(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Rows of ``new`` are added, or replace ``update`` of the stored row of their key; its other columns stay."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in stored.columns if c not in keys], F.lit(True).alias("_is_new"))
    s = stored.withColumn("_is_old", F.lit(True))
    both = s.join(n, keys, "full_outer")
    pick = lambda c: F.when(F.col("_is_new") & (F.col("_is_old").isNull() | F.lit(c in update)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.col(c) if c in keys else pick(c) for c in stored.columns])


def update_where(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the columns of ``changes`` where it has their key; other rows of ``changes`` do nothing."""
    cols = [c for c in changes.columns if c not in keys]
    joined = stored.join(changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit")), keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in stored.columns])


def touched(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """``updated_at`` as the latest of what is stored and each session's events (session_id, ts)."""
    latest = events.groupBy(F.col("session_id").alias("id")).agg(F.max("ts").alias("_ts"))
    return sessions.join(latest, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_ts")).drop("_ts")


CHILDREN = ["csv_outputs", "document_pages", "document_page_sets", "files"]


def without_sessions(store: dict[str, DataFrame], ids: DataFrame | None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The store without these sessions (all, if None) and what hangs on them; and the distinct paths of files that nobody needs then."""
    keep = lambda df, key: df.limit(0) if ids is None else df.join(ids.select(F.col("id").alias(key)), key, "left_anti")
    gone = lambda df, key: df if ids is None else df.join(ids.select(F.col("id").alias(key)), key, "left_semi")
    paths = gone(store["files"], "session_id").select(F.col("file_path").alias("path")).unionAll(gone(store["document_pages"], "session_id").select(F.col("image_path").alias("path")))
    left = {name: keep(store[name], "session_id") for name in CHILDREN} | {"sessions": keep(store["sessions"], "id")}
    return left, paths.filter("path is not null and path != ''").distinct()


def cache_complete(pages: DataFrame, markers: DataFrame) -> DataFrame:
    """``session_id, complete``: a session's pages may be used only if its marker counts as many as there are."""
    counts = pages.groupBy("session_id").agg(F.count("*").alias("n"))
    return counts.join(markers.select("session_id", "page_count"), "session_id", "left").select("session_id", F.coalesce(F.col("n") == F.col("page_count"), F.lit(False)).alias("complete"))


def merged_order(shown: list, fresh: list, key=lambda x: x) -> list:
    """Entries that stay keep the order shown, with fresh content; new ones come in at their fresh place."""
    by_key = {key(x): x for x in fresh}
    out = [by_key[key(x)] for x in shown if key(x) in by_key]
    known = {key(x) for x in shown}
    for i, x in enumerate(fresh):
        if key(x) not in known:
            out.insert(min(i, len(out)), x)
    return out


def retained_versions(log: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    """The last ``n`` snapshots of each grid in an undo log (``version`` counts up)."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("version").desc()))
    return log.withColumn("_turn", turn).filter(F.col("_turn") <= n).drop("_turn")


def discarded_pages(store: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The store without the cached pages of these sessions and their markers; and the distinct image paths that nobody needs then."""
    key = ids.select(F.col("id").alias("session_id"))
    left = dict(store) | {name: store[name].join(key, "session_id", "left_anti") for name in ("document_pages", "document_page_sets")}
    gone = store["document_pages"].join(key, "session_id", "left_semi")
    return left, gone.select(F.col("image_path").alias("path")).filter("path is not null and path != ''").distinct()


def inserted(sessions: DataFrame, files: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and files with new ones (id, title, file_id, file_name, file_path, failed); where the upload failed, neither row stays."""
    done = new.filter(~F.coalesce(F.col("failed"), F.lit(False)))
    rows = done.select(F.col("file_id").alias("id"), F.col("id").alias("session_id"), "file_name", "file_path")
    return sessions.unionByName(done.select("id", "title"), allowMissingColumns=True), files.unionByName(rows)


def looked_up(store: dict[str, DataFrame], ids: DataFrame, page_index: int) -> DataFrame:
    """For each session asked for: name and path of its file (of several, the least id's), the stored table of a page, and how many images it has."""
    asked = ids.select(F.col("id").alias("session_id"))
    mine = lambda name: store[name].join(asked, "session_id", "left_semi")
    file = mine("files").groupBy("session_id").agg(F.min_by(F.struct("file_name", "file_path"), "id").alias("f")).select("session_id", "f.*")
    table = mine("csv_outputs").filter(F.col("page_index") == page_index).select("session_id", "csv_content")
    images = mine("document_pages").filter("image_path is not null and image_path != ''").groupBy("session_id").agg(F.count("*").alias("images"))
    return asked.join(file, "session_id", "left").join(table, "session_id", "left").join(images, "session_id", "left").withColumn("images", F.coalesce("images", F.lit(0)).cast("long"))


def merged_orders(shown: Column, fresh: Column) -> Column:
    """``merged_order`` of two arrays of ids."""
    stay = F.filter(shown, lambda x: F.array_contains(fresh, x))
    new = F.filter(F.transform(fresh, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: ~F.array_contains(shown, e["x"]))

    def put(acc: Column, e: Column) -> Column:
        at = F.least(e["i"], F.size(acc))
        return F.concat(F.slice(acc, F.lit(1), at), F.array(e["x"]), F.slice(acc, at + 1, F.size(acc)))

    return F.aggregate(new, stay, put)


def pending_migrations(statements: DataFrame, current: DataFrame) -> DataFrame:
    """Statements (version, step, text) of versions above the stored one (``version``, one row; none is 0), with their turn."""
    stored = current.agg(F.coalesce(F.max("version"), F.lit(0)).alias("_stored"))
    due = statements.join(stored, F.col("version") > F.col("_stored")).drop("_stored")
    return due.withColumn("turn", F.row_number().over(Window.orderBy("version", "step")))


def run_migrations(spark: SparkSession, statements: list[tuple[int, str]], version_table: str) -> int:
    """Runs what is due, in order, and stores each version once all of its statements are through. Statements are written so that they can run again.

    Returns the version that the store has then.
    """
    spark.sql(f"create table if not exists {version_table} (version int) using parquet")
    at = spark.table(version_table).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    for version in sorted({v for v, _ in statements if v > at}):
        for text in (t for v, t in statements if v == version):
            spark.sql(text)
        spark.sql(f"insert into {version_table} values ({version})")
        at = version
    return at
