"""Parquet tables laid out by the hash of their key, of which a change rewrites the touched buckets only.

A bucket is a partition folder with one bucketed file, so Spark knows where a key lies: a join by the key exchanges the
changes alone, and a dynamic partition overwrite replaces the folders that have changes and leaves all others as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators.store import last_write, update_where, upsert

#: Bytes that a bucket should hold at most when a table is made, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 256 << 20, 16
PART = "bucket"
#: Keys that a lookup hands to the scan by their values, at most.
FEW = 1_000


def buckets_for(df: DataFrame) -> int:
    """Buckets for a table of the size that Spark expects of ``df``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(LEAST_BUCKETS, -(-size // BUCKET_BYTES) if size < 1 << 60 else 0), 100_000)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class HashedTable:
    """A table under ``path`` with ``buckets`` buckets by ``keys``. Keys are never null: rows without a key are not stored."""

    def __init__(self, spark: SparkSession, name: str, path: str, keys: list[str], buckets: int):
        self.spark, self.name, self.path, self.keys, self.buckets = spark, name, path, keys, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int | None = None, name: str | None = None) -> HashedTable:
        """Stores ``rows``, one for each key, by one exchange."""
        made = cls(rows.sparkSession, name or f"hashed_{uuid.uuid4().hex}", path, keys, buckets or buckets_for(rows))
        dealt = made._with_part(rows).repartition(made.buckets, *keys)
        dealt.write.partitionBy(PART).bucketBy(made.buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(made.name)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int, name: str | None = None) -> HashedTable:
        """A table that another session stored: ``schema`` names its columns in their order."""
        made = cls(spark, name or f"hashed_{uuid.uuid4().hex}", path, keys, buckets)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"create table {made.name} ({schema}, {PART} int) using parquet partitioned by ({PART}) clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
        spark.catalog.recoverPartitions(made.name)
        return made

    def part(self) -> Column:
        """The bucket of a row: the same hash that Spark deals rows by."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _with_part(self, rows: DataFrame) -> DataFrame:
        return rows.dropna(subset=self.keys).withColumn(PART, self.part())

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(PART)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that have keys of ``rows``: at most as many as the table has."""
        return sorted(r[0] for r in rows.dropna(subset=self.keys).select(self.part().cast("int").alias("p")).distinct().collect())

    def stored(self, touched: list[int]) -> DataFrame:
        """Rows of some buckets; the others' files are not listed."""
        return self.spark.table(self.name).filter(F.col(PART).isin(touched)).drop(PART)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Stored rows whose key is in ``keys``: the buckets that can have them are read, and not exchanged. Up to ``FEW`` keys go to the scan as a filter, so files skip what their statistics exclude."""
        asked = keys.select(*self.keys).dropna().distinct()
        first = asked.limit(FEW + 1).collect()
        if len(first) > FEW or not first:
            return self.stored(self.buckets_of(asked)).join(asked, self.keys, "left_semi")
        few = self.spark.createDataFrame(first, asked.schema)
        found = self.stored(self.buckets_of(few))
        for k in self.keys:
            found = found.filter(F.col(k).isin([r[k] for r in first]))
        return found if len(self.keys) == 1 else found.join(F.broadcast(few), self.keys, "left_semi")  # FEW rows at most

    def append(self, rows: DataFrame) -> None:
        """Adds rows of new keys, as further files of their buckets."""
        dealt = self._with_part(rows).repartition(self.buckets, *self.keys)
        dealt.select(*self.spark.table(self.name).columns).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def _rewrite(self, rows: DataFrame) -> None:
        columns = self.spark.table(self.name).columns
        with _setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            self._with_part(rows).select(*columns).write.insertInto(self.name, overwrite=True)
        self.spark.catalog.refreshTable(self.name)

    def merged(self, new: DataFrame, update: list[str], order: list[Column] | None = None) -> DataFrame:
        """What ``upsert`` puts into the touched buckets."""
        new = self._last(new, order)
        return upsert(self.stored(self.buckets_of(new)), new, self.keys, update)

    def _last(self, new: DataFrame, order: list[Column] | None) -> DataFrame:
        rest = [F.col(c) for c in new.columns if c not in self.keys]
        dealt = new.dropna(subset=self.keys).repartition(self.buckets, *self.keys)  # as the table is: the join needs no other exchange
        return last_write(dealt, self.keys, [*(order or []), *rest])

    def upsert(self, new: DataFrame, update: list[str], order: list[Column] | None = None) -> None:
        """Adds rows, or replaces ``update`` of the stored row of their key. Of several rows of a key the last by ``order`` counts, of equal ones the greatest. The same call again changes nothing."""
        self._rewrite(self.merged(new, update, order))

    def update(self, changes: DataFrame, order: list[Column] | None = None) -> None:
        """Replaces the columns of ``changes`` in the stored rows of their keys; keys that are not stored do nothing."""
        changes = self._last(changes, order)
        self._rewrite(update_where(self.stored(self.buckets_of(changes)), changes, self.keys))

    def insert(self, new: DataFrame, order: list[Column] | None = None) -> None:
        """Adds rows of keys that are not stored; others are ignored. Of several rows of a new key the last by ``order`` counts, of equal ones the greatest."""
        new = self._last(new, order)
        known = self.stored(self.buckets_of(new)).select(*self.keys)
        self.append(new.join(known, self.keys, "left_anti"))
