"""Sessions laid out by their last activity, so that any page of a long list costs what the first one does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part"


class LatestFirst:
    """Sessions in folders of falling activity (``updated_at``, ties by ``id``): all of a folder come before all of the next."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, sessions: DataFrame, path: str, parts: int | None = None) -> LatestFirst:
        """Stores sessions by one exchange into ranges; those without activity come last."""
        latest = [F.col("updated_at").desc_nulls_last(), F.col("id").asc()]
        dealt = sessions.repartitionByRange(parts, *latest) if parts else sessions.repartitionByRange(*latest)
        dealt.withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *latest).write.partitionBy(PART).parquet(path)
        return cls(sessions.sparkSession, path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def page(self, n: int, size: int = 10, hits: DataFrame | None = None) -> DataFrame:
        """Page ``n`` of the sessions, or of those whose ``id`` is in ``hits``, the latest first; past the end it is the last page.

        Counts by folder, a row each, say in which folders the page lies; only those are read and sorted, whatever ``n`` is.
        """
        rows = self.read() if hits is None else self.read().join(hits.select("id").distinct(), "id", "left_semi")
        counts = [(r[PART], r["n"]) for r in rows.groupBy(PART).agg(F.count("*").alias("n")).orderBy(PART).collect()]  # as many as there are folders
        total = sum(n for _, n in counts)
        start = size * (min(max(n, 1), max(1, -(-total // size))) - 1)
        inside, before, skipped = [], 0, 0
        for part, count in counts:
            if before + count <= start:
                skipped = before + count
            elif before < start + size:
                inside.append(part)
            before += count
        latest = [F.col("updated_at").desc_nulls_last(), F.col("id").asc()]
        return rows.filter(F.col(PART).isin(inside)).drop(PART).orderBy(*latest).offset(start - skipped).limit(size)

    def after(self, updated_at, id, size: int = 10, hits: DataFrame | None = None) -> DataFrame:  # noqa: A002
        """The ``size`` sessions after one of these values: a filter on ``updated_at`` goes to the scan, which skips what is later by its statistics."""
        rows = self.read()
        if updated_at is None:
            rows = rows.filter(F.col("updated_at").isNull() & (F.col("id") > id))
        else:
            last = F.lit(updated_at)
            rows = rows.filter((F.col("updated_at") <= last) | F.col("updated_at").isNull()).filter((F.col("updated_at") < last) | F.col("updated_at").isNull() | (F.col("id") > id))
        if hits is not None:
            rows = rows.join(hits.select("id").distinct(), "id", "left_semi")
        return rows.drop(PART).orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").asc()).limit(size)
