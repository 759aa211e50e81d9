"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share. A temporary folder is taken only where it is unset and there is no cluster (tests)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: the lineage ends there, and every executor can read it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of steps that are done. It does so when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder_is(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Bytes of input, as files have them, for each group of texts.
GROUP_BYTES = 32 << 20


def input_bytes(docs: DataFrame) -> int:
    """The size of the tables that ``docs`` reads, as far as it is known without running anything."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)  # what is not known counts as the largest number there is


def text_partitions(docs: DataFrame, per_shuffle_partition: int = 2) -> int:
    """How many groups whole texts are dealt into, so that one group fits a task: it follows the input, and is no less than the session's shuffle setting says."""
    return max(8, per_shuffle_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // GROUP_BYTES))


def small_runs(texts: list[str], most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with few characters each, so that what is made of them stays small. A long text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings; null becomes empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
