"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that the contracts split words at.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset (a local session)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="grovetag-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Settings while a table is written: its shuffles go as soon as it is there, and texts go to Python in smaller batches.
WRITING = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_changing = threading.Lock()
_writers: dict[str, list] = {}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """WRITING holds within; the session gets its own values back when the last of several threads is done."""
    session = spark._jsparkSession.sessionUUID()
    with _changing:
        own = _writers.setdefault(session, [0, {k: spark.conf.get(k, None) for k in WRITING}])
        own[0] += 1
        for k, v in WRITING.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _changing:
            own[0] -= 1
            if not own[0]:
                for k, v in own[1].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)
                del _writers[session]


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read again: later steps start from the files, also after the loss of executors."""
    path = scratch_path(df.sparkSession, label)
    with writing(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() whose readers have all been written themselves."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(t.stored_path)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Returns the memory that this process holds no more to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives the memory that it holds no more back to the system: workers live on, beside other tasks."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows, so that what Python makes of a piece stays small."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def most_frequent(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the largest counts in a column, `most` at most: all those above a cut that a histogram of the counts gives (no sort, and nothing but the histogram goes to the driver)."""
    n = F.col(column)
    step = F.when(n < 1024, n).otherwise(1024 + F.floor(64 * F.log2(n / 1024))).cast("long")
    held, cut = 0, None
    for r in sorted(rows.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > most:
            break
        cut = r["step"]
    return rows.where(step >= cut) if cut is not None else rows.limit(0)


def running(sums: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before): the sum of value over all smaller keys, of a table with one row for each key (a long, at least 0). Keys are summed in blocks of 4096, and the blocks' sums, in one task, are as few."""
    block = F.floor(F.col(key) / 4096).alias("block__")
    rows = sums.select(key, value, block)
    earlier = Window.orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block__").agg(F.sum(value).alias("n__")).select("block__", F.coalesce(F.sum("n__").over(earlier), F.lit(0)).alias("base__"))
    within = Window.partitionBy("block__").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("n__", F.coalesce(F.sum(value).over(within), F.lit(0))).join(blocks, "block__").select(key, (F.col("n__") + F.col("base__")).alias("before"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
