"""The token store built from a stream of entity rows.

Each micro-batch writes its own merged tags under its number, so a batch that is delivered again
replaces what it wrote before (exactly once). Reading merges all batches; compact() folds
them into one, and later reads start from there. Nothing is rewritten per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import store

ENTITY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "name", "value", "normalised_value")] + [T.StructField("ancestors", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]
)
TAG = "key string, tag_type string, name string, total_count long, normalised_value string, ref_tag_type string, ancestors map<string,array<string>>"


def start(entities: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
    """Starts the build; every=None takes what is there and stops."""

    def write(batch: DataFrame, number: int) -> None:
        store.merge_tags(store.emit_tokens(batch)).write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    writer = entities.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def entity_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(ENTITY).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().toString() for x in fs.listStatus(where)] if fs.exists(where) else []
    return {int(n.rpartition("=")[2]): n for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))}


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """All tags so far, one row for each record and tag."""
    whole, batches = _folders(spark, f"{path}/compacted"), _folders(spark, f"{path}/batches")
    last = max(whole, default=-1)
    found = [p for n, p in whole.items() if n == last] + [p for n, p in batches.items() if n > last]
    rows = spark.read.schema(TAG).parquet(*found) if found else spark.createDataFrame([], TAG)
    return store.merge_stores(rows.limit(0), rows)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return store.store_of_tags(read_tags(spark, path))


def compact(spark: SparkSession, path: str) -> None:
    batches = _folders(spark, f"{path}/batches")
    if batches:
        read_tags(spark, path).write.mode("overwrite").parquet(f"{path}/compacted/upto={max(batches)}")


def tag_counts(entities: DataFrame) -> DataFrame:
    """The same counts as a streaming aggregation, for sinks in update mode."""
    return store.emit_tokens(entities).groupBy("key", "tag_type", "name").agg(F.count(F.lit(1)).alias("total_count"))
