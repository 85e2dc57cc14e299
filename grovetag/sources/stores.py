"""Where the token store lives: tables that are created and dropped on request, and versions in files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

METADATA_SUFFIX, TOKEN_SUFFIX = "_metadata_store", "_token_store"
#: Setting that turns token stores on for an instance; off unless set.
ENABLED = "spark.grovetag.tokenStore.enabled"


def token_table(name: str) -> str:
    """Table of the token store that belongs to an instance or to its metadata table."""
    return name.lower().removesuffix(METADATA_SUFFIX) + TOKEN_SUFFIX


def enabled(spark: SparkSession) -> bool:
    return spark.conf.get(ENABLED, "false").lower() == "true"


def create_store(spark: SparkSession, name: str, rows: DataFrame) -> bool:
    """Writes rows as the token store of an instance unless it exists (False)."""
    if spark.catalog.tableExists(token_table(name)):
        return False
    rows.write.saveAsTable(token_table(name))
    return True


def drop_store(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {token_table(name)}")


def lookup(spark: SparkSession, name: str, keys: DataFrame) -> DataFrame:
    """Records of the keys; of the store's columns only those that are used are read."""
    return spark.table(token_table(name)).join(keys.select("key"), "key", "left_semi")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share (spark.checkpoint.dir; a temporary one in a local session without it)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="grovetag-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows as a table in a new shared folder: a store is built once and then read by each query, with its columns pruned."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
