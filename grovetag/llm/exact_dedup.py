"""Exact deduplication by content sort, with DataFrame operations only.

Sampled splitters range-partition the normalised bytes, an external sort in each
partition puts equals side by side, and the window operator compares each row's
whole text with its neighbour's. A text with more rows than one partition should hold is
salted, so it becomes several runs; the runs' leaders are compared once more.

Cases: a null text is the empty text, all empty texts are one group; a null doc_id
sorts after all others; of rows that agree in text and doc_id one stays; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, shuffle_partitions, stored, text_or_empty

#: Least number of equal rows that are worth salting.
LEAST_HOT = 64
#: Characters of a text that the splitters hold.
PREFIX = 32


def normalised(text: Column) -> Column:
    """text without white space; replace() works on bytes and skips texts that lack the character."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)


def hot_hashes(rows: DataFrame, partitions: int) -> tuple[list[tuple[int, int]], int]:
    """(hash, number of salts) of the texts with more rows than a partition's even share, fewer than 2 * partitions of them."""
    counts = rows.groupBy(F.xxhash64("norm").alias("hash")).count()
    total = rows.count()
    share = max(LEAST_HOT, total // (2 * partitions))
    found = counts.where(F.col("count") > share).collect()
    return [(r["hash"], 2 * -(-r["count"] // share)) for r in found], share


def exact_groups(docs: DataFrame, keep: str = "longest", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and with carry the document as a struct `record`.

    keep: 'longest' keeps the row with the most code points and then the smallest doc_id, 'smallest' the smallest doc_id.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id"),
        (F.length(text_or_empty()) if keep == "longest" else F.lit(0)).alias("n_points"),
        normalised(text_or_empty()).alias("norm"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")] if carry else []),
    )
    hot, _ = hot_hashes(rows.select("norm"), shuffle_partitions(spark))
    # splitters are sampled from the first characters and a hash, which keeps the sample small; equal texts agree in both
    rows = rows.withColumn("prefix", F.substring("norm", 1, PREFIX)).withColumn("hash", F.xxhash64("norm"))
    if hot:
        # at most 2 * partitions rows, as each stands for more than rows / (2 * partitions) rows
        salts = F.broadcast(spark.createDataFrame(hot, "hash long, salts long"))
        rows = rows.join(salts, "hash", "left")
        rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("salts")), F.lit(0))).withColumn("hot", F.col("salts").isNotNull()).drop("salts")
    else:
        rows = rows.withColumn("hot", F.lit(False))
    places = ["prefix", "hash", *(["salt"] if hot else [])]
    extra = ["record"] if carry else []

    rows = rows.drop("norm") if carry else rows  # it is made again from the record's text, so that the text moves once
    rows = rows.repartitionByRange(*places)
    rows = rows.withColumn("norm", normalised(F.coalesce("record.text", F.lit("")))) if carry else rows
    run = Window.partitionBy(*places, "norm").orderBy(F.col("n_points").desc(), F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = rows.select(
        "doc_id", "hot", *(["salt"] if hot else []), "norm", *extra,
        F.row_number().over(run).alias("place"),
        F.first("doc_id").over(whole).alias("run_keep"),
        F.first("n_points").over(whole).alias("run_points"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
    ).withColumn("text_sha256", F.sha2(F.encode("norm", "utf-8"), 256))
    if not hot:
        return runs.select("doc_id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256", *extra)

    leads = F.col("hot") & (F.col("place") == 1)
    runs = stored(runs.withColumn("norm", F.when(leads, F.col("norm"))), "exact-runs")
    best = F.min(F.struct((-F.col("run_points")).alias("less"), F.col("run_keep").isNull().alias("no_id"), F.col("run_keep").alias("id"), F.col("salt").alias("salt")))
    groups = (
        runs.where(leads).groupBy("norm")
        .agg(best.alias("best"), F.sum("run_size").alias("size"), F.first("text_sha256").alias("text_sha256"))
        .select("text_sha256", F.col("best.id").alias("hot_keep"), F.col("best.salt").alias("hot_salt"), "size")
    )
    out = runs.drop("norm").join(F.broadcast(groups), "text_sha256", "left")  # one row for each hot text
    return out.select(
        "doc_id",
        F.when(F.col("hot"), F.col("hot_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.when(F.col("hot"), F.col("size")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | (F.col("salt") == F.col("hot_salt")))).alias("kept"),
        "text_sha256",
        *extra,
    )


def deduplicated(docs: DataFrame, keep: str = "longest") -> DataFrame:
    """docs without the rows that exact_groups drops."""
    return exact_groups(docs, keep, carry=True).where("kept").select("record.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id ASC NULLS LAST)
"""
