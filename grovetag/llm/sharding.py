"""Two-pass external shuffle into shards, with DataFrame operations only.

Pass one scatters whole records into buckets of bounded size by a seeded hash. Pass
two brings each bucket's records into the order of two more hashes, by an external sort, and
Fisher-Yates shuffles the bucket's places (Spark's seeded shuffle() of an array of numbers, one
bucket at a time); the record of rank i takes the place that stands at i. A bucket's offset in the global order is the number of
records in the buckets before it, and record g goes to place g // shards of
shard g % shards, so the shards' row counts differ by one at most (law `rows`). Places follow from the seed
and the records alone: tasks that run again and other partitionings give the same.

Rows that are equal in doc_id and text share their bucket; where a bucket grows to over SPLIT times
its size, equal rows that fill a bucket by themselves are dealt over as many buckets as they fill, by their place in the
input (only then do places depend on how the input is partitioned).

Cases: a null text counts no bytes and stays null; repeated rows are separate
records; an empty table gives no rows; further columns travel in `record`, whatever their names, but columns of the names shard
and slot give way to the result's; columns that can't be hashed (maps) are told apart as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, stored

#: Text bytes that a bucket holds on average, how many times that it may hold, and buckets whose places a task shuffles.
BUCKET_BYTES = 8 << 20
SPLIT = 8
BUCKETS_A_TASK = 64


def _text_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def shuffled_records(docs: DataFrame, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs' columns with shard int and slot long."""
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    odd = [c for c, kind in docs.dtypes if c in names and ("map<" in kind or "variant" in kind)]
    every = [F.col(f"`{c}`") for c in names if c not in odd] + [F.to_json(F.struct(F.col(f"`{c}`"))) for c in odd]
    total = docs.agg(F.sum(_text_bytes()).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // bucket_bytes))
    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets)).alias("bucket"), F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("order"), F.xxhash64(F.lit(seed + 2), *every).alias("order2"),
        _text_bytes().alias("size"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("record"),
    )
    counted = stored(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "shard-buckets")
    full = counted.where((F.col("size") > SPLIT * bucket_bytes) & (F.col("n") > 1)).select("bucket")
    if full.limit(1).count():
        # of the buckets that are too full, the rows that are equal in doc_id and text and fill a bucket by themselves
        equal = dealt.select("bucket", "order", "size").join(full, "bucket", "left_semi").groupBy("order").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        hot = stored(equal.where((F.col("n") > 1) & (F.col("size") > bucket_bytes)).select("order", F.ceil(F.col("size") / bucket_bytes).alias("pieces")), "shard-hot")
        again = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(1 << 62))
        dealt = dealt.withColumn("again", again).join(hot, "order", "left").withColumn("bucket", F.pmod(F.col("bucket") + F.coalesce(F.pmod("again", "pieces"), F.lit(0)), F.lit(buckets))).drop("again", "pieces")
        dealt = stored(dealt, "shard-dealt")  # a place in the input may be another when it is read again
        counted = stored(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "shard-buckets")
    # one row for each bucket; a task gets the same buckets in the same order in any run, so the seeded shuffles are the same
    tasks = -(-buckets // BUCKETS_A_TASK)
    sizes = running(counted, "bucket", "n").join(counted.select("bucket", "n"), "bucket")
    sizes = sizes.repartitionById(tasks, F.floor(F.col("bucket") / BUCKETS_A_TASK).cast("int")).sortWithinPartitions("bucket")
    places = sizes.select("bucket", "before", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), seed).alias("places"))
    ranked = dealt.select("bucket", "record", F.row_number().over(Window.partitionBy("bucket").orderBy("order", "order2")).alias("rank"))
    g = F.col("before") + F.element_at("places", F.col("rank"))
    return ranked.join(places, "bucket").select("record.*", F.pmod(g, F.lit(shards)).cast("int").alias("shard"), F.floor(g / F.lit(shards)).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 17) -> None:
    """Writes one folder per shard; rows carry their slot, and each file is sorted by it."""
    out = shuffled_records(docs, shards, seed)
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    out = shuffled_records(docs.select("doc_id", "text"), shards, seed)
    return out.select(
        "doc_id",
        _text_bytes().alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
