"""Mixing sources to target weights with hash-threshold histograms.

Each source's share of the budget becomes whole passes over it and a rest. The rest
is the set of documents whose hash lies under a threshold; a histogram of sizes by
source and leading hash bits finds the bucket in which the running sum crosses the
rest, the next level splits that bucket alone, and so on to the last bit. Nothing is
sorted, and the choice depends on the hashes only, so it is the same in each run and
grows with the budget (nested).

Cases: a null text has size 0, a null source is a source of its own, the last; sources
without words have target 0; repeated rows share a hash and go together; an
empty table gives no rows; other columns of the input travel along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_or_empty

#: Fixed values of the mix.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_REPEATS = 2

#: Bits of a document's hash (2 to that power, the threshold that all lie under, is a long as well), and of a level of the histogram.
HASH_BITS = 62
BITS = 12
#: Sources up to which the small tables by source are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST_REPEATS) -> dict[str | None, float]:
    """Words to take from each source: shares by weight, at most `most` times the source, the excess dealt again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, active, out = budget * sum(sizes.values()), list(order), {}
    while active:
        unit = left / sum(weight[s] for s in active)
        full = [s for s in active if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in active}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        active = [s for s in active if s not in out]
    return out


def _row_hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 64 - HASH_BITS)


def thresholds(rows: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """For each source of rows (source, size, row_hash): source_, passes (times that it is taken whole), below (documents with smaller hashes are taken once more), source_size and target."""
    spark = rows.sparkSession
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, weights, budget, most)
    passes = {s: int(min(goal[s] // n, most)) if n else 0 for s, n in sizes.items()}
    order = {s: i for i, s in enumerate(sizes)}
    small = F.broadcast if len(sizes) <= BROADCAST_SOURCES else (lambda t: t)

    def by_source(values: list[tuple], schema: str) -> DataFrame:
        return small(spark.createDataFrame(values, schema))

    key = by_source([(s, i) for s, i in order.items()], "s string, k int")
    rows = rows.join(key, rows["source"].eqNullSafe(key["s"])).drop("s")
    rest = {i: goal[s] - passes[s] * sizes[s] for s, i in order.items()}
    low = dict.fromkeys(rest, 0)  # all hashes below are taken
    open_, shift = {i for i in rest if rest[i] > 0}, HASH_BITS
    while open_ and shift > 0:
        shift = max(0, shift - BITS)
        bounds = by_source([(i, low[i], low[i] + (1 << min(HASH_BITS, shift + BITS)) - 1) for i in open_], "k int, low long, high long")
        bucket = F.shiftright(F.col("row_hash") - F.col("low"), shift).alias("bucket")
        hist = rows.join(bounds, "k").where(F.col("row_hash").between(F.col("low"), F.col("high"))).groupBy("k", bucket).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        run = Window.partitionBy("k").orderBy("bucket")
        cut = hist.withColumn("upto", F.sum("n").over(run))
        # the bucket in which the sum passes what is left; the rows before it are taken whole
        left = by_source([(i, float(rest[i])) for i in open_], "k int, rest double")
        found = cut.join(left, "k").where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest"))).collect()
        seen = set()
        for r in found:
            i = r["k"]
            seen.add(i)
            low[i] += r["bucket"] << shift
            rest[i] -= r["upto"] - r["n"]
            if r["rows"] == 1 or shift == 0:
                if r["n"] - rest[i] < rest[i]:  # nearer with the last row, or the last rows that share a hash
                    low[i] += 1 << shift
                open_.discard(i)
        for i in open_ - seen:  # all of it fits
            low[i] = 1 << HASH_BITS
        open_ &= seen
    return by_source([(s, passes[s], low[i], sizes[s], float(goal[s])) for s, i in order.items()], "source_ string, passes int, below long, source_size long, target double")


def _taken(rows: DataFrame, chosen: DataFrame, most: float) -> DataFrame:
    copies = F.col("passes") + F.when((F.col("passes") < most) & (F.col("row_hash") < F.col("below")), 1).otherwise(0)
    return rows.join(chosen, rows["source"].eqNullSafe(chosen["source_"])).withColumn("copies", copies)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(text_or_empty(), F.lit(WORD)), F.lit(0)).cast("long")
    return stored(docs.select("doc_id", "source", size.alias("size"), _row_hash(seed).alias("row_hash")), "mix-rows")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST_REPEATS, seed: int = 29) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of each document."""
    rows = _sized(docs, seed)
    out = _taken(rows, thresholds(rows, weights, budget, most), most)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST_REPEATS, seed: int = 29) -> DataFrame:
    """docs' rows as often as the mix takes them."""
    chosen = thresholds(_sized(docs, seed), weights, budget, most)
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record__")
    out = _taken(docs.select("source", _row_hash(seed).alias("row_hash"), record), chosen, most)
    return out.select(F.explode(F.array_repeat("record__", F.col("copies"))).alias("record__")).select("record__.*")
