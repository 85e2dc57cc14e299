"""Readings of a query by the classes of its tokens, ranked by weight; and the paths through the tags of a reading.

Everything is a join or a higher-order function: a query has few tokens, a token few classes, and queries meet the
store's vocabulary once, by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forests import normalised

#: The most tokens of a query, the longest n-gram, its share of the weight it builds on, and the least normalised weight of a reading.
MOST_TOKENS = 7
LONGEST_GRAM = 3
GRAM_FACTOR = 4.0
LEAST = 0.25


def paths(choices: Column) -> Column:
    """All ways to take one element of each list of an array of lists, in order; an empty or null list gives a null element."""
    filled = F.transform(choices, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(None))))
    start = F.array(F.slice(F.flatten(filled), 1, 0))
    return F.aggregate(filled, start, lambda done, c: F.flatten(F.transform(done, lambda path: F.transform(c, lambda one: F.concat(path, F.array(one))))))


def intent_paths(forests: DataFrame) -> DataFrame:
    """(query_id, forest_id, path, tags): one row for each way to take one tag of each member, null for a member without tags."""
    tags = F.transform("members", lambda m: m["tags"])
    return forests.select("query_id", "forest_id", F.posexplode(paths(tags)).alias("path", "tags"))


def _grams(queries: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(query_id, start, n, class, weight): what is suggested for the runs of 1 to LONGEST_GRAM tokens."""
    n = F.size("tokens")
    lengths = queries.select("query_id", "tokens", F.explode(F.sequence(F.lit(1), F.least(n, F.lit(LONGEST_GRAM)))).alias("n"))
    runs = lengths.select("query_id", "tokens", "n", F.explode(F.sequence(F.lit(1), n - F.col("n") + 1)).alias("start"))
    keyed = runs.select("query_id", "start", "n", F.array_join(F.expr("slice(tokens, start, n)"), "/").alias("key"))
    return keyed.join(suggestions.select("key", "class", "weight"), "key").drop("key")


def readings(queries: DataFrame, suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, reading, start, class, weight), a row for each token of each reading, and what _grams finds.

    A reading takes one class for each token, null for a token without suggestions. queries: query_id (unique), tokens;
    those without tokens or with more than MOST_TOKENS have no reading. suggestions: key (tokens joined by /), class, weight.
    The weight of a class at a token is the sum of its suggestions there.
    """
    few = queries.where(F.size("tokens").between(1, MOST_TOKENS)).select("query_id", "tokens")
    grams = _grams(few, suggestions)
    classes = grams.where("n = 1").groupBy("query_id", "start", "class").agg(F.sum("weight").alias("weight"))
    at = classes.groupBy("query_id").agg(F.collect_list(F.struct("start", "class", "weight")).alias("found"))
    choices = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.array_sort(F.filter("found", lambda f: f["start"] == i)))
    each = few.join(at, "query_id", "left").select("query_id", F.posexplode(paths(choices)).alias("reading", "picks"))
    rows = each.select("query_id", "reading", F.posexplode("picks").alias("place", "pick"))
    return rows.select("query_id", "reading", (F.col("place") + 1).alias("start"), F.col("pick.class").alias("class"), F.col("pick.weight").alias("weight")), grams


def ranked(queries: DataFrame, suggestions: DataFrame, least: float = LEAST) -> DataFrame:
    """(query_id, reading, classes, score, norm_score) of the readings with at least that normalised weight.

    Neighbouring tokens of one class form a group, whose weight is its length times the sum of the weights of its
    choices: the tokens' own suggestions, and for each known n-gram of that class within it those with the n-gram in
    place of its tokens, plus GRAM_FACTOR times the weight of the tokens' own. Wherever a group stands between two groups
    of one other class (tokens without a class left aside), the weights of all three are halved. Weights of a query's
    readings are normalised as the scores of forests are. Suggestions of equal weight all count.
    """
    rows, grams = readings(queries, suggestions)
    own = Window.partitionBy("query_id", "reading").orderBy("start")
    new = F.col("class").isNull() | ~F.coalesce(F.col("class") == F.lag("class").over(own), F.lit(False))
    runs = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(own))
    groups = runs.where("class is not null").groupBy("query_id", "reading", "run").agg(
        F.min("start").alias("start"), F.count(F.lit(1)).cast("int").alias("length"), F.first("class").alias("class"), F.sum("weight").alias("base"), F.array_sort(F.collect_list(F.struct("start", "weight"))).alias("picks")
    )
    g, b = groups.alias("g"), grams.where("n > 1").alias("b")
    inside = (F.col("g.query_id") == F.col("b.query_id")) & (F.col("g.class") == F.col("b.class")) & (F.col("b.start") >= F.col("g.start")) & (F.col("b.start") + F.col("b.n") <= F.col("g.start") + F.col("g.length"))
    covered = F.aggregate(F.filter("g.picks", lambda p: p["start"].between(F.col("b.start"), F.col("b.start") + F.col("b.n") - 1)), F.lit(0.0), lambda s, p: s + p["weight"])
    extra = g.join(b, inside).select("g.query_id", "g.reading", "g.run", ((GRAM_FACTOR + 1) * F.col("g.base") - covered + F.col("b.weight")).alias("extra"))
    extra = extra.groupBy("query_id", "reading", "run").agg(F.sum("extra").alias("extra"))
    weighed = groups.join(extra, ["query_id", "reading", "run"], "left").withColumn("weight", F.col("length") * (F.col("base") + F.coalesce("extra", F.lit(0.0))))
    near = {i: F.lag("class", -i).over(own) for i in (-2, -1, 1, 2)} | {0: F.col("class")}
    between = lambda i: F.coalesce((near[i] == near[i + 2]) & (near[i] != near[i + 1]), F.lit(False)).cast("int")
    halved = weighed.withColumn("halvings", between(-2) + between(-1) + between(0))
    scores = halved.groupBy("query_id", "reading").agg(F.sum(F.col("weight") * F.pow(F.lit(0.5), "halvings")).alias("score"))
    names = rows.groupBy("query_id", "reading").agg(F.array_sort(F.collect_list(F.struct("start", F.coalesce("class", F.lit("-")).alias("class")))).alias("c"))
    out = names.select("query_id", "reading", F.array_join("c.class", " ").alias("classes")).join(scores, ["query_id", "reading"], "left")
    return normalised(out.withColumn("score", F.coalesce("score", F.lit(0.0)))).where(F.col("norm_score") >= least)
