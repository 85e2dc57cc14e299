"""Candidate retrieval: conjuncts of queries against the postings of the token store, in one join for all queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.analysis import is_number, normalised_query, words
from ..functions.encoding import gram_encodings


def tokenised_queries(queries: DataFrame) -> DataFrame:
    """(query_id, tokens) of queries (query_id, query) with 1 to MOST_TOKENS tokens."""
    rows = queries.select("query_id", words(normalised_query(F.col("query"))).alias("tokens"))
    return rows.where(F.size("tokens").between(1, config.MOST_TOKENS))


def conjuncts(queries: DataFrame) -> DataFrame:
    """(query_id, conjunct, start, tokens): the whole query, then from each position one token, two if the query has more than two, three if it has more than three.

    In queries of several tokens a conjunct needs a token that isn't a number, and a single token two characters.
    """
    n = F.size("tokens")
    span = lambda start, size: F.struct(start.alias("start"), size.alias("size"))
    each = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.when(n > 3, 3).when(n > 2, 2).otherwise(1))), lambda k: span(i, k))))
    each = F.filter(each, lambda s: s["size"] < n)
    spans = queries.select("query_id", "tokens", F.posexplode(F.concat(F.array(span(F.lit(1), n)), each)).alias("conjunct", "s"))
    out = spans.select("query_id", "conjunct", F.col("s.start").alias("start"), F.slice("tokens", F.col("s.start"), F.col("s.size")).alias("tokens"), n.alias("n"))
    valid = F.exists("tokens", lambda t: ~is_number(t)) & ((F.size("tokens") > 1) | (F.length(F.element_at("tokens", 1)) > 1))
    return out.where((F.col("n") == 1) | valid).drop("n")


def clauses(spans: DataFrame) -> DataFrame:
    """(query_id, conjunct, clause, token): each token of a conjunct, and all of them joined if there are several."""
    several = F.when(F.size("tokens") > 1, F.array(F.array_join("tokens", ""))).otherwise(F.array().cast("array<string>"))
    return spans.select("query_id", "conjunct", F.posexplode(F.concat("tokens", several)).alias("clause", "token"))


def least_matches(kind: Column, n: Column) -> Column:
    """How many terms of a set of n must match: for n-grams a fifth and at least two, else one."""
    share = F.least(F.greatest(F.floor(F.lit(config.NGRAM_SHARE) * n), F.lit(config.LEAST_NGRAMS)), n)
    return F.when(kind == "ng", share).otherwise(1)


def query_terms(tokens: DataFrame, phonetic: DataFrame | None = None) -> DataFrame:
    """(token, kind, value, boost, least) of distinct query tokens; boosts that round to 0 still count as matches."""
    every = tokens.select("token").distinct()
    terms = every.select("token", F.explode(gram_encodings(F.col("token"))).alias("p")).select("token", "p.kind", "p.value")
    if phonetic is not None:
        terms = terms.unionByName(every.join(phonetic, "token").select("token", "kind", "value"))
    own = Window.partitionBy("token", "kind")
    terms = terms.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("length", F.sum(F.length("value")).over(own))
    grams = F.floor(F.length("value") * F.when(F.col("kind") == "ng", config.NGRAM_BOOST).otherwise(config.EDGE_BOOST) / F.col("length") + 0.5)
    boost = F.when(F.col("kind").startswith("ng"), grams).otherwise(F.floor(F.lit(config.PHONETIC_BOOST) / F.col("n") + 0.5)).cast("double")
    sets = terms.select("token", "kind", "value", boost.alias("boost"), least_matches(F.col("kind"), F.col("n")).cast("long").alias("least"))
    return sets.unionByName(every.select("token", F.lit("token").alias("kind"), F.col("token").alias("value"), F.lit(None).cast("double").alias("boost"), F.lit(1).cast("long").alias("least")))


def inverse_frequencies(posting: DataFrame) -> DataFrame:
    """(value, idf) of the tokens among all encodings."""
    tokens = posting.where("kind = 'token'")
    total = tokens.agg(F.count(F.lit(1)).alias("total"))
    df = F.col("df")
    return tokens.groupBy("value").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("value", F.log(1 + (F.col("total") - df + 0.5) / (df + 0.5)).alias("idf"))  # total is one row


def encoding_scores(clause_rows: DataFrame, posting: DataFrame, phonetic: DataFrame | None = None) -> DataFrame:
    """(query_id, conjunct, clause, key, enc_idx, exact, encoded, score) of each encoding that a clause reaches."""
    terms = query_terms(clause_rows, phonetic)
    idf = inverse_frequencies(posting)
    terms = terms.join(idf, "value", "left").withColumn("boost", F.when(F.col("kind") == "token", F.lit(config.EXACT_BOOST) * F.col("idf")).otherwise(F.col("boost"))).drop("idf")
    # the terms of a vocabulary meet the postings once, whatever the number of queries that hold them
    hits = terms.join(posting, ["kind", "value"]).groupBy("token", "key", "enc_idx", "kind").agg(F.sum("boost").alias("sum"), F.count(F.lit(1)).alias("found"), F.first("least").alias("least"), F.first("weight").alias("weight"))
    hits = hits.where("found >= least").groupBy("token", "key", "enc_idx").agg(F.max(F.when(F.col("kind") == "token", F.col("sum"))).alias("exact"), F.sum(F.when(F.col("kind") != "token", F.col("sum"))).alias("encoded"), F.first("weight").alias("weight"))
    hits = hits.withColumn("score", F.coalesce("weight", F.lit(1.0)) * F.greatest(F.coalesce("exact", F.lit(0.0)), F.coalesce("encoded", F.lit(0.0))))
    return clause_rows.join(hits, "token").select("query_id", "conjunct", "clause", "key", "enc_idx", "exact", "encoded", "score")


def candidate_scores(clause_rows: DataFrame, posting: DataFrame, phonetic: DataFrame | None = None) -> DataFrame:
    """(query_id, conjunct, key, score): per clause the best encoding of a record, summed over clauses."""
    best = encoding_scores(clause_rows, posting, phonetic).groupBy("query_id", "conjunct", "clause", "key").agg(F.max("score").alias("score"))
    return best.groupBy("query_id", "conjunct", "key").agg(F.sum("score").alias("score"))


def top_candidates(scores: DataFrame, store: DataFrame, most: int = config.MOST_CANDIDATES) -> DataFrame:
    """The best records of each conjunct: by score, then fewer tokens, then key."""
    order = Window.partitionBy("query_id", "conjunct").orderBy(F.col("score").desc(), "token_count", "key")
    return scores.join(store, "key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
