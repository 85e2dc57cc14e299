"""Queries of the stream-built store, the phonetic kinds and retrieval with all encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, phonetics
from ..operators import retrieval, store
from ..sources.stores import scratch
from ..streaming import tokens
from . import inputs, store_queries
from .inputs import table


def streaming_store(spark: SparkSession, sf: str) -> DataFrame:
    source, target, progress = (scratch(spark, f"stream-{n}") for n in ("in", "out", "state"))
    inputs.entities(spark, sf).repartition(4).write.parquet(source)
    tokens.start(tokens.entity_stream(spark, source, files_per_batch=2), target, progress, every=None).awaitTermination()
    return tokens.read_tags(spark, target).drop("ancestors")


def _vocabulary(spark, sf) -> DataFrame:
    """Distinct tokens of the conversations."""
    return table(spark, sf, "conversations").select(F.explode(analysis.words(F.col("text"))).alias("token")).distinct()


def dm_soundex(spark, sf):
    return phonetics.encode_vocabulary(_vocabulary(spark, sf), ("ds",))


def double_metaphone(spark, sf):
    return phonetics.encode_vocabulary(_vocabulary(spark, sf), ("dm",))


def beider_morse(spark, sf):
    """Of the entities' vocabulary, which is what the store encodes."""
    entities = inputs.entities(spark, sf)
    return phonetics.encode_vocabulary(entities.select(F.explode(analysis.words(F.col("value"))).alias("token")), ("bm",))


def retrieval_all_encodings(spark, sf):
    """Candidates with every phonetic kind in the store and in the queries."""
    records = store.build_store(inputs.entities(spark, sf))
    clauses = retrieval.clauses(retrieval.conjuncts(retrieval.tokenised_queries(inputs.queries_table(spark))))
    codes = phonetics.encode_vocabulary(store.encodings(records).select("token").union(clauses.select("token")))
    scores = retrieval.candidate_scores(clauses, store.postings(records, codes), codes)
    return retrieval.top_candidates(scores, records).select("query_id", "conjunct", "rank", "key", "score")


QUERIES = {f.__name__: f for f in (streaming_store, dm_soundex, double_metaphone, beider_morse, retrieval_all_encodings)}
SQL = {"streaming_store": store_queries.SQL["token_store_tags"]}
