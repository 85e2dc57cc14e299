"""Query clauses over analysed columns, and the min-should-match family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stores import written

#: The weight of each kind of match in a field.
FIELD_WEIGHTS = {"exact": 100.0, "shingle": 50.0, "edge": 20.0, "synonym": 80.0, "phonetic": 5.0}
MOST_CLAUSES = 1024
#: Fixed value: a main query has fewer tokens than this.
TOKENS_BOUND = 8


# ---- clauses; a clause is a score column, null where it doesn't match


def term(tokens: Column, value: str | Column, boost: float = 1.0) -> Column:
    return F.when(F.array_contains(tokens, value), F.lit(boost))


def must(*clauses: Column) -> Column:
    """All clauses match; the sum of their scores (null if one is null)."""
    out = clauses[0]
    for c in clauses[1:]:
        out = out + c
    return out


def should(*clauses: Column, least: int = 1) -> Column:
    """At least `least` clauses match; the sum of those that do."""
    _check(clauses)
    hits = sum((c.isNotNull().cast("int") for c in clauses), F.lit(0))
    return F.when(hits >= least, sum((F.coalesce(c, F.lit(0.0)) for c in clauses), F.lit(0.0)))


def dis_max(*clauses: Column, tie: float = 0.0) -> Column:
    """The best clause, plus tie times the others."""
    _check(clauses)
    best = F.greatest(*clauses) if len(clauses) > 1 else clauses[0]
    return best if not tie else best + F.lit(tie) * (sum((F.coalesce(c, F.lit(0.0)) for c in clauses), F.lit(0.0)) - best)


def boosted(clause: Column, boost: float) -> Column:
    return clause * F.lit(boost)


def all_tokens(field: Column, tokens: Column) -> Column:
    """Each token is in the field: one point a token."""
    return F.when((F.size(tokens) > 0) & (F.size(F.array_except(tokens, field)) == 0), F.size(tokens).cast("double"))


def _check(clauses: tuple) -> None:
    if not 0 < len(clauses) <= MOST_CLAUSES:
        raise ValueError(f"a query has 1 to {MOST_CLAUSES} clauses, not {len(clauses)}")


# ---- over rows of (query_id, doc_id, clause, score): one for each clause that a document matches


def least_by_length(n: Column) -> Column:
    """Matches that n tokens must have: one up to 2, two up to 4, else three."""
    return F.when(n <= 2, 1).when(n <= 4, 2).otherwise(3)


def summed(matches: DataFrame, least: int | Column = 1, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Documents with enough matches, and the sum of their scores."""
    out = matches.groupBy(*keys, "doc_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("matched"))
    return out.where(F.col("matched") >= least)


def smart_min_match(matches: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Documents that match as many clauses as the best document of the query does. A query's documents never meet in one task: its maximum is a row."""
    every = written(summed(matches, keys=keys), "matched")
    most = written(every.groupBy(*[F.col(k).alias(f"{k}__") for k in keys]).agg(F.max("matched").alias("most")), "most")
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    return every.join(most, [*same, F.col("matched") == F.col("most")]).select(*every.columns)


def field_score(tokens: Column, analysed: dict[str, Column], boost: float = 1.0, enabled: tuple[str, ...] = ("exact", "shingle", "edge", "synonym", "phonetic")) -> Column:
    """Weighted number of query tokens in each analysed form (exact, shingle, edge, ...) of a field, by its boost; 0 without any."""
    parts = [F.size(F.array_intersect(tokens, column)) * F.lit(FIELD_WEIGHTS[kind] * boost) for kind, column in analysed.items() if kind in enabled]
    return sum(parts, F.lit(0.0))


def auto_boosts(fields: list[tuple[str, float | None]]) -> list[tuple[str, float]]:
    """Boosts of the fields of a query: a field without one has that of the field before plus one (the first: 1)."""
    out, last = [], 0.0
    for name, boost in fields:
        last = last + 1 if boost is None else boost
        out.append((name, last))
    return out


# ---- query builders


def single_field_query(request: dict) -> dict:
    """Settings of a one-field query {field: text or {query, boost, keyword, noFuzzy, vernacularOnly, instance, intentFields}}."""
    if len(request) != 1:
        raise ValueError("the query has exactly one field")
    ((name, body),) = request.items()
    body = {"query": body} if isinstance(body, str) else dict(body)
    known = {"query", "boost", "keyword", "noFuzzy", "vernacularOnly", "instance", "intentFields"}
    if unknown := sorted(body.keys() - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    if not str(body.get("query") or "").strip():
        raise ValueError("the query is empty")
    defaults = {"boost": 1.0, "keyword": False, "noFuzzy": False, "vernacularOnly": False, "instance": None, "intentFields": None}
    return {"field": name} | defaults | body


def multi_field_query(request: dict) -> dict:
    """Settings of a query {query, fields: [name or {field, boost, ...}], instance}: two fields at least; boosts as in auto_boosts."""
    fields = [{"field": f} if isinstance(f, str) else dict(f) for f in request.get("fields", [])]
    if len(fields) < 2:
        raise ValueError("the query has two fields at least")
    if not str(request.get("query") or "").strip():
        raise ValueError("the query is empty")
    boosts = auto_boosts([(f["field"], f.get("boost")) for f in fields])
    return {"query": request["query"], "instance": request.get("instance"), "fields": [f | {"boost": b} for f, (_, b) in zip(fields, boosts, strict=True)]}


def segmentations(queries: DataFrame, longest: int = 3) -> DataFrame:
    """(query_id, segments): all ways to cut the tokens into runs of at most `longest`, each once."""
    n = F.size("tokens")
    masks = queries.select("query_id", "tokens", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), n - 1).cast("int") - 1)).alias("mask"))
    pieces = F.expr("transform(tokens, (t, i) -> concat(case when i = 0 then '' when (shiftright(mask, i - 1) & 1) = 1 then '|' else '+' end, t))")
    joined = F.array_join(pieces, "")
    out = masks.withColumn("runs", F.split(joined, r"\|"))
    out = out.where(F.forall("runs", lambda r: F.size(F.split(r, r"\+")) <= longest))
    return out.select("query_id", F.array_join("runs", "|").alias("segments")).distinct()


def token_sets(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, have): the tokens of a vocabulary that each document with one of them has, sorted. postings: doc_id, token."""
    spark = postings.sparkSession
    rows = postings.join(F.broadcast(vocabulary.select("token").distinct()), "token", "left_semi").select("doc_id", "token")
    # all partitions are kept: few bytes can hold very many of these rows
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("token")).alias("have"))


def main_query(queries: DataFrame, postings: DataFrame, longest: int = 3) -> DataFrame:
    """(query_id, doc_id, score): documents by all ways to cut the tokens into runs of at most `longest`.

    A run matches a document that has all of its tokens, with one point a token. Of each segmentation the documents with
    the most matching runs count, and a document's score is the sum over segmentations (a dis-max with tie 1). queries:
    query_id (unique), tokens, those with TOKENS_BOUND tokens or more have no result; postings: doc_id, token, each pair once.
    Documents with the same tokens of the queries score alike, so runs and segmentations meet the distinct sets of
    these tokens, each run once, and documents join the scores of their set last.
    """
    cut = segmentations(queries.where(F.size("tokens").between(1, TOKENS_BOUND - 1)), longest)
    runs = written(cut.select("query_id", "segments", F.explode(F.split("segments", r"\|")).alias("run")), "runs")
    known = runs.select("run").distinct().select("run", F.array_distinct(F.split("run", r"\+")).alias("tokens"))
    asked = written(known.select("run", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "asked")
    held = written(token_sets(postings, asked), "held")
    sets = written(held.select("have").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
    have = sets.select(F.col("set").alias("doc_id"), F.explode("have").alias("token"))
    found = asked.join(have, "token").groupBy("run", "doc_id").agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n")).where("found = n").select("run", "doc_id")
    hits = runs.join(found, "run").select("query_id", "segments", "doc_id", F.size(F.split("run", r"\+")).cast("double").alias("score"))
    best = smart_min_match(hits, ("query_id", "segments")).groupBy("query_id", F.col("doc_id").alias("set")).agg(F.sum("score").alias("score"))
    scored = written(sets.join(best, "set").select("have", "query_id", "score"), "scored")  # its size is known when it meets the documents
    return held.join(scored, "have").select("query_id", "doc_id", "score")
