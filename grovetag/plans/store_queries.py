"""Queries of the token store, retrieval and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis
from ..operators import forests, intents, matching, requests, retrieval, scoring, search, store
from ..sources.stores import written
from . import inputs
from .inputs import INSTANCE, SQL_ENTITIES, SQL_POSTINGS, SQL_QUERIES, SQL_RETRIEVAL, sql_words, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _emitted(spark: SparkSession, sf: str) -> DataFrame:
    return store.emit_tokens(inputs.entities(spark, sf))


@_query(f"WITH {SQL_ENTITIES} SELECT key, tag_type, name, normalised_value, ref_tag_type FROM emit")
def token_emit(spark, sf):
    return _emitted(spark, sf).select("key", "tag_type", "name", "normalised_value", "ref_tag_type")


@_query(f"""WITH {SQL_ENTITIES} SELECT name, value, field, x AS ancestor FROM (SELECT name, value, 'brand' AS field, unnest(anc_brand) AS x FROM ent UNION ALL SELECT name, value, 'model', unnest(anc_model) FROM ent)""")
def ancestors_extract(spark, sf):
    return inputs.entities(spark, sf).select("name", "value", F.explode("ancestors").alias("field", "list")).select("name", "value", "field", F.explode("list").alias("ancestor"))


@_query(f"""WITH {SQL_ENTITIES},
    x AS (SELECT key, tag_type, name, 'brand' AS field, unnest(anc_brand) AS v FROM emit UNION ALL SELECT key, tag_type, name, 'model', unnest(anc_model) FROM emit)
    SELECT key, tag_type, name, field, array_to_string(list_sort(list(DISTINCT v)), ',') AS ancestors FROM x GROUP BY key, tag_type, name, field""")
def ancestor_merge(spark, sf):
    return store.merge_ancestors(_emitted(spark, sf)).select("key", "tag_type", "name", "field", F.array_join("values", ",").alias("ancestors"))


@_query(f"WITH {SQL_ENTITIES} SELECT key, tag_type, name, count(*) AS total_count, min(normalised_value) AS normalised_value, min(ref_tag_type) AS ref_tag_type FROM emit GROUP BY key, tag_type, name")
def token_store_tags(spark, sf):
    return store.merge_tags(_emitted(spark, sf)).drop("ancestors")


@_query(f"""WITH {SQL_ENTITIES},
    tags AS (SELECT key, tag_type, name, count(*) AS n FROM emit GROUP BY ALL)
    SELECT key, CAST(len(string_split(key, '/')) AS BIGINT) AS token_count, CAST(sum(n) AS BIGINT) AS total_count,
           array_to_string(list_sort(list(tag_type || ':' || name || ':' || n)), ' ') AS tags FROM tags GROUP BY key""")
def token_store_build(spark, sf):
    tag = F.array_sort(F.transform("tags", lambda t: F.concat_ws(":", t["tag_type"], t["name"], t["total_count"].cast("string"))))
    return store.build_store(inputs.entities(spark, sf)).select("key", "token_count", "total_count", F.array_join(tag, " ").alias("tags"))


@_query(f"WITH {SQL_ENTITIES} SELECT key, array_to_string(list_sort(list(DISTINCT name)), ',') AS scopes FROM emit GROUP BY key")
def token_scopes(spark, sf):
    return store.build_store(inputs.entities(spark, sf)).select("key", F.array_join("scopes", ",").alias("scopes"))


@_query(f"""WITH {SQL_ENTITIES} SELECT key, tag_type, name, CAST(2 * count(*) AS BIGINT) AS total_count FROM emit GROUP BY ALL""")
def token_store_merge(spark, sf):
    tags = store.merge_tags(_emitted(spark, sf))
    return store.merge_stores(tags, tags).select("key", "tag_type", "name", "total_count")


@_query(f"WITH {SQL_POSTINGS} SELECT key, CAST(enc_idx AS INTEGER) AS enc_idx, kind, value, weight FROM posting")
def posting_build(spark, sf):
    return store.postings(store.build_store(inputs.entities(spark, sf)))


# ---- retrieval


def _posting(spark, sf) -> tuple[DataFrame, DataFrame]:
    records = written(store.build_store(inputs.entities(spark, sf)), "store")
    return records, written(store.postings(records), "postings")


def _spans(spark) -> DataFrame:
    return retrieval.conjuncts(retrieval.tokenised_queries(inputs.queries_table(spark)))


@_query(f"WITH {SQL_QUERIES} SELECT query_id, CAST(conjunct AS INTEGER) AS conjunct, CAST(start AS INTEGER) AS start, array_to_string(tokens, ' ') AS tokens FROM conjuncts")
def query_conjuncts(spark, sf):
    return _spans(spark).select("query_id", "conjunct", "start", F.array_join("tokens", " ").alias("tokens"))


@_query(f"WITH {SQL_QUERIES} SELECT query_id, CAST(conjunct AS INTEGER) AS conjunct, CAST(clause AS INTEGER) AS clause, token FROM clauses")
def query_clauses(spark, sf):
    return retrieval.clauses(_spans(spark))


@_query(f"WITH {SQL_RETRIEVAL} SELECT token, kind, value, boost, CAST(least_found AS BIGINT) AS least FROM terms")
def query_boosts(spark, sf):
    return retrieval.query_terms(retrieval.clauses(_spans(spark))).where("kind <> 'token'")


def _encodings(spark, sf) -> DataFrame:
    return retrieval.encoding_scores(retrieval.clauses(_spans(spark)), _posting(spark, sf)[1])


@_query(f"WITH {SQL_RETRIEVAL} SELECT query_id, CAST(conjunct AS INTEGER) AS conjunct, CAST(clause AS INTEGER) AS clause, key, CAST(enc_idx AS INTEGER) AS enc_idx, exact FROM enc_scores WHERE exact IS NOT NULL")
def retrieval_exact(spark, sf):
    return _encodings(spark, sf).where("exact is not null").drop("encoded", "score")


@_query(f"WITH {SQL_RETRIEVAL} SELECT query_id, CAST(conjunct AS INTEGER) AS conjunct, CAST(clause AS INTEGER) AS clause, key, CAST(enc_idx AS INTEGER) AS enc_idx, encoded FROM enc_scores WHERE encoded IS NOT NULL")
def retrieval_ngram(spark, sf):
    return _encodings(spark, sf).where("encoded is not null").drop("exact", "score")


@_query(f"WITH {SQL_RETRIEVAL} SELECT token, key, CAST(enc_idx AS INTEGER) AS enc_idx, boost FROM hits WHERE kind = 'rs'")
def retrieval_phonetic(spark, sf):
    terms = retrieval.query_terms(retrieval.clauses(_spans(spark))).where("kind = 'rs'")
    return terms.join(_posting(spark, sf)[1], ["kind", "value"]).groupBy("token", "key", "enc_idx").agg(F.sum("boost").alias("boost"))


@_query(f"WITH {SQL_RETRIEVAL} SELECT query_id, CAST(conjunct AS INTEGER) AS conjunct, CAST(clause AS INTEGER) AS clause, key, score FROM clause_best")
def nested_max(spark, sf):
    return _encodings(spark, sf).groupBy("query_id", "conjunct", "clause", "key").agg(F.max("score").alias("score"))


@_query(f"WITH {SQL_RETRIEVAL} SELECT query_id, CAST(conjunct AS INTEGER) AS conjunct, CAST(clause AS INTEGER) AS clause, key, avg(score) AS score FROM enc_scores GROUP BY ALL")
def nested_avg(spark, sf):
    return _encodings(spark, sf).groupBy("query_id", "conjunct", "clause", "key").agg(F.avg("score").alias("score"))


@_query(f"WITH {SQL_RETRIEVAL} SELECT query_id, CAST(conjunct AS INTEGER) AS conjunct, key, score FROM scores")
def retrieval_score(spark, sf):
    return retrieval.candidate_scores(retrieval.clauses(_spans(spark)), _posting(spark, sf)[1])


@_query(f"WITH {SQL_RETRIEVAL} SELECT query_id, CAST(conjunct AS INTEGER) AS conjunct, CAST(rank AS INTEGER) AS rank, key, round(score, 6) AS score FROM ranked WHERE rank <= 20")
def candidate_topk(spark, sf):
    records, posting = _posting(spark, sf)
    scores = retrieval.candidate_scores(retrieval.clauses(_spans(spark)), posting)
    return retrieval.top_candidates(scores, records).select("query_id", "conjunct", "rank", "key", F.round("score", 6).alias("score"))


@_query(f"""WITH {SQL_POSTINGS} SELECT key, enc_idx, sum(value_score) AS score FROM (SELECT key, CAST(enc_idx AS INTEGER) AS enc_idx, 10.0 * coalesce(CASE WHEN weight < 1 THEN weight END, 1.0) AS value_score FROM posting WHERE kind = 'token') GROUP BY ALL""")
def weight_factor(spark, sf):
    weight = F.coalesce(F.when(F.col("weight") < 1, F.col("weight")), F.lit(1.0))  # a missing weight counts as 1
    return _posting(spark, sf)[1].where("kind = 'token'").groupBy("key", "enc_idx").agg(F.sum(10.0 * weight).alias("score"))


# ---- matching


def _results(spark, sf) -> DataFrame:
    return store.build_store(inputs.entities(spark, sf)).select(F.explode("tokens").alias("result")).distinct()


def _pairs(spark, sf) -> DataFrame:
    """The stated list of queries against all tokens: distances have no key to join by."""
    return _results(spark, sf).crossJoin(F.broadcast(retrieval.tokenised_queries(inputs.queries_table(spark))))


_SQL_PAIRS = f"{SQL_POSTINGS}, {SQL_QUERIES}, pairs AS (SELECT query_id, tokens, result FROM qt, (SELECT DISTINCT unnest(t) AS result FROM keys))"


@_query(f"WITH {_SQL_PAIRS} SELECT query_id, result, list_filter(tokens, lambda x: x = result)[1] AS token, 4.0 AS score FROM pairs WHERE list_contains(tokens, result)")
def match_exact(spark, sf):
    asked = retrieval.tokenised_queries(inputs.queries_table(spark))
    rows = asked.select("query_id", "tokens", F.explode(F.array_distinct("tokens")).alias("result")).join(_results(spark, sf), "result")
    return rows.select("query_id", "result", matching.exact_match(F.col("tokens"), F.col("result")).alias("token"), F.lit(4.0).alias("score"))


@_query(f"""WITH {_SQL_PAIRS}, found AS (SELECT query_id, result, list_filter(tokens, lambda x: starts_with(result, x))[1] AS token FROM pairs WHERE NOT list_contains(tokens, result))
    SELECT query_id, result, token, 2.0 / (length(result) - length(token) + 1) AS score FROM found WHERE token IS NOT NULL""")
def match_edge_gram(spark, sf):
    asked = retrieval.tokenised_queries(inputs.queries_table(spark)).select("query_id", "tokens", F.explode(F.array_distinct("tokens")).alias("prefix"))
    prefixes = _results(spark, sf).select("result", F.explode(F.transform(F.sequence(F.lit(1), F.length("result")), lambda i: F.substring("result", F.lit(1), i))).alias("prefix"))
    rows = asked.join(prefixes, "prefix").select("query_id", "tokens", "result").distinct().where(~F.array_contains("tokens", F.col("result")))
    rows = rows.withColumn("token", matching.edge_match(F.col("tokens"), F.col("result")))
    return rows.select("query_id", "result", "token", matching.edge_score(F.col("token"), F.col("result")).alias("score"))


@_query()
def match_phonetic(spark, sf):
    schema = "query_id long, result string, token string, matched string, code int, score double"

    def run(parts):
        import pandas as pd

        for pdf in parts:
            rows = []
            for q, tokens, result in zip(pdf["query_id"], pdf["tokens"], pdf["result"], strict=True):
                if m := matching.match_token(tuple(tokens), result, True, 50):
                    rows.append((q, result, m.input, m.matched, m.code, m.score))
            yield pd.DataFrame(rows, columns=["query_id", "result", "token", "matched", "code", "score"])

    return _pairs(spark, sf).mapInPandas(run, schema)


def _sets(spark, sf, which: str) -> DataFrame:
    records, posting = _posting(spark, sf)
    spans = _spans(spark)
    top = retrieval.top_candidates(retrieval.candidate_scores(retrieval.clauses(spans), posting), records).select("query_id", "conjunct", "rank", "key")
    rows = top.join(spans, ["query_id", "conjunct"]).select("query_id", "conjunct", "rank", "key", "tokens")
    schema = "query_id long, conjunct int, rank int, key string, inputs string, matched string, code int, score double, results int"

    def run(parts):
        import pandas as pd

        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                m = getattr(matching, which)(tuple(r.tokens), tuple(r.key.split("/")), [], {})
                if m:
                    out.append((r.query_id, r.conjunct, r.rank, r.key, " ".join(m.inputs), " ".join(x.matched for x in m.matches), m.code, m.score, m.results))
            yield pd.DataFrame(out, columns=["query_id", "conjunct", "rank", "key", "inputs", "matched", "code", "score", "results"])

    return rows.mapInPandas(run, schema)


@_query()
def match_set(spark, sf):
    return _sets(spark, sf, "token_wise")


@_query()
def match_joined(spark, sf):
    return _sets(spark, sf, "joined")


_SQL_WEIGHTS = inputs.sql_values(list(INSTANCE.tag_weights.items()))


@_query(f"""WITH {SQL_ENTITIES}, tags AS (SELECT DISTINCT key, tag_type, name FROM emit)
    SELECT key, tag_type, name, coalesce(CAST(w AS DOUBLE), 0.0) AS weight FROM tags LEFT JOIN {_SQL_WEIGHTS} AS v(n, w) ON n = name""")
def tag_weight_join(spark, sf):
    weights = spark.createDataFrame([(k, float(v)) for k, v in INSTANCE.tag_weights.items()], "name string, weight double")
    tags = _emitted(spark, sf).select("key", "tag_type", "name").distinct()
    return tags.join(F.broadcast(weights), "name", "left").select("key", "tag_type", "name", F.coalesce("weight", F.lit(0.0)).alias("weight"))  # the instance's list


@_query(f"""WITH {SQL_ENTITIES}, tags AS (SELECT DISTINCT key, tag_type, name, CASE WHEN len(string_split(key, '/')) > 1 THEN true ELSE false END AS partial FROM emit)
    SELECT key, name, tag_type AS was, CASE WHEN partial THEN 'NGram' ELSE tag_type END AS tag_type, CASE WHEN partial AND tag_type <> 'NGram' THEN 0.0 ELSE coalesce(CAST(w AS DOUBLE), 0.0) END AS weight
    FROM tags LEFT JOIN {_SQL_WEIGHTS} AS v(n, w) ON n = name""")
def tag_inflate(spark, sf):
    partial = F.size(F.split("key", "/")) > 1
    rows = tag_weight_join(spark, sf)
    wrapped = partial & (F.col("tag_type") != "NGram")
    return rows.select("key", "name", F.col("tag_type").alias("was"), F.when(partial, "NGram").otherwise(F.col("tag_type")).alias("tag_type"), F.when(wrapped, 0.0).otherwise(F.col("weight")).alias("weight"))


@_query(f"""WITH {SQL_ENTITIES}, tags AS (SELECT DISTINCT key, tag_type, name FROM emit), w AS (SELECT *, CASE WHEN tag_type = 'NGram' THEN 1 ELSE 0 END AS level, coalesce(CAST(w AS DOUBLE), 0.0) AS weight FROM tags LEFT JOIN {_SQL_WEIGHTS} AS v(n, w) ON n = name)
    SELECT key, tag_type, name, CAST(row_number() OVER (PARTITION BY key ORDER BY level, weight DESC, name, tag_type) AS INTEGER) AS place FROM w""")
def tag_order(spark, sf):
    from pyspark.sql import Window

    level = F.when(F.col("tag_type") == "NGram", 1).otherwise(0)
    return tag_weight_join(spark, sf).select("key", "tag_type", "name", F.row_number().over(Window.partitionBy("key").orderBy(level, F.col("weight").desc(), "name", "tag_type")).alias("place"))


@_query(f"""WITH {SQL_ENTITIES}, tags AS (SELECT DISTINCT key, tag_type, name FROM emit), w AS (SELECT DISTINCT key, name, coalesce(CAST(w AS DOUBLE), 0.0) AS weight FROM tags LEFT JOIN {_SQL_WEIGHTS} AS v(n, w) ON n = name)
    SELECT key, name, weight, CAST(row_number() OVER (PARTITION BY key ORDER BY weight DESC, name) AS INTEGER) AS place FROM w""")
def tag_weight_order(spark, sf):
    rows = tag_weight_join(spark, sf).select("key", "name", "weight").distinct()
    return rows.withColumn("place", requests.by_weight(F.col("weight"), F.col("name")))


_SQL_SIDES = """sides AS (SELECT p_partkey, p_retailprice / 100 AS s1, p_size AS w1, p_partkey % 2 AS l1, p_partkey % 3 AS r1,
    lead(p_retailprice, 1, 1000) OVER (ORDER BY p_partkey) / 100 AS s2, lead(p_size, 7, 5) OVER (ORDER BY p_partkey) AS w2, p_size % 2 AS l2, p_size % 3 AS r2 FROM part)"""


@_query(f"""WITH {_SQL_SIDES} SELECT p_partkey, CAST(CASE WHEN abs(s2 - s1) * 100 / greatest(s1, s2) < 20 AND w1 <> w2 THEN sign(w2 - w1) WHEN s1 <> s2 THEN sign(s2 - s1) WHEN l1 <> l2 THEN sign(l1 - l2) ELSE sign(r1 - r2) END AS INTEGER) AS sign FROM sides""")
def match_compare(spark, sf):
    part = search.numbered(inputs.table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), "p_partkey")
    one = part.select("p_partkey", "place", (F.col("p_retailprice") / 100).alias("s1"), F.col("p_size").alias("w1"), (F.col("p_partkey") % 2).alias("l1"), (F.col("p_partkey") % 3).alias("r1"), (F.col("p_size") % 2).alias("l2"), (F.col("p_size") % 3).alias("r2"))
    price, size = part.select((F.col("place") - 1).alias("place"), "p_retailprice"), part.select((F.col("place") - 7).alias("place"), F.col("p_size").alias("w2"))
    rows = one.join(price, "place", "left").join(size, "place", "left").withColumn("s2", F.coalesce("p_retailprice", F.lit(1000.0)) / 100).withColumn("w2", F.coalesce("w2", F.lit(5)))
    side = lambda i: {"score": F.col(f"s{i}"), "weight": F.col(f"w{i}"), "level": F.col(f"l{i}"), "results": F.col(f"r{i}")}
    return rows.select("p_partkey", matching.compare_column(side(1), side(2)).alias("sign"))


@_query("""SELECT p_partkey, CAST(list_max([c.code FOR c IN m]) AS INTEGER) AS code, round(list_reduce(list_concat([1.0], [CAST(c.score AS DOUBLE) FOR c IN m]), lambda a, x: a * x), 6) AS score FROM (
    SELECT p_partkey, [{'score': CASE WHEN length(x) % 2 = 0 THEN 4.0 ELSE 2.0 / length(x) END, 'code': length(x) % 4} FOR x IN string_split(p_name, ' ')] AS m FROM part)""")
def match_product(spark, sf):
    n = F.length
    matches = F.transform(F.split("p_name", " "), lambda t: F.struct(F.when(n(t) % 2 == 0, 4.0).otherwise(F.lit(2.0) / n(t)).alias("score"), (n(t) % 4).alias("code")))
    rows = inputs.table(spark, sf, "part").select("p_partkey", matches.alias("m"))
    return rows.select("p_partkey", F.array_max(F.transform("m", lambda m: m["code"])).alias("code"), F.round(F.aggregate("m", F.lit(1.0), lambda a, m: a * m["score"]), 6).alias("score"))


@_query("""SELECT o_custkey AS query_id, o_orderkey AS forest_id, round(exp(10.0 * o_totalprice / max(o_totalprice) OVER w) / sum(exp(10.0 * o_totalprice / m)) OVER w, 9) AS norm_score
    FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WINDOW w AS (PARTITION BY o_custkey)""")
def softmax_norm(spark, sf):
    rows = inputs.table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("forest_id"), F.col("o_totalprice").alias("score"))
    return forests.normalised(rows).select("query_id", "forest_id", F.round("norm_score", 9).alias("norm_score"))


# ---- forests


def _readings(spark, sf) -> DataFrame:
    records, posting = _posting(spark, sf)
    return search.read_queries(inputs.queries_table(spark), records, posting, INSTANCE)


@_query()
def tag_forests(spark, sf):
    members = F.transform("members", lambda m: F.concat_ws("/", F.array_join(m["inputs"], " "), F.array_join(F.transform(m["matches"], lambda x: x["matched"]), " ")))
    return _readings(spark, sf).select("query_id", "forest_id", "score", F.round("norm_score", 9).alias("norm_score"), F.array_join(members, "; ").alias("members"))


@_query()
def best_forest(spark, sf):
    best = forests.best_forests(_readings(spark, sf))
    return best.select("query_id", "score", F.size("members").alias("n_members"), F.explode(F.flatten(F.transform("members", lambda m: m["tags"]))).alias("t")).select("query_id", "score", "n_members", "t.tag_type", "t.name")


@_query(f"""WITH {SQL_QUERIES}, m AS (SELECT query_id, tokens, unnest(range(0, CAST(pow(2, len(tokens) - 1) AS BIGINT))) AS mask FROM qt),
    j AS (SELECT query_id, list_reduce(list_concat([tokens[1]], [CASE WHEN (mask >> (i - 2)) & 1 = 1 THEN '|' ELSE '+' END || tokens[i] FOR i IN range(2, len(tokens) + 1)]), lambda a, x: a || x) AS s FROM m)
    SELECT DISTINCT query_id, s AS segments FROM j WHERE list_max([len(string_split(r, '+')) FOR r IN string_split(s, '|')]) <= 3""")
def segmentations(spark, sf):
    return scoring.segmentations(retrieval.tokenised_queries(inputs.queries_table(spark)))


# ---- intents: all distinct texts of the parts are queries


_SQL_ASKED = f"""asked AS (SELECT min(p_partkey) AS query_id, concat_ws(' ', p_brand, p_name, p_type) AS query FROM part GROUP BY query),
    aq AS (SELECT query_id, {sql_words("query")} AS tokens FROM asked),
    sug AS (SELECT key, name AS class, CAST(count(*) AS DOUBLE) AS weight FROM emit WHERE tag_type IN ('Intent', 'NGram') GROUP BY ALL),
    len3 AS (SELECT query_id, tokens, unnest([1, 2, 3]) AS n FROM aq WHERE len(tokens) BETWEEN 1 AND 7),
    spans AS (SELECT query_id, tokens, n, unnest(range(1, len(tokens) - n + 2)) AS start FROM len3),
    gr AS (SELECT query_id, start, n, class, weight FROM (SELECT *, array_to_string(tokens[start:start + n - 1], '/') AS key FROM spans) JOIN sug USING (key)),
    opt AS (SELECT s.query_id, s.start, class, weight FROM (SELECT * FROM spans WHERE n = 1) s LEFT JOIN (SELECT * FROM gr WHERE n = 1) g ON g.query_id = s.query_id AND g.start = s.start),
    walk AS (SELECT query_id, 0 AS upto, []::VARCHAR[] AS path FROM aq WHERE len(tokens) BETWEEN 1 AND 7
      UNION ALL SELECT w.query_id, w.upto + 1, list_append(w.path, coalesce(o.class, '-')) FROM walk w JOIN opt o ON o.query_id = w.query_id AND o.start = w.upto + 1),
    rdg AS (SELECT w.query_id, path FROM walk w JOIN aq ON aq.query_id = w.query_id AND w.upto = len(tokens))"""


def _asked(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All distinct texts of the parts as queries, and as suggestions how many entities of a class have a key."""
    text = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("query"))
    asked = text.groupBy("query").agg(F.min("p_partkey").alias("query_id")).select("query_id", analysis.words(F.col("query")).alias("tokens"))
    known = _emitted(spark, sf).where("tag_type in ('Intent', 'NGram')").groupBy("key", F.col("name").alias("class")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return written(asked, "asked"), written(known, "suggestions")


@_query(f"WITH RECURSIVE {SQL_ENTITIES}, {_SQL_ASKED} SELECT query_id, array_to_string(path, ' ') AS tags FROM rdg")
def intent_paths(spark, sf):
    """Paths of one-token members whose tags are the classes that the store suggests for the token."""
    asked, known = _asked(spark, sf)
    tokens = asked.select("query_id", F.posexplode("tokens").alias("place", "key")).join(known, "key", "left")
    member = F.struct(F.filter(F.collect_list("class"), lambda c: c.isNotNull()).alias("tags"))
    members = tokens.groupBy("query_id", "place").agg(member.alias("m")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("s"))
    forest = members.select("query_id", F.lit(0).alias("forest_id"), F.col("s.m").alias("members"))
    return intents.intent_paths(forest).select("query_id", F.array_join(F.transform("tags", lambda t: F.coalesce(t, F.lit("-"))), " ").alias("tags"))


@_query(f"""WITH RECURSIVE {SQL_ENTITIES}, {_SQL_ASKED},
    pick AS (SELECT r.query_id, r.path, o.start, o.class, o.weight FROM rdg r JOIN opt o ON o.query_id = r.query_id AND o.class = r.path[o.start]),
    isl AS (SELECT *, start - row_number() OVER (PARTITION BY query_id, path, class ORDER BY start) AS island FROM pick),
    grp AS (SELECT query_id, path, class, island, min(start) AS first, max(start) AS last, sum(weight) AS base FROM isl GROUP BY ALL),
    ext AS (SELECT g.query_id, g.path, g.first, sum(5 * base + b.weight - (SELECT sum(p.weight) FROM pick p WHERE p.query_id = g.query_id AND p.path = g.path AND p.start BETWEEN b.start AND b.start + b.n - 1)) AS extra
      FROM grp g JOIN gr b ON b.n > 1 AND b.query_id = g.query_id AND b.class = g.class AND b.start >= g.first AND b.start + b.n - 1 <= g.last GROUP BY ALL),
    num AS (SELECT g.*, (g.last - g.first + 1) * (g.base + coalesce(extra, 0)) AS weight, row_number() OVER (PARTITION BY g.query_id, g.path ORDER BY g.first) AS k FROM grp g LEFT JOIN ext e ON e.query_id = g.query_id AND e.path = g.path AND e.first = g.first),
    aba AS (SELECT a.query_id, a.path, a.k FROM num a JOIN num b ON b.query_id = a.query_id AND b.path = a.path AND b.k = a.k + 1 JOIN num c ON c.query_id = a.query_id AND c.path = a.path AND c.k = a.k + 2 WHERE a.class = c.class AND a.class <> b.class),
    sc AS (SELECT query_id, path, sum(weight * pow(0.5, (SELECT count(*) FROM aba WHERE aba.query_id = num.query_id AND aba.path = num.path AND num.k BETWEEN aba.k AND aba.k + 2))) AS score FROM num GROUP BY ALL),
    al AS (SELECT r.query_id, r.path, coalesce(score, 0) AS score FROM rdg r LEFT JOIN sc ON sc.query_id = r.query_id AND sc.path = r.path),
    nm AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM al), ex AS (SELECT *, CASE WHEN top > 0 THEN exp(10.0 * score / top) END AS part FROM nm)
    SELECT query_id, array_to_string(path, ' ') AS classes, score, round(norm, 9) AS norm_score FROM (SELECT *, coalesce(part / sum(part) OVER (PARTITION BY query_id), score) AS norm FROM ex) WHERE norm >= 0.25""")
def intent_ranking(spark, sf):
    """Readings of the parts' texts by classes, with at least a quarter of the weight."""
    return intents.ranked(*_asked(spark, sf)).select("query_id", "classes", "score", F.round("norm_score", 9).alias("norm_score"))
