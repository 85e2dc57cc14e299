"""The driver's tables as inputs of the engine, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INSTANCES
from ..functions.analysis import words
from ..operators.store import ancestors_of

INSTANCE = INSTANCES["default"]
FIELDS = ("brand", "model", "variant", "name", "listing_city", "city")

QUERIES = [
    (1, "Cold Widget"), (2, "widgte"), (3, "brand 13"), (4, "Asia"), (5, "colld wigdet"), (6, "economy"), (7, "small ring price"),
    (8, "red gea"), (9, "middle east"), (10, "bluebolt"), (11, "zzzz"), (12, "promo hot rod in europe"), (13, "  "), (14, "one two three four five six seven eight nine"), (15, "grand auto 24 hub"),
]
KEYWORDS = [("PAGETYPE", "price", "Price"), ("PAGETYPE", "price list", "Price"), ("PAGETYPE", "user review", "Review")]
STOP_WORDS = ["in", "the"]
DEALERS = ["Grand Auto 24 Hub", "No 1 Parts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def queries_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity rows: brands, models and variants of the parts, regions as places, dealers, keywords and stop words."""
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("array<string>")

    def intent(rows: DataFrame, name: str, value: str) -> DataFrame:
        have = rows.columns
        above = {f"ancestors.{c}": F.col(c) if c in have else none for c in ("brand", "model")}
        return rows.select(F.lit("intent").alias("type"), F.lit(name).alias("name"), F.col(value).alias("value"), F.lit(None).cast("string").alias("normalised_value"), ancestors_of(above).alias("ancestors"))

    brands = lambda c: F.sort_array(F.collect_set(c))
    out = intent(part.select("p_brand").distinct(), "brand", "p_brand")
    out = out.unionByName(intent(part.groupBy("p_type").agg(brands("p_brand").alias("brand")), "model", "p_type"))
    out = out.unionByName(intent(part.groupBy("p_name").agg(brands("p_brand").alias("brand"), brands("p_type").alias("model")), "variant", "p_name"))
    out = out.unionByName(intent(table(spark, sf_dir, "region").select("r_name"), "city", "r_name"))
    out = out.unionByName(intent(spark.createDataFrame([(d,) for d in DEALERS], "v string"), "dealer_name", "v"))
    fixed = [("keyword", n, v, w) for n, v, w in KEYWORDS] + [("stopWord", "stop", v, None) for v in STOP_WORDS]
    return out.unionByName(spark.createDataFrame(fixed, "type string, name string, value string, normalised_value string").withColumn("ancestors", F.lit(None).cast("map<string,array<string>>")))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_type, a token array for each of FIELDS, and model_status."""
    part = table(spark, sf_dir, "part")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", words(F.col("r_name")).alias("r_name"))
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, kind: str, doc_id: str, **fields: str) -> DataFrame:
        status, kinds = fields.pop("status", None), dict(df.dtypes)
        tokens = lambda c: F.coalesce(F.col(c) if kinds[c] == "array<string>" else words(F.col(c)), none)
        text = [(tokens(fields[f]) if f in fields else none).alias(f) for f in FIELDS]
        return df.select(F.expr(doc_id).cast("string").alias("doc_id"), F.lit(kind).alias("doc_type"), *text, (F.expr(status) if status else F.lit(0)).cast("int").alias("model_status"))

    # words of parts and places are found before they meet the many rows that name them
    told = part.select("p_partkey", *[words(F.col(c)).alias(c) for c in ("p_brand", "p_type", "p_name")])
    supplier = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    used = table(spark, sf_dir, "lineitem").join(told, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    dealers = supplier.join(told, F.col("s_suppkey") == F.col("p_partkey"), "left")
    models = part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("size"))
    parts = [
        rows(part.select("p_brand").distinct(), "new_brand", "p_brand", brand="p_brand"),
        rows(models, "new_model", "concat_ws('/', p_brand, p_type)", brand="p_brand", model="p_type", status="size % 3"),
        rows(part.groupBy("p_brand", "p_type", "p_name").agg(F.min("p_size").alias("size")), "new_variant", "concat_ws('/', p_brand, p_type, p_name)", brand="p_brand", model="p_type", variant="p_name", status="size % 3"),
        rows(models, "new_model_page", "concat_ws('/', p_brand, p_type, 'price')", name="p_type"),
        rows(used, "used_item", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", brand="p_brand", model="p_type", variant="p_name", listing_city="r_name"),
        rows(part, "news", "p_partkey", brand="p_brand", model="p_type", variant="p_name"),
        rows(dealers, "dealer", "s_suppkey", brand="p_brand", city="r_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- the same in DuckDB's SQL


def sql_words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def sql_number(token: str) -> str:
    return rf"regexp_full_match({token}, '-?\p{{Nd}}*\.?\p{{Nd}}+')"


def sql_values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


SQL_ENTITIES = f"""
ent AS (
  SELECT 'intent' AS type, 'brand' AS name, p_brand AS value, CAST(NULL AS VARCHAR) AS normalised_value, CAST([] AS VARCHAR[]) AS anc_brand, CAST([] AS VARCHAR[]) AS anc_model FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT 'intent', 'model', p_type, NULL, list_sort(list(DISTINCT p_brand)), [] FROM part GROUP BY p_type
  UNION ALL SELECT 'intent', 'variant', p_name, NULL, list_sort(list(DISTINCT p_brand)), list_sort(list(DISTINCT p_type)) FROM part GROUP BY p_name
  UNION ALL SELECT 'intent', 'city', r_name, NULL, [], [] FROM region
  UNION ALL SELECT 'intent', 'dealer_name', v, NULL, [], [] FROM {sql_values([(d,) for d in DEALERS])} AS d(v)
  UNION ALL SELECT 'keyword', n, v, w, [], [] FROM {sql_values(KEYWORDS)} AS k(n, v, w)
  UNION ALL SELECT 'stopWord', 'stop', v, NULL, [], [] FROM {sql_values([(s,) for s in STOP_WORDS])} AS s(v)),
tok AS (SELECT *, {sql_words("value")} AS t FROM ent),
emit AS (
  SELECT array_to_string(t, '/') AS key, CASE type WHEN 'intent' THEN 'Intent' WHEN 'keyword' THEN 'Keyword' ELSE 'StopWord' END AS tag_type, name,
         CASE WHEN type = 'keyword' THEN normalised_value END AS normalised_value, CAST(NULL AS VARCHAR) AS ref_tag_type, anc_brand, anc_model FROM tok
  UNION ALL SELECT x, 'NGram', name, NULL, 'Intent', anc_brand, anc_model FROM (SELECT *, unnest(t) AS x FROM tok WHERE type = 'intent' AND len(t) > 1)
    WHERE NOT {sql_number("x")} AND length(x) > 1
  UNION ALL SELECT t[i] || '/' || t[i + 1], 'NGram', name, NULL, 'Intent', anc_brand, anc_model FROM (SELECT *, unnest(range(1, len(t))) AS i FROM tok WHERE type = 'intent' AND len(t) > 2)
    WHERE (NOT {sql_number("t[i]")} AND length(t[i]) > 1) OR (NOT {sql_number("t[i + 1]")} AND length(t[i + 1]) > 1))"""

SQL_SOUNDEX_LETTERS = "upper(regexp_replace({w}, '[^A-Za-z]', '', 'g'))"


def sql_soundex(w: str) -> str:
    letters = SQL_SOUNDEX_LETTERS.format(w=w)
    digits = f"translate({letters}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01360240043788015936020505')"
    return f"substr({letters}, 1, 1) || array_to_string([substr({digits}, i, 1) FOR i IN range(1, length({letters}) + 1) IF i = 1 OR substr({digits}, i, 1) <> substr({digits}, i - 1, 1)], '')"


def sql_grams(w: str, kind: str) -> str:
    longest = f"least(CASE WHEN length({w}) > 5 THEN 4 WHEN length({w}) = 5 THEN 3 ELSE 2 END, length({w}))"
    if kind == "ng_s":
        return f"[substr({w}, 1, k) FOR k IN range(1, {longest} + 1)]"
    if kind == "ng_e":
        return f"[substr({w}, length({w}) - k + 1, k) FOR k IN range(1, {longest} + 1)]"
    return f"list_distinct(list_concat([{w}], flatten([[substr({w}, i, k) FOR i IN range(1, length({w}) - k + 2)] FOR k IN range(CASE WHEN length({w}) >= 5 THEN 2 ELSE 1 END, {longest} + 1)])))"


def sql_encoded(source: str) -> str:
    """(token, kind, value) of the distinct tokens in `source`."""
    guard = f"length(token) > 2 AND NOT {sql_number('token')}"
    parts = [f"SELECT token, '{k}' AS kind, unnest({sql_grams('token', k)}) AS value FROM {source} WHERE {guard}" for k in ("ng", "ng_s", "ng_e")]
    letters = SQL_SOUNDEX_LETTERS.format(w="token")
    parts.append(f"SELECT token, 'rs', {sql_soundex('token')} FROM {source} WHERE {guard} AND length({letters}) > 0")
    return " UNION ALL ".join(parts)


SQL_POSTINGS = f"""{SQL_ENTITIES},
keys AS (SELECT DISTINCT key, string_split(key, '/') AS t FROM emit),
full_entries AS (SELECT key, list_concat(flatten([list_concat([{{'token': x, 'weight': 1.0}}], [{{'token': substr(x, 1, k), 'weight': 0.5}} FOR k IN range(1, least(length(x) - 1, 20) + 1)]) FOR x IN t]),
                        CASE WHEN len(t) > 1 THEN [{{'token': array_to_string(t, ''), 'weight': 1.0}}] ELSE [] END) AS e FROM keys),
entries AS (SELECT key, i AS enc_idx, e[i + 1].token AS token, CAST(e[i + 1].weight AS DOUBLE) AS weight FROM (SELECT key, e, unnest(range(0, len(e))) AS i FROM full_entries)),
vocabulary AS (SELECT DISTINCT token FROM entries),
encoded AS ({sql_encoded("vocabulary")}),
posting AS (SELECT key, enc_idx, 'token' AS kind, token AS value, weight FROM entries UNION ALL SELECT e.key, e.enc_idx, c.kind, c.value, e.weight FROM entries e JOIN encoded c USING (token))"""

SQL_QUERIES = f"""
q AS (SELECT query_id, lower(trim(query)) AS query FROM {sql_values(QUERIES)} AS v(query_id, query)),
qt AS (SELECT query_id, tokens FROM (SELECT query_id, {sql_words("query")} AS tokens FROM q) WHERE len(tokens) BETWEEN 1 AND 8),
spans AS (SELECT query_id, tokens AS all_tokens, list_concat([{{'s': 1, 'n': len(tokens)}}], flatten([[{{'s': i, 'n': k}} FOR k IN range(1, least(len(tokens) - i + 1, CASE WHEN len(tokens) > 3 THEN 3 WHEN len(tokens) > 2 THEN 2 ELSE 1 END) + 1) IF k < len(tokens)] FOR i IN range(1, len(tokens) + 1)])) AS s FROM qt),
conj AS (SELECT query_id, c AS conjunct, s[c + 1].s AS start, all_tokens[s[c + 1].s:s[c + 1].s + s[c + 1].n - 1] AS tokens, len(all_tokens) AS n FROM (SELECT *, unnest(range(0, len(s))) AS c FROM spans)),
conjuncts AS (SELECT query_id, conjunct, start, tokens FROM conj WHERE n = 1 OR (len(list_filter(tokens, lambda x: NOT {sql_number("x")})) > 0 AND (len(tokens) > 1 OR length(tokens[1]) > 1))),
parts AS (SELECT query_id, conjunct, list_concat(tokens, CASE WHEN len(tokens) > 1 THEN [array_to_string(tokens, '')] ELSE [] END) AS c FROM conjuncts),
clauses AS (SELECT query_id, conjunct, i AS clause, c[i + 1] AS token FROM (SELECT *, unnest(range(0, len(c))) AS i FROM parts))"""

SQL_RETRIEVAL = f"""{SQL_POSTINGS}, {SQL_QUERIES},
qv AS (SELECT DISTINCT token FROM clauses),
qe AS ({sql_encoded("qv")}),
qn AS (SELECT *, count(*) OVER w AS n, sum(length(value)) OVER w AS total FROM qe WINDOW w AS (PARTITION BY token, kind)),
terms AS (SELECT token, kind, value, CAST(CASE WHEN kind = 'ng' THEN floor(length(value) * 100.0 / total + 0.5) WHEN kind LIKE 'ng%' THEN floor(length(value) * 200.0 / total + 0.5) ELSE floor(200.0 / n + 0.5) END AS DOUBLE) AS boost,
                 CASE WHEN kind = 'ng' THEN least(greatest(floor(0.2 * n), 2), n) ELSE 1 END AS least_found FROM qn),
idf AS (SELECT value, ln(1 + ((SELECT count(*) FROM posting WHERE kind = 'token') - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posting WHERE kind = 'token' GROUP BY value),
all_terms AS (SELECT * FROM terms UNION ALL SELECT token, 'token', token, 2050.0 * idf, 1 FROM qv JOIN idf ON idf.value = qv.token),
hits AS (SELECT token, key, enc_idx, kind, sum(boost) AS boost, any_value(weight) AS weight FROM all_terms t JOIN posting p USING (kind, value) GROUP BY token, key, enc_idx, kind HAVING count(*) >= any_value(least_found)),
enc AS (SELECT token, key, enc_idx, max(boost) FILTER (kind = 'token') AS exact, sum(boost) FILTER (kind <> 'token') AS encoded, any_value(weight) AS weight FROM hits GROUP BY token, key, enc_idx),
enc_scores AS (SELECT query_id, conjunct, clause, key, enc_idx, exact, encoded, weight * greatest(coalesce(exact, 0), coalesce(encoded, 0)) AS score FROM clauses JOIN enc USING (token)),
clause_best AS (SELECT query_id, conjunct, clause, key, max(score) AS score FROM enc_scores GROUP BY ALL),
scores AS (SELECT query_id, conjunct, key, sum(score) AS score FROM clause_best GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, conjunct ORDER BY score DESC, len(string_split(key, '/')), key) AS rank FROM scores)"""
