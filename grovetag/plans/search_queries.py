"""Queries of the clause operators and of sectioned search."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis
from ..operators import forests, requests, scoring, search, store
from ..sources.stores import written
from . import inputs
from .inputs import FIELDS, INSTANCE, sql_words, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- clauses over the parts: fields brand, model and variant as token arrays

_SQL_PARTS = f"p AS (SELECT p_partkey AS doc_id, p_size, p_type, {sql_words('p_brand')} AS brand, {sql_words('p_type')} AS model, {sql_words('p_name')} AS variant, flatten([[CASE WHEN k < length(x) THEN 'e#' || substr(x, 1, k) ELSE x END FOR k IN range(1, least(length(x), 20) + 1)] FOR x IN {sql_words('p_name')}]) AS edges FROM part)"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    w = analysis.words
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_size", "p_type", w(F.col("p_brand")).alias("brand"), w(F.col("p_type")).alias("model"), w(F.col("p_name")).alias("variant"), analysis.analyze(F.col("p_name"), "text").alias("edges"))


def _scored(spark, sf, clause) -> DataFrame:
    return _parts(spark, sf).select("doc_id", clause.alias("score")).where("score is not null")


def _sql_scored(score: str) -> str:
    return f"WITH {_SQL_PARTS} SELECT doc_id, score FROM (SELECT doc_id, {score} AS score FROM p) WHERE score IS NOT NULL"


def _sql_term(field: str, value: str, boost: float = 1.0) -> str:
    return f"CASE WHEN list_contains({field}, '{value}') THEN CAST({boost} AS DOUBLE) END"


def _sql_should(*clauses: str, least: int = 1) -> str:
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in clauses)
    return f"CASE WHEN {n} >= {least} THEN {' + '.join(f'coalesce({c}, 0)' for c in clauses)} END"


def _t(field: str, value: str, boost: float = 1.0):
    return scoring.term(F.col(field), value, boost)


@_query(f"WITH {_SQL_PARTS} SELECT doc_id FROM p WHERE list_contains(variant, 'widget')")
def term_filter(spark, sf):
    return _scored(spark, sf, _t("variant", "widget")).select("doc_id")


@_query(_sql_scored(_sql_term("variant", "widget", 2.5)))
def constant_score(spark, sf):
    return _scored(spark, sf, _t("variant", "widget", 2.5))


@_query(_sql_scored(_sql_term("edges", "e#wid")))
def edge_gram_term(spark, sf):
    return _scored(spark, sf, _t("edges", "e#wid"))


@_query(_sql_scored(f"{_sql_term('variant', 'cold')} + {_sql_term('edges', 'e#wid')}"))
def bool_must(spark, sf):
    return _scored(spark, sf, scoring.must(_t("variant", "cold"), _t("edges", "e#wid")))


@_query(_sql_scored(_sql_should(_sql_term("variant", "cold"), _sql_term("model", "economy"), _sql_term("brand", "13"))))
def bool_should(spark, sf):
    return _scored(spark, sf, scoring.should(_t("variant", "cold"), _t("model", "economy"), _t("brand", "13")))


@_query(_sql_scored(_sql_should(_sql_term("variant", "cold"), _sql_term("model", "economy"), _sql_term("brand", "13"), _sql_term("variant", "gear"), least=2)))
def min_should_match(spark, sf):
    return _scored(spark, sf, scoring.should(_t("variant", "cold"), _t("model", "economy"), _t("brand", "13"), _t("variant", "gear"), least=2))


@_query(f"WITH {_SQL_PARTS} SELECT doc_id FROM p WHERE p_type = 'ECONOMY' AND list_contains(variant, 'cold')")
def type_filter(spark, sf):
    return _parts(spark, sf).where((F.col("p_type") == "ECONOMY") & F.array_contains("variant", "cold")).select("doc_id")


@_query(f"WITH {_SQL_PARTS} SELECT doc_id FROM p WHERE p_type = 'PROMO' AND list_contains(brand, 'brand') AND list_has_all(variant, ['hot', 'rod'])")
def page_type_filter(spark, sf):
    return _parts(spark, sf).where((F.col("p_type") == "PROMO") & F.array_contains("brand", "brand") & scoring.all_tokens(F.col("variant"), F.lit(["hot", "rod"])).isNotNull()).select("doc_id")


@_query(_sql_scored("CASE WHEN list_has_all(variant, ['cold', 'widget']) THEN 2.0 END"))
def match_all_tokens(spark, sf):
    return _scored(spark, sf, scoring.all_tokens(F.col("variant"), analysis.words(F.lit("Cold, WIDGET!"))))


@_query(_sql_scored(f"greatest({_sql_term('variant', 'cold', 3)}, {_sql_term('model', 'economy', 2)}, {_sql_term('brand', '13', 5)})"))
def dis_max(spark, sf):
    return _scored(spark, sf, scoring.dis_max(_t("variant", "cold", 3), _t("model", "economy", 2), _t("brand", "13", 5)))


@_query(_sql_scored(_sql_should(_sql_term("variant", "widget"), f"0.5 * {_sql_term('model', 'economy')}", f"0.25 * {_sql_term('brand', '13')}")))
def relaxed_boost(spark, sf):
    return _scored(spark, sf, scoring.should(_t("variant", "widget"), scoring.boosted(_t("model", "economy"), 0.5), scoring.boosted(_t("brand", "13"), 0.25)))


_WORDS = [(1, "cold widget"), (2, "brand 13 economy cold gear"), (3, "small hot ring"), (4, "promo"), (5, "red blue small large rod bolt")]
_SQL_MATCHES = f"""{_SQL_PARTS}, w AS (SELECT query_id, string_split(words, ' ') AS tokens FROM {inputs.sql_values(_WORDS)} AS v(query_id, words)),
    m AS (SELECT query_id, len(tokens) AS n, unnest(tokens) AS token FROM w), d AS (SELECT doc_id, unnest(list_distinct(list_concat(brand, model, variant))) AS token FROM p),
    hits AS (SELECT query_id, doc_id, any_value(n) AS n, CAST(sum(length(token)) AS DOUBLE) AS score, count(*) AS matched FROM m JOIN d USING (token) GROUP BY query_id, doc_id)"""


def _matches(spark, sf) -> DataFrame:
    words = spark.createDataFrame(_WORDS, "query_id long, words string").select("query_id", F.split("words", " ").alias("tokens"))
    asked = words.select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    have = _parts(spark, sf).select("doc_id", F.explode(F.array_distinct(F.concat("brand", "model", "variant"))).alias("token"))
    return have.join(F.broadcast(asked), "token").select("query_id", "doc_id", "n", F.length("token").cast("double").alias("score"))


@_query(f"WITH {_SQL_MATCHES} SELECT query_id, doc_id, score, matched FROM hits WHERE matched >= CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 ELSE 3 END")
def msm_by_length(spark, sf):
    rows = _matches(spark, sf)
    out = rows.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("matched"), F.first("n").alias("n"))
    return out.where(F.col("matched") >= scoring.least_by_length(F.col("n"))).drop("n")


@_query(f"WITH {_SQL_MATCHES} SELECT query_id, doc_id, score, matched FROM (SELECT *, max(matched) OVER (PARTITION BY query_id) AS most FROM hits) WHERE matched = most")
def smart_min_match(spark, sf):
    return scoring.smart_min_match(_matches(spark, sf))


@_query(_sql_scored("CASE WHEN len(list_intersect(['cold', 'widget', 'gear'], variant)) > 0 THEN len(list_intersect(['cold', 'widget', 'gear'], variant)) * 4.0 END"))
def field_query(spark, sf):
    hits = F.size(F.array_intersect(F.lit(["cold", "widget", "gear"]), F.col("variant")))
    return _scored(spark, sf, F.when(hits > 0, hits * 4.0))


_SQL_FIELD = "100.0 * len(list_intersect(['cold', 'widget', 'coldwidget', 'e#wid'], {f})) + 50.0 * len(list_intersect(['cold', 'widget', 'coldwidget', 'e#wid'], [{f}[i] || {f}[i + 1] FOR i IN range(1, len({f}))])) + 20.0 * len(list_intersect(['cold', 'widget', 'coldwidget', 'e#wid'], flatten([[CASE WHEN k < length(x) THEN 'e#' || substr(x, 1, k) ELSE x END FOR k IN range(1, least(length(x), 20) + 1)] FOR x IN {f}])))"


def _field(column: str, boost: float = 1.0):
    tokens, c = F.lit(["cold", "widget", "coldwidget", "e#wid"]), F.col(column)
    return scoring.field_score(tokens, {"exact": c, "shingle": analysis.shingles(c), "edge": analysis.edge_grams(c)}, boost)


@_query(f"WITH {_SQL_PARTS} SELECT doc_id, CAST({_SQL_FIELD.format(f='variant')} AS DOUBLE) AS score FROM p")
def field_score(spark, sf):
    return _parts(spark, sf).select("doc_id", _field("variant").alias("score"))


@_query(f"WITH {_SQL_PARTS} SELECT doc_id, CAST(2 * ({_SQL_FIELD.format(f='variant')}) + 3 * ({_SQL_FIELD.format(f='model')}) AS DOUBLE) AS score FROM p")
def multi_field_score(spark, sf):
    parts = _parts(spark, sf).select("doc_id", _field("variant", 2.0).alias("a"), _field("model", 3.0).alias("b"))
    return parts.select("doc_id", scoring.dis_max(F.col("a"), F.col("b"), tie=1.0).alias("score"))


_MAIN_WORDS = _WORDS + [(100, "cold hot cold widget"), (101, "a b c d e f g h"), (102, "red gear economy brand 13 small bolt")]


@_query(f"""WITH {_SQL_PARTS}, w AS (SELECT query_id, string_split(words, ' ') AS tokens FROM {inputs.sql_values(_MAIN_WORDS)} AS v(query_id, words)),
    m AS (SELECT query_id, tokens, unnest(range(0, CAST(pow(2, len(tokens) - 1) AS BIGINT))) AS mask FROM w WHERE len(tokens) < 8),
    j AS (SELECT query_id, list_reduce(list_concat([tokens[1]], [CASE WHEN (mask >> (i - 2)) & 1 = 1 THEN '|' ELSE '+' END || tokens[i] FOR i IN range(2, len(tokens) + 1)]), lambda a, x: a || x) AS seg FROM m),
    runs AS (SELECT DISTINCT query_id, seg, string_split(seg, '|') AS r FROM j WHERE list_max([len(string_split(r, '+')) FOR r IN string_split(seg, '|')]) <= 3),
    x AS (SELECT query_id, seg, string_split(unnest(r), '+') AS run FROM runs), doc AS (SELECT doc_id, list_concat(brand, model, variant) AS t FROM p),
    h AS (SELECT query_id, seg, doc_id, count(*) AS matched, CAST(sum(len(run)) AS DOUBLE) AS score FROM x, doc WHERE list_has_all(t, run) GROUP BY ALL),
    best AS (SELECT *, max(matched) OVER (PARTITION BY query_id, seg) AS most FROM h)
    SELECT query_id, doc_id, sum(score) AS score FROM best WHERE matched = most GROUP BY query_id, doc_id""")
def main_query(spark, sf):
    """The engine's main query over all segmentations; with a repeated token, a query that is too long and one of seven tokens."""
    words = spark.createDataFrame(_MAIN_WORDS, "query_id long, words string").select("query_id", F.split("words", " ").alias("tokens"))
    have = _parts(spark, sf).select("doc_id", F.explode(F.array_distinct(F.concat("brand", "model", "variant"))).alias("token"))
    return scoring.main_query(words, have)


_BOOSTS = [("name", None), ("brand", 5.0), ("model", None), ("city", 2.0), ("note", None)]


@_query("SELECT * FROM (VALUES ('name', 1.0::DOUBLE), ('brand', 5.0), ('model', 6.0), ('city', 2.0), ('note', 3.0)) AS v(field, boost)")
def auto_boost(spark, sf):
    return spark.createDataFrame([(f, float(b)) for f, b in scoring.auto_boosts(_BOOSTS)], "field string, boost double")


@_query("SELECT p_partkey, lower('Default') || ':' || 'search' || CASE WHEN p_size % 2 = 0 THEN ':' || p_type ELSE '' END || ':' || p_name || ':10:' || CAST(p_size % 3 AS VARCHAR) AS key FROM part")
def request_key(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(":", F.lit("default"), F.lit("search"), kind, "p_name", F.lit("10"), (F.col("p_size") % 3).cast("string")).alias("key"))


# ---- sections, from given readings: (query_id, route tags), so that SQL can follow

_READ = [(1, "cold widget", "variant"), (2, "economy", "model"), (3, "brand 13", "brand"), (4, "asia", "city"), (5, "hot rod", "variant")]

_SQL_CATALOGUE = f"""
place AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
sup AS (SELECT * FROM supplier JOIN place ON s_nationkey = n_nationkey),
cat AS (
  SELECT p_brand AS doc_id, 'new_brand' AS doc_type, p_brand AS brand, '' AS model, '' AS variant, '' AS place, 0 AS model_status FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT p_brand || '/' || p_type, 'new_model', p_brand, p_type, '', '', min(p_size) % 3 FROM part GROUP BY p_brand, p_type
  UNION ALL SELECT p_brand || '/' || p_type || '/' || p_name, 'new_variant', p_brand, p_type, p_name, '', min(p_size) % 3 FROM part GROUP BY p_brand, p_type, p_name
  UNION ALL SELECT p_brand || '/' || p_type || '/price', 'new_model_page', '', '', '', '', 0 FROM part GROUP BY p_brand, p_type
  UNION ALL SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'used_item', p_brand, p_type, p_name, r_name, 0 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN sup ON l_suppkey = s_suppkey
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'news', p_brand, p_type, p_name, '', 0 FROM part
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'dealer', coalesce(p_brand, ''), '', '', r_name, 0 FROM sup LEFT JOIN part ON s_suppkey = p_partkey),
rd AS (SELECT query_id, string_split(words, ' ') AS terms, level FROM {inputs.sql_values(_READ)} AS v(query_id, words, level)),
words_of AS (SELECT doc_id, doc_type, model_status, brand AS brand_name, model AS model_name, {sql_words("brand")} AS brand, {sql_words("model")} AS model, {sql_words("variant")} AS variant, {sql_words("place")} AS place FROM cat),
anc AS (SELECT lower(p_type) AS k, 'model' AS level, p_brand AS b, CAST(NULL AS VARCHAR) AS m FROM part UNION SELECT lower(p_name), 'variant', p_brand, CAST(NULL AS VARCHAR) FROM part UNION SELECT lower(p_name), 'variant', NULL, p_type FROM part)"""

_SQL_NEW = """new_scores AS (SELECT query_id, 'new_item' AS section, doc_id, doc_type, model_status, CAST(len(terms) AS DOUBLE) AS score FROM rd JOIN words_of ON
    (doc_type = 'new_brand' AND level = 'brand' AND list_has_all(brand, terms)) OR (doc_type = 'new_model' AND level IN ('brand', 'model') AND list_has_all(model, terms)) OR (doc_type = 'new_variant' AND level IN ('brand', 'model', 'variant') AND list_has_all(variant, terms)))"""
_SQL_USED = """used_scores AS (SELECT query_id, 'used_item' AS section, doc_id, doc_type, model_status, CAST(len(terms) AS DOUBLE) AS score FROM rd JOIN words_of ON doc_type = 'used_item' AND list_has_all(CASE WHEN level = 'city' THEN place ELSE variant END, terms))"""
_SQL_NEWS = """news_parts AS (
    SELECT query_id, doc_id, CAST(len(terms) AS DOUBLE) AS score FROM rd JOIN words_of ON doc_type = 'news' AND level <> 'city' AND list_has_all(CASE level WHEN 'variant' THEN variant WHEN 'model' THEN model ELSE brand END, terms)
    UNION ALL SELECT query_id, doc_id, 0.5 * len(string_split(anc.m, ' ')) FROM rd JOIN anc ON k = array_to_string(terms, ' ') AND anc.level = rd.level AND rd.level = 'variant' AND anc.m IS NOT NULL JOIN words_of w ON doc_type = 'news' AND model_name = anc.m
    UNION ALL SELECT query_id, doc_id, (CASE WHEN rd.level = 'variant' THEN 0.25 ELSE 0.5 END) * 2 FROM rd JOIN anc ON k = array_to_string(terms, ' ') AND anc.level = rd.level AND anc.b IS NOT NULL JOIN words_of w ON doc_type = 'news' AND brand_name = anc.b),
news_scores AS (SELECT query_id, 'news' AS section, doc_id, 'news' AS doc_type, 0 AS model_status, CAST(sum(score) AS DOUBLE) AS score FROM news_parts GROUP BY query_id, doc_id)"""
_SQL_DEALERS = """dealer_parts AS (
    SELECT query_id, doc_id, CAST(len(terms) AS DOUBLE) AS score FROM rd JOIN words_of ON doc_type = 'dealer' AND level IN ('brand', 'city') AND list_has_all(CASE WHEN level = 'brand' THEN brand ELSE place END, terms)
    UNION ALL SELECT query_id, doc_id, 2.0 FROM rd JOIN anc ON k = array_to_string(terms, ' ') AND anc.level = rd.level AND anc.b IS NOT NULL JOIN words_of w ON doc_type = 'dealer' AND brand_name = anc.b),
dealer_scores AS (SELECT query_id, 'dealer' AS section, doc_id, 'dealer' AS doc_type, 0 AS model_status, CAST(sum(score) AS DOUBLE) AS score FROM dealer_parts GROUP BY query_id, doc_id)"""
_SQL_ALL = f"WITH {_SQL_CATALOGUE}, {_SQL_NEW}, {_SQL_USED}, {_SQL_NEWS}, {_SQL_DEALERS}, every AS (SELECT * FROM new_scores UNION ALL SELECT * FROM used_scores UNION ALL SELECT * FROM news_scores UNION ALL SELECT * FROM dealer_scores)"


def _given(spark, sf) -> DataFrame:
    """Best forests as the stated readings would give them: one member each, with the tag and the ancestors of its entity."""
    rows = spark.createDataFrame(_READ, "query_id long, words string, level string")
    known = inputs.entities(spark, sf).where("type = 'intent'").select(F.array_join(analysis.words(F.col("value")), " ").alias("words"), F.col("name").alias("level"), "ancestors")
    rows = rows.join(known, ["words", "level"])
    match = F.transform(F.split("words", " "), lambda t: F.struct(t.alias("input"), t.alias("matched"), F.lit(0).alias("code"), F.lit(4.0).alias("score")))
    tag = F.struct(F.lit("Intent").alias("tag_type"), F.col("level").alias("name"), F.lit(None).cast("string").alias("ref_tag_type"), F.lit(None).cast("string").alias("normalised_value"), F.lit(0.0).alias("weight"), "ancestors")
    member = F.struct(F.split("words", " ").alias("inputs"), match.alias("matches"), F.lit(0).alias("code"), F.lit(4.0).alias("score"), F.lit(1.0).alias("weight"), F.array(tag).alias("tags"))
    return rows.select("query_id", F.array(member).alias("members"))


def _section_scores(spark, sf, section: str | None = None, scores=search.clause_scores) -> DataFrame:
    catalogue = inputs.catalogue(spark, sf).where("doc_type <> 'new_model_page'")
    asked = search.clauses(written(search.readings(_given(spark, sf), INSTANCE), "readings"), INSTANCE)
    if section:
        asked = asked.where(F.col("section") == section)
        types = next(s.types for s in INSTANCE.sections if s.name == section)
        catalogue = catalogue.where(F.col("doc_type").isin(*types))  # the other types aren't even scanned
    catalogue = written(catalogue, "catalogue")
    return scores(written(asked, "asked"), written(search.catalogue_postings(catalogue, FIELDS), "catalogue-postings"), catalogue, FIELDS, ("model_status",))


def _section(section: str):
    def run(spark, sf):
        return _section_scores(spark, sf, section).select("query_id", "doc_id", "doc_type", "score")

    return run


for _name, _key, _section_name in (("search_new", "new", "new_item"), ("search_used", "used", "used_item"), ("search_news", "news", "news"), ("search_dealers", "dealer", "dealer")):
    QUERIES[_name] = _section(_section_name)
    SQL[_name] = _SQL_ALL + f" SELECT query_id, doc_id, doc_type, score FROM {_key}_scores"


@_query(_SQL_ALL + " SELECT query_id, section, count(*) AS total_results FROM every GROUP BY query_id, section")
def section_counts(spark, sf):
    return search.with_totals(_section_scores(spark, sf))


_SQL_RANK = "row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, CASE WHEN section = 'new_item' THEN CASE doc_type WHEN 'new_brand' THEN 1 WHEN 'new_model' THEN 2 ELSE 3 END ELSE 0 END, CASE WHEN section = 'new_item' THEN model_status END, doc_type, doc_id)"


@_query(_SQL_ALL + f" SELECT query_id, section, CAST(rank AS INTEGER) AS rank, doc_id, doc_type, score FROM (SELECT *, {_SQL_RANK} AS rank FROM every) WHERE rank <= 10")
def multi_section(spark, sf):
    return search.paged(_section_scores(spark, sf), INSTANCE).select("query_id", "section", "rank", "doc_id", "doc_type", "score")


@_query(_SQL_ALL + f" SELECT query_id, section, CAST(rank AS INTEGER) AS rank, doc_id FROM (SELECT *, {_SQL_RANK} AS rank FROM every) WHERE rank BETWEEN 6 AND 10")
def paged_search(spark, sf):
    return search.paged(_section_scores(spark, sf), INSTANCE, count=5, page=1).select("query_id", "section", "rank", "doc_id")


@_query(f"""WITH {_SQL_CATALOGUE} SELECT doc_id, doc_type, CAST(row_number() OVER (ORDER BY CASE doc_type WHEN 'new_model_page' THEN 0 WHEN 'new_brand' THEN 1 WHEN 'new_model' THEN 2 ELSE 3 END, model_status, doc_type, doc_id) AS INTEGER) AS place FROM cat WHERE doc_type LIKE 'new%'""")
def type_rank_sort(spark, sf):
    rows = inputs.catalogue(spark, sf).where("doc_type like 'new%'")
    order = (search.type_rank(F.col("doc_type"), INSTANCE), "model_status", "doc_type", "doc_id")
    return search.numbered(rows, *order).select("doc_id", "doc_type", F.col("place").cast("int").alias("place"))


@_query("""WITH x AS (SELECT lower(p_name) AS k, p_brand FROM part), w AS (SELECT DISTINCT v AS k FROM (VALUES ('cold widget'), ('hot rod')) AS t(v))
    SELECT DISTINCT s_suppkey AS doc_id FROM supplier JOIN part ON s_suppkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM x JOIN w USING (k))""")
def ancestor_semi_join(spark, sf):
    names = _given(spark, sf).select(F.explode(search.ancestors(F.col("members")[0]["tags"], "brand", ("variant",))).alias("p_brand")).distinct()
    dealers = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    return dealers.join(names, "p_brand", "left_semi").select(F.col("s_suppkey").alias("doc_id"))


@_query(f"SELECT query_id, CASE WHEN level = 'city' THEN 'place' ELSE 'name' END AS route FROM {inputs.sql_values(_READ)} AS v(query_id, words, level)")
def route_query(spark, sf):
    return search.readings(_given(spark, sf), INSTANCE).select("query_id", "route").distinct()


@_query(f"SELECT query_id, CASE level WHEN 'brand' THEN 0 WHEN 'model' THEN 1 WHEN 'variant' THEN 2 END AS level FROM {inputs.sql_values(_READ)} AS v(query_id, words, level)")
def entity_level(spark, sf):
    return _given(spark, sf).select("query_id", search.entity_level(F.flatten(F.transform("members", lambda m: m["tags"])), INSTANCE).alias("level"))


@_query(f"SELECT DISTINCT v AS value, lower(w) AS page_type FROM {inputs.sql_values(inputs.KEYWORDS)} AS t(n, v, w) UNION ALL SELECT DISTINCT p_name, NULL FROM part")
def page_type(spark, sf):
    rows = inputs.entities(spark, sf).where("type = 'keyword' or name = 'variant'")
    kind = F.when(F.col("type") == "keyword", "Keyword").otherwise("Intent")
    tags = F.array(F.struct(kind.alias("tag_type"), "name", "normalised_value"))
    return rows.select("value", search.page_type(tags, INSTANCE).alias("page_type"))


@_query(f"""SELECT query_id, unnest(CASE level WHEN 'brand' THEN ['new_brand', 'new_model', 'new_variant'] WHEN 'model' THEN ['new_model', 'new_variant'] ELSE ['new_variant'] END) AS doc_type FROM {inputs.sql_values(_READ)} AS v(query_id, words, level) WHERE level <> 'city'""")
def section_types(spark, sf):
    asked = search.clauses(search.readings(_given(spark, sf), INSTANCE), INSTANCE)
    return asked.where("section = 'new_item'").select("query_id", "doc_type").distinct()


_SQL_LEVELS = """levels AS (SELECT 'new_brand' AS doc_type, p_brand AS doc_id, p_brand AS name, p_brand AS key, '/' || p_brand AS url FROM part GROUP BY p_brand
    UNION ALL SELECT 'new_model', p_brand || '/' || p_type, p_type, 'k-' || p_type, '/' || p_type FROM part GROUP BY p_brand, p_type
    UNION ALL SELECT 'new_variant', p_brand || '/' || p_type || '/' || p_name, p_name, 'k-' || p_name, '/' || p_name FROM part GROUP BY p_brand, p_type, p_name)"""


@_query(f"WITH {_SQL_LEVELS} SELECT * FROM levels")
def autocomplete_projection(spark, sf):
    part = table(spark, sf, "part")
    names = {"brand": "p_brand", "model": "p_type", "variant": "p_name"}
    out = None
    for i, level in enumerate(INSTANCE.levels):
        own = [names[n] for n in INSTANCE.levels[: i + 1]]
        fields = [F.col(c).alias(n) for n, c in names.items() if c in own] + [F.lit(None).cast("string").alias(n) for n, c in names.items() if c not in own]
        more = [x for n in names for x in (F.concat(F.lit("k-"), F.col(n)).alias(f"{n}_key"), F.concat(F.lit("/"), F.col(n)).alias(f"{n}_url"))]
        rows = part.select(*own).distinct().select(F.lit(f"new_{level}").alias("doc_type"), F.concat_ws("/", *own).alias("doc_id"), *fields).select("doc_type", "doc_id", *names, *more)
        out = rows if out is None else out.unionByName(rows)
    return search.autocomplete_projection(out, INSTANCE)


# ---- requests and responses


_SQL_ASKED = f"asked AS (SELECT DISTINCT query_id, CASE query_id % 2 WHEN 0 THEN 3 ELSE 10 END AS count, CASE query_id % 2 WHEN 0 THEN 1 ELSE 0 END AS page FROM {inputs.sql_values(_READ)} AS v(query_id, words, level))"


def _asked(spark) -> DataFrame:
    """A request for each of the readings; even ones ask for the second page of three."""
    rows = [(q, json.dumps(requests.request(w) if q % 2 else {"q": f" {w} ", "c": 3, "p": "1"})) for q, w, _ in _READ]
    return requests.parsed(spark.createDataFrame(rows, "query_id long, body string"))


@_query(f"""WITH x AS (SELECT p_partkey, p_name, p_size, p_partkey % 6 AS k FROM part)
    SELECT p_partkey, CASE WHEN k < 4 THEN p_name END AS query, CASE WHEN k IN (0, 2) THEN 10 WHEN k IN (1, 3) THEN p_size END AS count, CASE WHEN k IN (0, 1) THEN 0 WHEN k = 2 THEN 4 WHEN k = 3 THEN 0 END AS page,
           CASE WHEN k = 3 THEN 'news' END AS section, CASE k WHEN 4 THEN 'unknown field' WHEN 5 THEN 'not a number' END AS error FROM x""")
def request_fields(spark, sf):
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    text = lambda **f: F.to_json(F.struct(*[v.alias(n) for n, v in f.items()]))
    body = (
        F.when(k == 0, text(query=name)).when(k == 1, text(q=padded, c=F.col("p_size"))).when(k == 2, text(text=name, p=F.lit("4"), instance=F.lit("default")))
        .when(k == 3, text(q=F.lit("other"), query=padded, count=F.col("p_size"), s=F.lit(" news"))).when(k == 4, text(query=name, colour=F.lit("red"))).otherwise(text(query=name, page=F.lit("one")))
    )
    return requests.parsed(table(spark, sf, "part").select("p_partkey", body.alias("body"))).select("p_partkey", "query", "count", "page", "section", "error")


@_query(_SQL_ALL + f""", {_SQL_ASKED}, ranked AS (SELECT *, {_SQL_RANK} AS rank FROM every),
    cut AS (SELECT * FROM ranked JOIN asked USING (query_id) WHERE rank BETWEEN page * count + 1 AND (page + 1) * count),
    c AS (SELECT query_id, section, count(*) AS n FROM cut GROUP BY ALL), t AS (SELECT query_id, section, count(*) AS total FROM every GROUP BY ALL)
    SELECT a.query_id, words AS search_text, CAST(coalesce(sum(n), 0) AS BIGINT) AS count, CAST(coalesce(sum(total), 0) AS BIGINT) AS total_results, coalesce(string_agg(section || ' ' || CAST(coalesce(n, 0) AS VARCHAR) || '/' || CAST(total AS VARCHAR), ', ' ORDER BY
        CASE section WHEN 'new_item' THEN 0 WHEN 'used_item' THEN 1 WHEN 'news' THEN 2 ELSE 3 END), '') AS sections
    FROM (SELECT DISTINCT query_id, words FROM {inputs.sql_values(_READ)} AS v(query_id, words, level)) a LEFT JOIN t USING (query_id) LEFT JOIN c USING (query_id, section) GROUP BY a.query_id, words""")
def search_response(spark, sf):
    asked = written(_asked(spark), "requests")
    scores = written(search.part_ranked(_section_scores(spark, sf, scores=search.dealt_scores), INSTANCE), "scores")
    page = requests.page_of(search.paged(search.first_rows(scores, asked), INSTANCE, count=None), asked)
    out = requests.responses(asked, page, search.with_totals(scores), INSTANCE)
    sections = F.array_join(F.transform("results", lambda s: F.concat_ws("", s["name"], F.lit(" "), s["count"].cast("string"), F.lit("/"), s["total_results"].cast("string"))), ", ")
    return out.select("query_id", "search_text", "count", "total_results", F.coalesce(sections, F.lit("")).alias("sections"))


@_query(_SQL_ALL + f""" SELECT query_id, section, CAST(rank AS INTEGER) AS rank, r.doc_type, doc_id, array_to_string(w.brand, ' ') AS brand, array_to_string(w.variant, ' ') AS variant
    FROM (SELECT *, {_SQL_RANK} AS rank FROM every) r JOIN words_of w USING (doc_id, doc_type) WHERE rank <= 10""")
def search_projection(spark, sf):
    page = search.paged(_section_scores(spark, sf), INSTANCE).select("query_id", "section", "rank", "doc_type", "doc_id")
    rows = requests.with_fields(page, inputs.catalogue(spark, sf), include=("brand", "variant", "model_status"), exclude=("model_status",))
    return rows.select("query_id", "section", "rank", "doc_type", "doc_id", F.array_join("brand", " ").alias("brand"), F.array_join("variant", " ").alias("variant"))


# ---- end to end, from the text of the queries


def _engine(spark, sf):
    records = written(store.build_store(inputs.entities(spark, sf)), "store")
    catalogue = written(inputs.catalogue(spark, sf), "catalogue")
    return records, written(store.postings(records), "postings"), catalogue, written(search.catalogue_postings(catalogue, FIELDS), "catalogue-postings")


@_query()
def search_sections(spark, sf):
    return search.search(inputs.queries_table(spark), *_engine(spark, sf), INSTANCE)


@_query()
def autocomplete(spark, sf):
    return search.autocomplete(inputs.queries_table(spark), *_engine(spark, sf), INSTANCE)


@_query()
def query_readings(spark, sf):
    records, posting, _, _ = _engine(spark, sf)
    best = forests.best_forests(search.read_queries(inputs.queries_table(spark), records, posting, INSTANCE))
    return search.readings(best, INSTANCE).select("query_id", "route", "level", "page_type", "member", F.array_join("terms", " ").alias("terms"))
