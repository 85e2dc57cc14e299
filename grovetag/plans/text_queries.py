"""Queries of the analyzers, encodings and distances, over whole columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, distance, encoding
from . import inputs
from .inputs import sql_grams, sql_words, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Punctuation that may join words; both sides turn it into spaces, as the oracle's expressions know no context.
JOINERS = "'’.:·,;"


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _plain(c: str):
    return F.translate(F.col(c), JOINERS, " " * len(JOINERS))


_SQL_PLAIN = "translate(text, '" + JOINERS.replace("'", "''") + "', '" + " " * len(JOINERS) + "')"


@_query(f"SELECT doc_id, array_to_string({sql_words(_SQL_PLAIN)}, ' ') AS tokens FROM documents")
def analyze_standard(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(analysis.words(_plain("text")), " ").alias("tokens"))


@_query(f"SELECT conv_id, turn, array_to_string({sql_words(_SQL_PLAIN)}, ' ') AS tokens FROM conversations")
def analyze_query(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(analysis.analyze(_plain("text"), "query"), " ").alias("tokens"))


@_query("SELECT p_partkey, array_to_string([lower(p_name)], '|') AS tokens FROM part")
def analyze_keyword(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(analysis.keyword(F.col("p_name")), "|").alias("tokens"))


def _sql_edges(low: int, high: int = 20) -> str:
    each = f"CASE WHEN length(x) < {low} THEN [x] ELSE [CASE WHEN k < length(x) THEN 'e#' || substr(x, 1, k) ELSE x END FOR k IN range({low}, least(length(x), {high}) + 1)] END"
    return f"SELECT p_partkey, array_to_string(flatten([{each} FOR x IN {sql_words('p_name')}]), ' ') AS tokens FROM part"


def _named(spark, sf, tokens) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(tokens, " ").alias("tokens"))


@_query(_sql_edges(1))
def analyze_text_edge(spark, sf):
    return _named(spark, sf, analysis.analyze(F.col("p_name"), "text"))


@_query(_sql_edges(2))
def analyze_descriptive_edge(spark, sf):
    return _named(spark, sf, analysis.analyze(F.col("p_name"), "descriptive_text"))


@_query(f"SELECT p_partkey, array_to_string(['e#' || x FOR x IN {sql_words('p_name')}], ' ') AS tokens FROM part")
def analyze_edge_query(spark, sf):
    return _named(spark, sf, analysis.analyze(F.col("p_name"), "edge_query"))


@_query(f"SELECT conv_id, turn, array_to_string([t[i] || t[i + 1] FOR i IN range(1, len(t))], ' ') AS tokens FROM (SELECT conv_id, turn, {sql_words(_SQL_PLAIN)} AS t FROM conversations)")
def analyze_shingle(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(analysis.analyze(_plain("text"), "shingle_text"), " ").alias("tokens"))


@_query(f"SELECT p_partkey, array_to_string(flatten([[substr(x, 1, k) FOR k IN range(3, least(length(x), 20) + 1)] FOR x IN {sql_words('p_name')}]), ' ') AS tokens FROM part")
def analyze_vernacular(spark, sf):
    return _named(spark, sf, analysis.analyze(F.col("p_name"), "vernacular"))


@_query(f"SELECT p_partkey, CASE WHEN k < length(x) THEN 'e#' || substr(x, 1, k) ELSE x END AS gram, x AS source FROM (SELECT *, unnest(range(1, least(length(x), 20) + 1)) AS k FROM (SELECT p_partkey, unnest({sql_words('p_name')}) AS x FROM part))")
def edge_gram_payload(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(analysis.edge_grams_with_source(analysis.words(F.col("p_name")))).alias("g")).select("p_partkey", "g.gram", "g.source")


@_query("SELECT p_partkey, array_to_string(['x-' || x FOR x IN string_split(p_name, ' ') IF length(x) > 0], ' ') AS tokens FROM part")
def prefix_filter(spark, sf):
    return _named(spark, sf, analysis.prefixed(F.split("p_name", " "), "x-"))


_SQL_VOCABULARY = f"SELECT DISTINCT unnest({sql_words(_SQL_PLAIN)}) AS token FROM conversations"


def _vocabulary(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.explode(analysis.words(_plain("text"))).alias("token")).distinct()


def _sql_encoding(kind: str) -> str:
    return f"SELECT token, array_to_string({sql_grams('token', kind)}, ' ') AS grams FROM ({_SQL_VOCABULARY}) WHERE length(token) > 2 AND NOT {inputs.sql_number('token')}"


def _encoded(spark, sf, f) -> DataFrame:
    return _vocabulary(spark, sf).where(encoding.encodable(F.col("token"))).select("token", F.array_join(f(F.col("token")), " ").alias("grams"))


@_query(_sql_encoding("ng").replace(sql_grams("token", "ng"), "list_sort(" + sql_grams("token", "ng") + ")"))
def ngram_encoding(spark, sf):
    return _encoded(spark, sf, lambda t: F.sort_array(encoding.all_grams(t)))


@_query(_sql_encoding("ng_s"))
def ngram_start(spark, sf):
    return _encoded(spark, sf, encoding.start_grams)


@_query(_sql_encoding("ng_e"))
def ngram_end(spark, sf):
    return _encoded(spark, sf, encoding.end_grams)


@_query(f"SELECT token, array_to_string([substr(token, 1, k) FOR k IN range(1, least(length(token) - 1, 20) + 1)], ' ') AS grams FROM ({_SQL_VOCABULARY})")
def proper_prefixes(spark, sf):
    return _vocabulary(spark, sf).select("token", F.array_join(encoding.proper_prefixes(F.col("token")), " ").alias("grams"))


@_query(f"SELECT token, CASE WHEN length({inputs.SQL_SOUNDEX_LETTERS.format(w='token')}) > 0 AND length(token) > 2 THEN {inputs.sql_soundex('token')} END AS sound FROM ({_SQL_VOCABULARY})")
def refined_soundex(spark, sf):
    return _vocabulary(spark, sf).select("token", encoding.refined_soundex(F.col("token")).alias("sound"))


# ---- distances: each part's name against a misspelt form of it

_SQL_TYPOS = """
typos AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 3
    WHEN 0 THEN substr(p_name, 1, k - 1) || substr(p_name, k + 1)
    WHEN 1 THEN substr(p_name, 1, k - 1) || substr(p_name, k + 1, 1) || substr(p_name, k, 1) || substr(p_name, k + 2)
    ELSE substr(p_name, 1, k) || substr(p_name, k, 1) || 'x' || substr(p_name, k + 1) END AS b
  FROM (SELECT *, CAST(1 + p_partkey % (length(p_name) - 1) AS INTEGER) AS k FROM part))"""

_SQL_OSA = """
cells AS (SELECT p_partkey, a, b, list_reduce(list_concat([{'prev': CAST([] AS BIGINT[]), 'row': range(0, length(b) + 1), 'i': 0}],
    [{'prev': CAST([] AS BIGINT[]), 'row': CAST([] AS BIGINT[]), 'i': i} FOR i IN range(1, length(a) + 1)]),
    lambda s, c: {'prev': s.row, 'i': c.i, 'row': list_reduce(list_concat([[CAST(c.i AS BIGINT)]], [[CAST(j AS BIGINT)] FOR j IN range(1, length(b) + 1)]),
      lambda r, j: list_concat(r, [least(s.row[j[1] + 1] + 1, r[j[1]] + 1, s.row[j[1]] + CASE WHEN substr(a, CAST(c.i AS INTEGER), 1) = substr(b, CAST(j[1] AS INTEGER), 1) THEN 0 ELSE 1 END,
        CASE WHEN c.i > 1 AND j[1] > 1 AND substr(a, CAST(c.i AS INTEGER), 1) = substr(b, CAST(j[1] AS INTEGER) - 1, 1) AND substr(a, CAST(c.i AS INTEGER) - 1, 1) = substr(b, CAST(j[1] AS INTEGER), 1)
             THEN s.prev[j[1] - 1] + CASE WHEN substr(a, CAST(c.i AS INTEGER), 1) = substr(b, CAST(j[1] AS INTEGER), 1) THEN 0 ELSE 1 END ELSE 1000000 END)]))}) AS s FROM typos),
osa AS (SELECT p_partkey, a, b, CAST(s.row[length(b) + 1] AS INTEGER) AS d FROM cells)"""


def _typos(spark, sf) -> DataFrame:
    k = F.expr("cast(1 + p_partkey % (length(p_name) - 1) as int)")
    name = F.col("p_name")
    cut = lambda start, n=1000: F.substring(name, start, F.lit(n))
    one = F.lit(1)
    head = F.substring(name, one, k - 1)
    kind = F.col("p_partkey") % 3
    wrong = F.when(kind == 0, F.concat(head, cut(k + 1))).when(kind == 1, F.concat(head, cut(k + 1, 1), cut(k, 1), cut(k + 2))).otherwise(F.concat(F.substring(name, one, k), cut(k, 1), F.lit("x"), cut(k + 1)))
    return table(spark, sf, "part").select("p_partkey", name.alias("a"), wrong.alias("b"))


@_query(f"WITH {_SQL_TYPOS}, {_SQL_OSA} SELECT p_partkey, a, b, d AS distance FROM osa")
def osa_distance(spark, sf):
    return _typos(spark, sf).withColumn("distance", distance.osa_distance(F.col("a"), F.col("b")))


@_query(f"WITH {_SQL_TYPOS}, {_SQL_OSA} SELECT p_partkey, CAST(floor(200.0 * d / (length(a) + length(b)) + 0.5) AS INTEGER) AS percent FROM osa")
def percent_distance(spark, sf):
    rows = _typos(spark, sf)
    return rows.select("p_partkey", distance.percent_distance(distance.osa_distance(F.col("a"), F.col("b")), F.col("a"), F.col("b")).alias("percent"))


_SQL_FOLDED = "translate(lower({x}), 'j', 'z')"
_SQL_FUZZY_STEP = """CASE WHEN r.stop OR strpos(substr(term, r.at), x.c) = 0 THEN {'c': x.c, 'at': r.at, 'last': r.last, 'score': r.score, 'stop': true}
    ELSE {'c': x.c, 'at': r.at + strpos(substr(term, r.at), x.c), 'last': r.at + strpos(substr(term, r.at), x.c) - 1,
          'score': r.score + 1 + CASE WHEN r.at + strpos(substr(term, r.at), x.c) - 1 = r.last + 1 THEN 2 ELSE 0 END, 'stop': false} END"""


@_query(f"""WITH {_SQL_TYPOS}, folded AS (SELECT p_partkey, a, b, {_SQL_FOLDED.format(x="a")} AS term, {_SQL_FOLDED.format(x="b")} AS query FROM typos),
    steps AS (SELECT *, list_concat([{{'c': '', 'at': CAST(1 AS BIGINT), 'last': CAST(-5 AS BIGINT), 'score': CAST(0 AS BIGINT), 'stop': false}}],
        [{{'c': substr(query, i, 1), 'at': CAST(1 AS BIGINT), 'last': CAST(-5 AS BIGINT), 'score': CAST(0 AS BIGINT), 'stop': false}} FOR i IN range(1, length(query) + 1)]) AS s FROM folded)
    SELECT p_partkey, a, b, CAST(list_reduce(s, lambda r, x: {_SQL_FUZZY_STEP}).score AS INTEGER) AS score FROM steps""")
def fuzzy_score(spark, sf):
    return _typos(spark, sf).select("p_partkey", "a", "b", distance.fuzzy_score(F.col("a"), F.col("b")).alias("score"))


@_query("SELECT conv_id, turn, lower(trim(text, ' ')) AS query FROM conversations WHERE length(trim(text, ' ')) > 0")
def normalise_query(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", analysis.normalised_query(F.col("text")).alias("query")).where("query is not null")


@_query(f"SELECT token, {inputs.sql_number('token')} AS is_number FROM ({_SQL_VOCABULARY})")
def number_guard(spark, sf):
    return _vocabulary(spark, sf).select("token", analysis.is_number(F.col("token")).alias("is_number"))
