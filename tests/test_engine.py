import json
import random

import pytest
from grovetag.config import INSTANCES
from grovetag.functions import analysis, distance
from grovetag.operators import forests, intents, matching, requests, retrieval, scoring, search, store
from grovetag.plans import inputs
from grovetag.sources import stores
from grovetag.sources.cache import ResultCache, request_key
from grovetag.streaming import tokens
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

WEIGHTS = INSTANCES["default"].tag_weights


def intent(name, value, **above):
    return ("intent", name, value, None, {k: v for k, v in above.items()} or None)


@pytest.fixture(scope="module")
def entities(spark):
    rows = [
        intent("brand", "Brand#13"), intent("model", "Economy", brand=["Brand#13"]), intent("variant", "cold widget", brand=["Brand#13"], model=["Economy"]),
        intent("variant", "grand old gear", brand=["Brand#2"]), intent("city", "Asia"), ("keyword", "PAGETYPE", "price", "Price", None), ("stopWord", "stop", "the", None, None), ("other", "x", "y", None, None),
        intent("variant", "cold widget", brand=["Brand#1"]), ("intent", "brand", None, None, None), ("intent", "brand", "  ", None, None),
    ]
    return spark.createDataFrame(rows, tokens.ENTITY)


def test_words(spark):
    texts = ["Don't stop", "1.5 and 3,000", "a_b x.y V-MT Brand#13", "हिन्दी", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(analysis.words(F.col("t"))).collect()]
    assert got == [["don't", "stop"], ["1.5", "and", "3,000"], ["a_b", "x.y", "v", "mt", "brand", "13"], ["हिन्दी"], [], None]


def test_edge_grams(spark):
    row = spark.createDataFrame([("honda " + "x" * 22 + " a",)], "t string")
    edges, plain = row.select(analysis.edge_grams(analysis.words(F.col("t")), 2), analysis.plain_edge_grams(analysis.words(F.col("t")))).first()
    assert edges[:4] == ["e#ho", "e#hon", "e#hond", "honda"] and "x" * 22 not in edges and edges[-1] == "a"
    assert plain[:3] == ["hon", "hond", "honda"] and plain[-1] == "x" * 20


def test_numbers(spark):
    cases = {"5": True, "1.5": True, ".5": True, "-5": True, "-.5": True, "٣": True, "5.": False, "-": False, "": False, "v6": False, "1.2.3": False, "12a": False}
    rows = spark.createDataFrame(list(cases.items()), "t string, want boolean").withColumn("got", analysis.is_number(F.col("t"))).collect()
    assert all(r["got"] == r["want"] for r in rows)


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_distance_laws(a, b):
    d = distance.osa(a, b)
    assert d == distance.osa(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_distances():
    assert distance.osa("ca", "abc") == 3 and distance.osa("abcd", "acbd") == 1
    assert distance.percent("widgte", "widget") == 17 and distance.percent("hunday", "hyundai") == 31
    assert distance.fuzzy("Room", "rm") == 2 and distance.fuzzy("jack", "zack") == 10


def test_store(entities):
    rows = {r["key"]: r for r in store.build_store(entities).collect()}
    assert set(rows) == {"brand/13", "brand", "economy", "cold/widget", "cold", "widget", "grand/old/gear", "grand/old", "old/gear", "grand", "old", "gear", "asia", "price", "the"}
    (tag,) = rows["cold/widget"]["tags"]
    assert tag["total_count"] == 2 and tag["ancestors"] == {"brand": ["Brand#1", "Brand#13"], "model": ["Economy"]}
    assert rows["cold"]["tags"][0]["ref_tag_type"] == "Intent" and rows["price"]["tags"][0]["normalised_value"] == "Price"


def test_stream_is_batch(spark, entities, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    entities.repartition(3).write.parquet(source)
    tokens.start(tokens.entity_stream(spark, source, 1), out, str(tmp_path / "state"), None).awaitTermination()
    want = sorted(map(str, store.build_store(entities).collect()))
    assert sorted(map(str, tokens.read_store(spark, out).collect())) == want
    tokens.compact(spark, out)
    assert sorted(map(str, tokens.read_store(spark, out).collect())) == want
    entities.limit(2).write.mode("append").parquet(source)
    tokens.start(tokens.entity_stream(spark, source, 1), out, str(tmp_path / "state"), None).awaitTermination()
    assert tokens.read_tags(spark, out).selectExpr("sum(total_count)").first()[0] > store.merge_tags(store.emit_tokens(entities)).selectExpr("sum(total_count)").first()[0]


def test_empty_stream(spark, tmp_path):
    assert tokens.read_store(spark, f"file://{tmp_path}/none").count() == 0


def tag(kind, name, ref=None):
    return {"tag_type": kind, "name": name, "ref_tag_type": ref, "normalised_value": None, "ancestors": None}


def test_matches():
    m = matching.match_token(("cold", "widgte"), "widget", True, 50)
    assert (m.input, m.code) == ("widgte", matching.PHONETIC) and m.score == pytest.approx(0.83)
    assert matching.match_token(("wid",), "widget", True, 50).score == pytest.approx(2 / 4)
    assert matching.match_token(("zzz",), "widget", True, 50) is None
    one = matching.best_match(("cold", "widget"), ("cold", "widget"), [tag("Intent", "variant")], WEIGHTS)
    assert one.score == 16 and one.weight == 10 and one.level == 0
    part = matching.token_wise(("cold",), ("cold", "widget"), [tag("Intent", "variant")], WEIGHTS)
    assert part.tags[0]["tag_type"] == "NGram" and part.weight == 0
    assert matching.joined(("bluebolt",), ("blue", "bolt"), [], {}).matches[0].code == matching.EXACT


def test_forest_trace():
    whole = matching.best_match(("cold", "widget"), ("cold", "widget"), [tag("Intent", "variant")], WEIGHTS)
    part = matching.best_match(("cold", "widget"), ("cold",), [tag("NGram", "variant", "Intent")], WEIGHTS)
    (forest,) = forests.fold(iter([whole, part]))
    assert [m.score for m in forest] == [16]
    (forest,) = forests.fold(iter([part, whole]))
    assert [m.score for m in forest] == [16]
    other = matching.best_match(("asia",), ("asia",), [tag("Intent", "city")], WEIGHTS)
    (forest,) = forests.fold(iter([whole, other]))
    assert [m.score for m in forest] == [16, 4]


def test_forests_branch():
    a = matching.best_match(("red", "gear"), ("red", "gear"), [tag("Intent", "variant")], WEIGHTS)
    b = matching.best_match(("gear", "ring"), ("gear", "ring"), [tag("Intent", "variant")], WEIGHTS)
    found = forests.fold(iter([a, b]))
    assert sorted(tuple(m.inputs for m in f) for f in found) == [(("gear", "ring"),), (("red", "gear"),)]


def test_search(spark, entities):
    instance = INSTANCES["default"]
    records = store.build_store(entities)
    posting = store.postings(records)
    fields = ("brand", "model", "variant", "name", "listing_city", "city")
    docs = [("b", "new_brand", "brand 13", "", "", ""), ("m", "new_model", "brand 13", "economy", "", ""), ("v", "new_variant", "brand 13", "economy", "cold widget", ""), ("n", "news", "brand 13", "economy", "cold widget", ""), ("u", "used_item", "", "", "cold widget", "asia"), ("d", "dealer", "brand 1", "", "", "asia")]
    split = lambda c: F.filter(F.split(c, " "), lambda t: F.length(t) > 0)
    none = F.array().cast("array<string>")
    catalogue = spark.createDataFrame(docs, "doc_id string, doc_type string, brand string, model string, variant string, place string").select("doc_id", "doc_type", split("brand").alias("brand"), split("model").alias("model"), split("variant").alias("variant"), none.alias("name"), split("place").alias("listing_city"), split("place").alias("city"), F.lit(0).alias("model_status"))
    queries = spark.createDataFrame([(1, "Cold Widgte"), (2, "asia"), (3, ""), (4, "zzzzz"), (5, None), (6, "brand 13")], "query_id long, query string")
    got = search.search(queries, records, posting, catalogue, search.catalogue_postings(catalogue, fields), instance).collect()
    by = {(r["query_id"], r["section"]): [(x["doc_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if (x["query_id"], x["section"]) == (r["query_id"], r["section"])] for r in got}
    assert by[1, "new_item"] == [("v", 2.0)] and by[1, "used_item"] == [("u", 2.0)] and by[1, "dealer"] == [("d", 2.0)]
    assert by[1, "news"] == [("n", 2.0 + 0.5 + 2 * 0.25)]
    assert by[2, "used_item"] == [("u", 1.0)] and by[2, "dealer"] == [("d", 1.0)] and {q for q, _ in by} == {1, 2, 6}
    assert by[6, "new_item"][0] == ("b", 2.0)
    auto = search.autocomplete(queries, records, posting, catalogue, search.catalogue_postings(catalogue, fields), instance).collect()
    assert {r["doc_id"] for r in auto if r["query_id"] == 1} == {"v"}


def _many_rows(spark, n):
    """A catalogue of n news of two brands and one variant, each fifth row twice; and clauses on all fields of it."""
    docs = [(f"d{i}", "news", ["brand", str(i % 2)], ["cold", "widget"]) for i in range(n) for _ in range(2 if i % 5 == 0 else 1)]
    catalogue = spark.createDataFrame(docs, "doc_id string, doc_type string, brand array<string>, variant array<string>").withColumn("model_status", F.lit(1))
    asked = [(1, "news", "b", "news", "brand", "brand", 2, 0.5), (1, "news", "b", "news", "brand", "1", 2, 0.5), (1, "news", "v", "news", "variant", "e#wid", 1, 1.0), (2, "news", "v", "news", "variant", "cold", 1, 2.0), (3, "news", "x", "news", "variant", "none", 1, 2.0)]
    return catalogue, spark.createDataFrame(asked, "query_id long, section string, clause string, doc_type string, field string, term string, needed int, boost double")


def test_rows_are_not_dealt_by_values(spark):
    catalogue, asked = _many_rows(spark, 20)
    fields = ("brand", "variant")
    got = search.clause_scores(asked, search.catalogue_postings(catalogue, fields), catalogue, fields, ("model_status",))
    assert "hashpartitioning(doc_type" not in _plan(got)
    times = lambda i: 2 if i % 5 == 0 else 1
    want = [(q, f"d{i}", times(i) * (2.0 if q == 2 else 1.0 + i % 2)) for q in (1, 2) for i in range(20)]
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in got.collect()) == sorted(want)
    none = search.clause_scores(asked.where("query_id = 3"), search.catalogue_postings(catalogue, fields), catalogue, fields)
    assert none.count() == 0


def test_ranks_without_a_window_over_a_section(spark):
    catalogue, asked = _many_rows(spark, 40)
    fields = ("brand", "variant")
    scores = stores.written(search.part_ranked(search.dealt_scores(asked, search.catalogue_postings(catalogue, fields), catalogue, fields, ("model_status",)), INSTANCES["default"]), "scores")
    every = search.paged(scores, INSTANCES["default"], count=None)
    assert "Window" not in _plan(every)
    got = {(r["query_id"], r["doc_id"]): r["rank"] for r in every.collect()}
    for q in (1, 2):
        rows = sorted((-r["score"], r["doc_id"]) for r in scores.where(f"query_id = {q}").collect())
        assert len(rows) == 40 and [got[q, d] for _, d in rows] == list(range(1, 41))
    wanted = spark.createDataFrame([(1, "a", 3, 1, None), (2, "b", 1000, 0, None)], "query_id long, query string, count int, page int, section string")
    first = search.first_rows(scores, wanted)
    page = requests.page_of(search.paged(first, INSTANCES["default"], count=None), wanted).collect()
    assert sorted((r["query_id"], r["rank"]) for r in page) == [(1, 4), (1, 5), (1, 6)] + [(2, i) for i in range(1, 41)]
    assert all(got[r["query_id"], r["doc_id"]] == r["rank"] for r in page)
    assert search.paged(scores.where("query_id = 9"), INSTANCES["default"], count=None).count() == 0


def test_words_are_found_before_the_catalogue_joins(spark):
    used = inputs.catalogue(spark, "/root/testdata/sf0.001").where("doc_type = 'used_item'")
    above, _, below = used._jdf.queryExecution().optimizedPlan().toString().partition("Join")
    assert "regexp_extract_all" in below and "regexp_extract_all" not in above
    row = used.orderBy("doc_id").first()
    assert row["brand"][0] == "brand" and row["name"] == [] and row["city"] == [] and row["listing_city"] and row["model_status"] == 0


def test_candidates_do_not_depend_on_layout(spark, entities):
    records = store.build_store(entities)
    queries = spark.createDataFrame([(1, "cold widget old gear"), (2, "ecnomy")], "query_id long, query string")
    want = None
    for n in (1, 5):
        got = search.read_queries(queries.repartition(n), records.repartition(n), store.postings(records).repartition(n), INSTANCES["default"]).select("query_id", "forest_id", F.round("norm_score", 9)).collect()
        want = want or sorted(map(str, got))
        assert sorted(map(str, got)) == want


def test_softmax(spark):
    rows = forests.normalised(spark.createDataFrame([(1, 0, 4.0), (1, 1, 2.0), (2, 0, 0.0)], "query_id long, forest_id int, score double")).collect()
    assert sum(r["norm_score"] for r in rows if r["query_id"] == 1) == pytest.approx(1) and [r["norm_score"] for r in rows if r["query_id"] == 2] == [0]


def test_builders():
    assert scoring.single_field_query({"name": "x"})["boost"] == 1
    assert [f["boost"] for f in scoring.multi_field_query({"query": "x", "fields": ["a", {"field": "b", "boost": 4.0}, "c"]})["fields"]] == [1, 4, 5]
    for bad in ({}, {"a": "x", "b": "y"}, {"a": " "}, {"a": {"query": "x", "colour": 1}}):
        with pytest.raises(ValueError):
            scoring.single_field_query(bad)
    with pytest.raises(ValueError):
        scoring.multi_field_query({"query": "x", "fields": ["a"]})
    with pytest.raises(ValueError):
        scoring.should()


def _suggested(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, class string, weight double")


def test_intents_by_hand(spark):
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "x", "c"]), (3, []), (4, ["a"] * 8), (5, ["x"]), (6, None)], "query_id long, tokens array<string>")
    known = _suggested(spark, ("a", "P", 1.0), ("a", "Q", 1.0), ("b", "P", 2.0), ("a/b", "P", 3.0), ("c", "Q", 1.0))
    found = {(r["query_id"], r["classes"]): r for r in intents.ranked(queries, known, least=0.0).collect()}
    # one group of two: 2 * (3 + (4 * 3 + 3)), as the bigram takes the place of both; apart: 1 + 2
    assert {k: r["score"] for k, r in found.items()} == {(1, "P P"): 36, (1, "Q P"): 3, (2, "P - Q"): 2, (2, "Q - Q"): 2, (5, "-"): 0}
    assert found[2, "P - Q"]["norm_score"] == 0.5 and found[5, "-"]["norm_score"] == 0
    assert {(r["query_id"], r["classes"]) for r in intents.ranked(queries, known).collect()} == {(1, "P P"), (2, "P - Q"), (2, "Q - Q")}


def test_intents_interleaved(spark):
    queries = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "query_id long, tokens array<string>")
    known = _suggested(spark, ("a", "P", 8.0), ("b", "Q", 8.0), ("c", "P", 8.0), ("d", "Q", 8.0))
    (row,) = intents.ranked(queries, known).collect()
    assert row["score"] == 4 + 2 + 2 + 4 and row["norm_score"] == 1
    assert intents.ranked(queries, _suggested(spark)).count() == 0
    assert intents.ranked(queries.limit(0), known).count() == 0


def test_intent_paths(spark):
    member = "struct<tags:array<struct<name:string>>>"
    rows = [(1, 0, [([("p",), ("q",)],), ([],), ([("r",)],)]), (2, 0, [])]
    forests_ = spark.createDataFrame(rows, f"query_id long, forest_id int, members array<{member}>")
    found = sorted((r["query_id"], r["path"], [t and t["name"] for t in r["tags"]]) for r in intents.intent_paths(forests_).collect())
    assert found == [(1, 0, ["p", None, "r"]), (1, 1, ["q", None, "r"]), (2, 0, [])]


def test_main_query(spark):
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, list("abcdefgh")), (4, [])], "query_id long, tokens array<string>")
    postings = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "doc_id long, token string")
    # a|b: document 1 alone matches both runs (2); a+b: document 1 alone (2)
    assert [tuple(r) for r in scoring.main_query(queries, postings).collect()] == [(1, 1, 4.0)]
    # runs of one token each: the one segmentation counts
    assert [tuple(r) for r in scoring.main_query(queries, postings, longest=1).collect()] == [(1, 1, 2.0)]


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_main_query_holds_no_query_in_one_task(spark):
    texts = {d: ["a", "b", "c", "x"][d % 3 : d % 3 + 2] for d in range(40)}
    queries = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, ["c", "x"]), (None, ["b"])], "query_id long, tokens array<string>")
    postings = spark.createDataFrame([(d, t) for d, ts in texts.items() for t in ts], "doc_id long, token string")
    got = scoring.main_query(queries, postings)
    assert "Window" not in _plan(got)
    want = {}
    for q, tokens in ((1, "abac"), (2, "cx"), (None, "b")):
        for mask in range(2 ** (len(tokens) - 1)):
            runs, run = [], tokens[0]
            for i, t in enumerate(tokens[1:]):
                runs, run = ([*runs, run], t) if mask >> i & 1 else (runs, run + t)
            runs = [*runs, run]
            if max(map(len, runs)) > 3:
                continue
            found = {d: [len(r) for r in runs if set(r) <= set(ts)] for d, ts in texts.items()}
            most = max(map(len, found.values()))
            for d, f in found.items():
                if f and len(f) == most:
                    want[q, d] = want.get((q, d), 0) + sum(f)
    assert sorted((str(r["query_id"]), r["doc_id"], r["score"]) for r in got.collect()) == sorted((str(q), d, v) for (q, d), v in want.items())


def test_smart_min_match_by_maxima(spark):
    rows = spark.createDataFrame([(None, 1, 1.0), (None, 1, 2.0), (None, 2, 5.0), (7, 3, 1.0), (7, 4, 2.0)], "query_id long, doc_id long, score double")
    got = scoring.smart_min_match(rows)
    assert "Window" not in _plan(got) and got.columns == ["query_id", "doc_id", "score", "matched"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(None, 1, 3.0, 2), (7, 3, 1.0, 1), (7, 4, 2.0, 1)]))


def test_conjuncts(spark):
    queries = spark.createDataFrame([(1, "a bb 12 cc"), (2, "5"), (3, "1 2 3 4 5 6 7 8 9")], "query_id long, query string")
    rows = retrieval.conjuncts(retrieval.tokenised_queries(queries)).collect()
    assert [" ".join(r["tokens"]) for r in sorted(rows, key=lambda r: (r["query_id"], r["conjunct"])) if r["query_id"] == 1] == ["a bb 12 cc", "a bb", "a bb 12", "bb", "bb 12", "bb 12 cc", "12 cc", "cc"]
    assert {r["query_id"] for r in rows} == {1, 2}


def test_cache_and_tables(spark, entities):
    now = [0.0]
    cache, made = ResultCache(10, clock=lambda: now[0]), []
    for t in (0, 5, 11):
        now[0] = t
        cache.get_or_compute(request_key("i", None, "q"), lambda: made.append(1))
    assert len(made) == 2 and request_key("i", None, "q") == "i:q"
    rows = store.build_store(entities)
    assert not stores.enabled(spark) and stores.create_store(spark, "Shop", rows) and not stores.create_store(spark, "shop", rows)
    assert stores.lookup(spark, "shop", rows.where("key = 'asia'").select("key")).count() == 1
    stores.drop_store(spark, "shop")
    stores.drop_store(spark, "shop")


def test_random_queries_have_a_reading_or_none(spark, entities):
    rng = random.Random(3)
    queries = [(i, " ".join("".join(rng.choice("coldwigetgrnasi") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 8)))) for i in range(20)]
    records = store.build_store(entities)
    got = search.read_queries(spark.createDataFrame(queries, "query_id long, query string"), records, store.postings(records), INSTANCES["default"])
    assert got.where("norm_score is null or size(members) = 0").count() == 0


def test_requests(spark):
    bodies = [
        json.dumps(requests.request(" cold widget ", count=3, section="news")), '{"text": "a", "q": " b "}', '{"query": "a", "sort": "x"}', '{"query": "a", "instance": "other"}',
        '{"query": "a", "c": "-1"}', "[1]", None, '{"query": "a", "colour": "red"}', "{}",
    ]
    got = requests.parsed(spark.createDataFrame(list(enumerate(bodies)), "id int, body string")).orderBy("id").collect()
    assert [(r["query"], r["count"], r["page"], r["section"]) for r in got[:2]] == [("cold widget", 3, 0, "news"), ("b", 10, 0, None)]
    assert [r["error"] for r in got] == [None, None, "sort and filter are not offered", "unknown instance", "not a number", "not an object", "not an object", "unknown field", None]
    with pytest.raises(ValueError):
        requests.request("a", colour="red")


def test_responses(spark):
    asked = spark.createDataFrame([(1, "a", 2, 0, None), (2, "b", 1, 1, None), (3, "c", 5, 0, "news")], "query_id long, query string, count int, page int, section string")
    ranked = spark.createDataFrame([(q, s, r, "t", f"d{r}", 1.0) for q in (1, 2) for s in ("news", "new_item") for r in (1, 2, 3)], "query_id long, section string, rank int, doc_type string, doc_id string, score double")
    totals = ranked.groupBy("query_id", "section").agg(F.count(F.lit(1)).alias("total_results"))
    got = {r["query_id"]: r for r in requests.responses(asked, requests.page_of(ranked, asked), totals, INSTANCES["default"]).collect()}
    assert [(got[q]["count"], got[q]["total_results"]) for q in (1, 2, 3)] == [(4, 6), (2, 6), (0, 0)]
    assert [s["name"] for s in got[1]["results"]] == ["new_item", "news"] and got[3]["results"] is None
    assert [x["doc_id"] for x in got[2]["results"][0]["results"]] == ["d2"]
