"""Sectioned search: the best reading of a query against a typed catalogue.

Catalogue rows: doc_id, doc_type, and one array of tokens for each field. Postings are of the distinct values
of a field, not of the rows: they hold each token of a value and its marked prefixes, so exact and prefix
conditions are the same equi-join. A clause meets the postings of its rarest term alone, the values found are held
against its other terms, and the rows of the types that are asked for join the matching values last: field by field,
so that a row's score is found where the row is, and rows are never dealt by values or by queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..config import Instance
from ..functions.analysis import EDGE, edge_grams, words
from ..sources.stores import written
from . import forests as _forests
from . import retrieval
from .matching import EDGE as EDGE_CODE
from .matching import EDGE_PHONETIC


#: Rows of the catalogue for each part that scores are dealt over.
PART_ROWS = 1 << 20


def _values(catalogue: DataFrame, fields: tuple[str, ...], *more: str) -> DataFrame:
    """(doc_type, field, value, more) of the rows' fields that have tokens; a value is its tokens, joined by spaces."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.array_join(F.col(f), " ").alias("value")) for f in fields])).alias("f")
    return catalogue.select("doc_type", *more, each).select("doc_type", "f.field", "f.value", *more).where("value <> ''")


def catalogue_postings(catalogue: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(doc_type, field, term, value) of the distinct values."""
    tokens = F.split("value", " ")
    return _values(catalogue, fields).distinct().select("doc_type", "field", F.explode(F.array_distinct(F.concat(tokens, edge_grams(tokens)))).alias("term"), "value")


def match_terms(matches: Column) -> Column:
    """The terms that a member's matches ask for: the matched token, marked for prefix matches."""
    return F.transform(matches, lambda m: F.when(m["code"].isin(EDGE_CODE, EDGE_PHONETIC), F.concat(F.lit(EDGE), m["matched"])).otherwise(m["matched"]))


def is_intent(tags: Column, names: tuple[str, ...], grams: bool = True) -> Column:
    kind = lambda t: (t["tag_type"] == "Intent") | (F.lit(grams) & (t["tag_type"] == "NGram") & (t["ref_tag_type"] == "Intent"))
    return F.exists(tags, lambda t: kind(t) & t["name"].isin(*names))


def entity_level(tags: Column, instance: Instance) -> Column:
    """Level of a member: the highest in the hierarchy that its tags name; null if none."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(instance.levels))):
        out = F.when(is_intent(tags, (instance.levels[i],)), i).otherwise(out)
    return out


def page_type(tags: Column, instance: Instance) -> Column:
    found = F.filter(tags, lambda t: (t["tag_type"] == "Keyword") & (t["name"] == instance.page_keyword))
    return F.lower(F.try_element_at(F.transform(found, lambda t: t["normalised_value"]), F.lit(1)))


def ancestors(tags: Column, level: str, of: tuple[str, ...]) -> Column:
    """Names at `level` above the tags of the levels in `of`; an intent of `level` itself has none, an n-gram of it may."""
    kind = lambda t: ((t["tag_type"] == "Intent") & (t["name"] != level)) | ((t["tag_type"] == "NGram") & (t["ref_tag_type"] == "Intent"))
    own = F.filter(tags, lambda t: kind(t) & t["name"].isin(*of))
    lists = F.transform(own, lambda t: F.coalesce(F.try_element_at(t["ancestors"], F.lit(level)), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(lists))


def readings(best: DataFrame, instance: Instance) -> DataFrame:
    """(query_id, route, level, page_type, member, terms, tags) of each member of the best forests that takes part: of the hierarchy if there is one, else places."""
    rows = best.select("query_id", F.posexplode("members").alias("member", "m")).select("query_id", "member", match_terms(F.col("m.matches")).alias("terms"), F.col("m.tags").alias("tags"))
    rows = rows.withColumn("own_level", entity_level(F.col("tags"), instance)).withColumn("place", is_intent(F.col("tags"), (instance.place,))).withColumn("page", page_type(F.col("tags"), instance))
    query = Window.partitionBy("query_id")
    rows = rows.withColumn("level", F.max("own_level").over(query)).withColumn("page_type", F.first("page", ignorenulls=True).over(query.orderBy("member").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    route = F.when(F.col("level").isNotNull(), "name").when(F.max("place").over(query), "place")
    rows = rows.withColumn("route", route)
    return rows.where("(route = 'name' and own_level is not null) or (route = 'place' and place)").drop("own_level", "place", "page")


def clauses(reads: DataFrame, instance: Instance) -> DataFrame:
    """(query_id, section, clause, doc_type, field, term, needed, boost): what each section asks for.

    A clause matches a document of its type that has all its needed terms; its score is their number by the boost.
    """
    top, mid, low = instance.levels
    names = {s.name: s for s in instance.sections}
    new, used, news, dealer = list(names)
    none = F.array().cast("array<string>")

    def asked(where: Column, section: str, types: Column, field: str | Column, terms: Column, boost: float, tag: str) -> DataFrame:
        f = F.lit(field) if isinstance(field, str) else field
        return reads.where(where).select("query_id", F.lit(section).alias("section"), F.concat_ws("-", F.lit(tag), "member").alias("clause"), F.explode(types).alias("doc_type"), f.alias("field"), terms.alias("terms"), F.lit(boost).alias("boost"))

    def above(where: Column, section: str, types: Column, level: str, of: tuple[str, ...], boost: float) -> DataFrame:
        """The names above the query's members, each once and each all its words."""
        each = reads.where(where).select("query_id", F.explode(ancestors(F.col("tags"), level, of)).alias("name")).distinct()
        return each.select("query_id", F.lit(section).alias("section"), F.concat_ws("-", F.lit(level), "name").alias("clause"), F.explode(types).alias("doc_type"), F.lit(level).alias("field"), words(F.col("name")).alias("terms"), F.lit(boost).alias("boost"))

    named, placed, level = F.col("route") == "name", F.col("route") == "place", F.col("level")
    array = lambda names: F.array(*[F.lit(n) for n in names])
    types = none
    for i in range(len(instance.levels)):
        plain, paged = array(instance.level_types(i, False)), array(instance.level_types(i, True))
        types = F.when(level == i, F.when(F.col("page_type").isNotNull(), paged).otherwise(plain)).otherwise(types)
    page_field = F.lit("name")
    own = asked(named, new, types, top, F.col("terms"), 1.0, "own")
    # a catalogue type is searched in the field of its own level, pages by their name
    field = F.col("doc_type")
    by_type = F.create_map(*[x for n in instance.levels for x in (F.lit(f"new_{n}"), F.lit(n))])
    own = own.withColumn("field", F.coalesce(F.try_element_at(by_type, field), page_field))
    parts = [
        own,
        asked(named, used, array(names[used].types), low, F.col("terms"), 1.0, "own"),
        asked(named & (level == 2), news, array(names[news].types), low, F.col("terms"), 1.0, "own"),
        above(named & (level == 2), news, array(names[news].types), mid, (mid, low), 0.5),
        above(named & (level == 2), news, array(names[news].types), top, (top, mid, low), 0.25),
        asked(named & (level == 1), news, array(names[news].types), mid, F.col("terms"), 1.0, "own"),
        above(named & (level == 1), news, array(names[news].types), top, (top, mid, low), 0.5),
        asked(named & (level == 0), news, array(names[news].types), top, F.col("terms"), 1.0, "own"),
        asked(named & (level == 0), dealer, array(names[dealer].types), top, F.col("terms"), 1.0, "own"),
        above(named & (level > 0), dealer, array(names[dealer].types), top, (top, mid, low), 1.0),
        asked(placed, used, array(names[used].types), "listing_" + instance.place, F.col("terms"), 1.0, "own"),
        asked(placed, dealer, array(names[dealer].types), instance.place, F.col("terms"), 1.0, "own"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("terms", F.array_distinct("terms"))
    return rows.select("query_id", "section", "clause", "doc_type", "field", F.explode("terms").alias("term"), F.size("terms").alias("needed"), "boost")


def _holds(tokens: Column, term: Column) -> Column:
    """Whether a term, or a marked prefix, is among the terms of tokens."""
    prefix = F.substring(term, F.lit(len(EDGE) + 1), F.length(term))
    return F.when(F.startswith(term, F.lit(EDGE)), F.exists(tokens, lambda t: F.startswith(t, prefix) & (F.length(t) > F.length(prefix)))).otherwise(F.array_contains(tokens, term))


def clause_values(asked: DataFrame, posting: DataFrame) -> DataFrame:
    """(query_id, section, doc_type, field, value, score): the clauses that each value of a field matches, summed by section."""
    place = ["doc_type", "field", "term"]
    found = asked.select(*place).distinct().join(posting, place).groupBy(*place).agg(F.count(F.lit(1)).alias("values"))
    known = asked.join(found, place).groupBy("query_id", "section", "clause", "doc_type", "field").agg(
        F.min(F.struct("values", "term")).alias("rarest"), F.collect_set("term").alias("terms"), F.first("needed").alias("needed"), F.first("boost").alias("boost")
    )
    known = written(known.where(F.size("terms") == F.col("needed")).withColumn("term", F.col("rarest.term")), "known-clauses")
    hits = known.join(posting, place).where(F.forall("terms", lambda t: _holds(F.split("value", " "), t)))
    return hits.groupBy("query_id", "section", "doc_type", "field", "value").agg(F.sum(F.col("needed") * F.col("boost")).alias("score"))


def dealt_scores(asked: DataFrame, posting: DataFrame, catalogue: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """clause_scores with `part`, a hash of doc_id: the rows are dealt by it, over more parts the more rows the catalogue has."""
    values = written(clause_values(asked, posting), "values")
    askers = written(values.select("query_id", "section").distinct().withColumn("asker", F.monotonically_increasing_id()), "askers")
    same = [values["section"] == askers["section"], values["query_id"].eqNullSafe(askers["query_id"])]
    entry = F.struct("asker", "score")
    sides = values.join(askers, same).groupBy("doc_type", "field", "value").agg(F.map_from_entries(F.collect_list(entry)).alias("scores"))
    sides = written(sides, "sides")  # its size is known when it meets the catalogue
    types = {}
    for r in sides.select("field", "doc_type").distinct().collect():  # those of the instance at most
        types.setdefault(r["field"], []).append(r["doc_type"])
    rows = catalogue.where(F.col("doc_type").isin(sorted({t for ts in types.values() for t in ts})))
    total = F.lit(None).cast("map<bigint,double>")
    for field in (f for f in fields if f in types):
        side = sides.where(F.col("field") == field).select(F.col("doc_type").alias("type__"), F.col("value").alias("value__"), F.col("scores").alias(f"{field}__"))
        value = F.when(F.col("doc_type").isin(types[field]), F.array_join(F.col(field), " "))
        rows = rows.join(side, (F.col("doc_type") == F.col("type__")) & (value == F.col("value__")), "left").drop("type__", "value__")
        own, before = F.col(f"{field}__"), total
        both = F.map_zip_with(own, before, lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
        total = F.when(own.isNull(), before).when(before.isNull(), own).otherwise(both)
    spark = catalogue.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), catalogue.count() // PART_ROWS + 1)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")
    scores = rows.select("doc_type", "doc_id", *keep, part, F.explode(total).alias("asker", "score")).repartition(parts, "part")
    scores = scores.groupBy("part", "asker", "doc_type", "doc_id").agg(F.sum("score").alias("score"), *[F.first(c).alias(c) for c in keep])
    return scores.join(askers, "asker").select("query_id", "section", "doc_id", "doc_type", "score", *keep, "part")


def clause_scores(asked: DataFrame, posting: DataFrame, catalogue: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, section, doc_id, doc_type, score, keep): scores of the clauses that match, summed; keep: further columns of the catalogue."""
    return dealt_scores(asked, posting, catalogue, fields, keep).drop("part")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `place`, their number from 1 in a total order: range partitions are sorted and written, and the sizes of those before are added."""
    kept = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at__", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at__", 33)
    sizes = kept.groupBy(part.alias("part__")).agg(F.count(F.lit(1)).alias("n__"))  # a row for each partition
    before = sizes.select("part__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    out = kept.join(F.broadcast(before), part == F.col("part__"))
    return out.select(*rows.columns, (F.col("before__") + F.col("at__").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


def type_rank(doc_type: Column, instance: Instance) -> Column:
    """Pages first, then the levels from the top, then all others."""
    out = F.lit(3)
    for i, name in reversed(list(enumerate(instance.levels))):
        out = F.when(doc_type == f"new_{name}", i + 1).otherwise(out)
    return F.when(doc_type.endswith("_page"), 0).otherwise(out)


def result_order(instance: Instance, status: str = "model_status") -> list[Column]:
    """Order of the results of a section."""
    first = F.col("section") == instance.sections[0].name
    return [F.col("score").desc(), F.when(first, type_rank(F.col("doc_type"), instance)).otherwise(0), F.when(first, F.col(status)), F.col("doc_type"), F.col("doc_id")]


def paged(scores: DataFrame, instance: Instance, count: int | None = config.PAGE_SIZE, page: int = 0, status: str = "model_status") -> DataFrame:
    """Rank within each section of a query, cut to the page; without a count all are ranked, in range partitions."""
    order = result_order(instance, status)
    if count is not None:
        ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "section").orderBy(*order)))
        return ranked.where(F.col("rank").between(page * count + 1, (page + 1) * count))
    rows = written(numbered(scores, "query_id", "section", *order), "placed")
    firsts = written(rows.groupBy(F.col("query_id").alias("query__"), F.col("section").alias("section__")).agg(F.min("place").alias("first__")), "firsts")
    same = F.col("query_id").eqNullSafe(F.col("query__")) & (F.col("section") == F.col("section__"))
    return rows.join(firsts, same).select(*scores.columns, (F.col("place") - F.col("first__") + 1).cast("int").alias("rank"))


def part_ranked(dealt: DataFrame, instance: Instance, status: str = "model_status") -> DataFrame:
    """Dealt scores (with `part`) and `part_rank`, the rank within the part: a row that is among the first n of its section has a part_rank of n at most."""
    own = Window.partitionBy("part", "query_id", "section").orderBy(*result_order(instance, status))
    return dealt.withColumn("part_rank", F.row_number().over(own))


def first_rows(ranked: DataFrame, asked: DataFrame) -> DataFrame:
    """Of rows with part_rank those that can be on the page, or before it, that their query's request (query_id, count, page) asks for."""
    last = asked.select("query_id", ((F.col("page").cast("long") + 1) * F.col("count")).alias("last__")).groupBy("query_id").agg(F.max("last__").alias("last__"))
    return ranked.join(last, "query_id").where("part_rank <= last__").select(*ranked.columns)


def with_totals(scores: DataFrame) -> DataFrame:
    """(query_id, section, total_results) of all sections that have results."""
    return scores.groupBy("query_id", "section").agg(F.count(F.lit(1)).alias("total_results"))


def read_queries(queries: DataFrame, store: DataFrame, posting: DataFrame, instance: Instance, phonetic: DataFrame | None = None) -> DataFrame:
    """All readings of each query, with norm_score."""
    spans = retrieval.conjuncts(retrieval.tokenised_queries(queries))
    scores = retrieval.candidate_scores(retrieval.clauses(spans), posting, phonetic)
    return _forests.normalised(_forests.tag_forests(retrieval.top_candidates(scores, store), spans, instance))


def search(queries: DataFrame, store: DataFrame, posting: DataFrame, catalogue: DataFrame, catalogue_posting: DataFrame, instance: Instance, count: int = config.PAGE_SIZE, page: int = 0, section: str | None = None, phonetic: DataFrame | None = None) -> DataFrame:
    """Results of each query by section: query_id, section, title, rank, doc_type, doc_id, score. Queries without a reading have none."""
    best = _forests.best_forests(read_queries(queries, store, posting, instance, phonetic))
    reads = written(readings(best, instance), "readings")  # read once for each kind of clause
    asked = clauses(reads, instance)
    asked = written(asked.where(F.col("section") == section) if section else asked, "asked")
    fields = tuple(c for c, kind in catalogue.dtypes if kind == "array<string>")
    scores = clause_scores(asked, catalogue_posting, catalogue, fields, ("model_status",))
    titles = F.create_map(*[x for s in instance.sections for x in (F.lit(s.name), F.lit(s.title))])
    return paged(scores, instance, count, page).select("query_id", "section", F.element_at(titles, F.col("section")).alias("title"), "rank", "doc_type", "doc_id", "score")


def autocomplete(queries: DataFrame, store: DataFrame, posting: DataFrame, catalogue: DataFrame, catalogue_posting: DataFrame, instance: Instance, count: int = config.PAGE_SIZE, page: int = 0, phonetic: DataFrame | None = None) -> DataFrame:
    """The first section of name searches, without pages."""
    plain = ~F.col("doc_type").endswith("_page")
    out = search(queries, store, posting, catalogue.where(plain), catalogue_posting.where(plain), instance, count, page, instance.sections[0].name, phonetic)
    return out.drop("section", "title")


def autocomplete_projection(hits: DataFrame, instance: Instance) -> DataFrame:
    """(doc_type, doc_id, name, key, url): the fields of the row's own level under common names; top-level rows use the name as key."""
    pick = lambda suffix: F.coalesce(*[F.when(F.col("doc_type") == f"new_{n}", F.col(f"{n}{suffix}")) for n in instance.levels])
    key = F.when(F.col("doc_type") == f"new_{instance.levels[0]}", pick("")).otherwise(pick("_key"))
    return hits.select("doc_type", "doc_id", pick("").alias("name"), key.alias("key"), pick("_url").alias("url"))
