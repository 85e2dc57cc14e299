"""Requests in, responses out: fields with their aliases and defaults, paging by request, and the envelope of counts, totals and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..config import INSTANCES, Instance

#: The fields of a request and their short forms.
ALIASES = {
    "instance": ("instance",), "query": ("query", "q", "text"), "count": ("count", "c"), "page": ("page", "p"), "type": ("type", "t"),
    "section": ("section", "s"), "sort": ("sort", "o"), "filter": ("filter", "f"), "format": ("format",),
}
DEFAULT_PAGE = 0


def request(query: str, instance: str = "default", count: int = config.PAGE_SIZE, page: int = DEFAULT_PAGE, **more: str) -> dict[str, str]:
    """A request's fields by their long names; more: type, section or format."""
    unknown = more.keys() - ALIASES.keys()
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return {"instance": instance, "query": query, "count": str(count), "page": str(page)} | more


def parsed(requests: DataFrame, body: str = "body") -> DataFrame:
    """requests' other columns and the fields of the JSON object in `body`: query, count, page, type, section, format, and error.

    Strings are trimmed; count and page have defaults; where a field comes under several names, the first of ALIASES holds. A request that isn't an object,
    has an unknown field, a count or page that isn't a number, an unknown instance, or asks to sort or filter has an error and no fields.
    """
    given = F.from_json(body, "map<string,string>")
    rows = requests.withColumn("given__", given)
    field = {k: F.trim(F.coalesce(*[F.try_element_at("given__", F.lit(n)) for n in names])) for k, names in ALIASES.items()}
    known = F.array(*[F.lit(n) for names in ALIASES.values() for n in names])
    number = lambda k: field[k].isNull() | field[k].rlike(r"^\d{1,9}$")
    error = (
        F.when(F.col("given__").isNull(), F.lit("not an object"))
        .when(F.size(F.array_except(F.map_keys("given__"), known)) > 0, F.lit("unknown field"))
        .when(field["sort"].isNotNull() | field["filter"].isNotNull(), F.lit("sort and filter are not offered"))
        .when(~number("count") | ~number("page"), F.lit("not a number"))
        .when(~F.coalesce(field["instance"], F.lit("default")).isin(*INSTANCES), F.lit("unknown instance"))
    )
    rows = rows.withColumn("error", error)
    fine = F.col("error").isNull()
    values = {"query": field["query"], "count": F.coalesce(field["count"].cast("int"), F.lit(config.PAGE_SIZE)), "page": F.coalesce(field["page"].cast("int"), F.lit(DEFAULT_PAGE)), "type": field["type"], "section": field["section"], "format": field["format"]}
    keep = [c for c in requests.columns if c != body]
    return rows.select(*keep, *[F.when(fine, v).alias(k) for k, v in values.items()], "error")


def page_of(ranked: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ranked (query_id, section, rank, ...) on the page that each request (query_id, count, page, section) asks for."""
    rows = ranked.join(asked.select("query_id", "count", "page", F.col("section").alias("asked")), "query_id")
    first = F.col("page") * F.col("count")
    return rows.where(F.col("rank").between(first + 1, first + F.col("count")) & (F.col("asked").isNull() | (F.col("asked") == F.col("section")))).select(*ranked.columns)


def with_fields(results: DataFrame, catalogue: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """results with the catalogue's fields: those in include (all, if there are none) that aren't in exclude. Only these columns are read."""
    fields = [c for c in catalogue.columns if c not in ("doc_type", "doc_id") and (not include or c in include) and c not in exclude]
    return results.join(catalogue.select("doc_type", "doc_id", *fields), ["doc_type", "doc_id"], "left")


def responses(asked: DataFrame, page: DataFrame, totals: DataFrame, instance: Instance) -> DataFrame:
    """One row for each request: query_id, search_text, count, total_results, results (sections in the instance's order, each with name, title, total_results, count and results by rank). Requests without results have none of them, and counts of 0."""
    places = F.create_map(*[x for i, s in enumerate(instance.sections) for x in (F.lit(s.name), F.struct(F.lit(i).alias("place"), F.lit(s.title).alias("title")))])
    held = page.groupBy("query_id", "section").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_type", "doc_id", "score"))).alias("results"))  # a page at most
    own = totals.join(held, ["query_id", "section"], "left").withColumn("at", places[F.col("section")])
    results = F.coalesce("results", F.array().cast("array<struct<rank:int,doc_type:string,doc_id:string,score:double>>"))
    section = F.struct(F.col("at.place").alias("place"), F.col("section").alias("name"), F.col("at.title").alias("title"), "total_results", F.size(results).alias("count"), results.alias("results"))
    every = own.groupBy("query_id").agg(F.sort_array(F.collect_list(section)).alias("results"))  # the instance's sections at most
    zero = F.lit(0).cast("long")
    count, total = (F.aggregate(F.transform(F.col("results"), lambda s: s["count"].cast("long")), zero, lambda a, n: a + n), F.aggregate("results", zero, lambda a, s: a + s["total_results"]))
    return asked.select("query_id", F.col("query").alias("search_text")).join(every, "query_id", "left").select("query_id", "search_text", F.coalesce(count, zero).alias("count"), F.coalesce(total, zero).alias("total_results"), "results")


def by_weight(weight: Column, name: Column) -> Column:
    """Place of a tag among those of its key: heavier ones first, then by name."""
    return F.row_number().over(Window.partitionBy("key").orderBy(weight.desc(), name))
