"""The token store: entity rows become token records, records are merged by key, and encodings become postings.

Input rows: type (`intent`, `keyword`, `stopWord`; others are ignored), name, value,
normalised_value, ancestors map<string, array<string>>. A tag keeps its ancestors when it joins an existing record, lists are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EDGE_GRAM_WEIGHT
from ..functions.analysis import is_number, words
from ..functions.encoding import gram_encodings, proper_prefixes

ANCESTORS = "map<string,array<string>>"


def ancestors_of(columns: dict[str, Column]) -> Column:
    """The ancestors map of columns named `ancestors.<field>`: exactly two parts, the second not `keyword`; distinct values in their order, fields without values left out."""
    fields = {k.split(".")[1]: v for k, v in columns.items() if k.count(".") == 1 and k.startswith("ancestors.") and not k.endswith(".keyword")}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.array_distinct(F.filter(v, lambda x: x.isNotNull())).alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def emit_tokens(entities: DataFrame) -> DataFrame:
    """Token records: key, tokens, tag_type, name, normalised_value, ref_tag_type, ancestors."""
    kind = F.when(F.col("type") == "intent", "Intent").when(F.col("type") == "keyword", "Keyword").when(F.col("type") == "stopWord", "StopWord")
    rows = entities.select(kind.alias("tag_type"), "name", words(F.col("value")).alias("all"), "normalised_value", "ancestors").where("tag_type is not null and size(all) > 0")
    n = F.size("all")
    invalid = lambda t: is_number(t) | (F.length(t) < 2)
    none = F.array().cast("array<array<string>>")
    singles = F.transform(F.filter("all", lambda t: ~invalid(t)), lambda t: F.array(t))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.slice("all", i, 2)), lambda p: F.exists(p, lambda t: ~invalid(t)))
    grams = F.when((F.col("tag_type") == "Intent") & (n > 1), F.concat(singles, F.when(n > 2, pairs).otherwise(none))).otherwise(none)
    record = lambda tokens, gram: F.struct(tokens.alias("tokens"), F.lit(gram).alias("gram"))
    records = F.concat(F.array(record(F.col("all"), False)), F.transform(grams, lambda g: record(g, True)))
    out = rows.withColumn("record", F.explode(records))
    gram = F.col("record.gram")
    return out.select(
        F.array_join("record.tokens", "/").alias("key"),
        F.col("record.tokens").alias("tokens"),
        F.when(gram, "NGram").otherwise(F.col("tag_type")).alias("tag_type"),
        "name",
        F.when(F.col("tag_type") == "Keyword", F.col("normalised_value")).alias("normalised_value"),
        F.when(gram, F.col("tag_type")).alias("ref_tag_type"),
        F.when(F.col("tag_type") == "Intent", F.col("ancestors")).alias("ancestors"),
    )


def merge_ancestors(emitted: DataFrame) -> DataFrame:
    """(key, tag_type, name, field, values): sorted distinct ancestors of each tag."""
    each = emitted.select("key", "tag_type", "name", F.explode("ancestors").alias("field", "list")).select("key", "tag_type", "name", "field", F.explode("list").alias("value"))
    return each.groupBy("key", "tag_type", "name", "field").agg(F.sort_array(F.collect_set("value")).alias("values"))


def merge_tags(emitted: DataFrame) -> DataFrame:
    """One row for each record's tag: counts added, ancestors joined; of a keyword's normalised values the first in order stays."""
    tags = emitted.groupBy("key", "tag_type", "name").agg(F.count(F.lit(1)).alias("total_count"), F.min("normalised_value").alias("normalised_value"), F.min("ref_tag_type").alias("ref_tag_type"))
    lists = merge_ancestors(emitted).groupBy("key", "tag_type", "name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "values")))).alias("ancestors"))
    return tags.join(lists, ["key", "tag_type", "name"], "left")


def store_of_tags(tags: DataFrame) -> DataFrame:
    tag = F.struct("tag_type", "name", "total_count", "normalised_value", "ref_tag_type", F.map_entries("ancestors").alias("entries"))
    rows = tags.groupBy("key").agg(F.sum("total_count").alias("total_count"), F.array_sort(F.collect_set("name")).alias("scopes"), F.sort_array(F.collect_list(tag)).alias("tags"))
    plain = F.transform("tags", lambda t: F.struct(t["tag_type"].alias("tag_type"), t["name"].alias("name"), t["total_count"].alias("total_count"), t["normalised_value"].alias("normalised_value"), t["ref_tag_type"].alias("ref_tag_type"), F.map_from_entries(t["entries"]).alias("ancestors")))
    tokens = F.split("key", "/")
    return rows.select("key", tokens.alias("tokens"), F.size(tokens).cast("long").alias("token_count"), "total_count", "scopes", plain.alias("tags"))


def build_store(entities: DataFrame) -> DataFrame:
    """key, tokens, token_count, total_count, scopes, tags."""
    return store_of_tags(merge_tags(emit_tokens(entities)))


def merge_stores(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of merge_tags as one: the lookup of existing records before new ones are added."""
    both = existing.unionByName(new)
    keys = ["key", "tag_type", "name"]
    each = both.select(*keys, F.explode("ancestors").alias("field", "list")).select(*keys, "field", F.explode("list").alias("value"))
    lists = each.groupBy(*keys, "field").agg(F.sort_array(F.collect_set("value")).alias("values")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "values")))).alias("ancestors"))
    tags = both.groupBy(*keys).agg(F.sum("total_count").alias("total_count"), F.min("normalised_value").alias("normalised_value"), F.min("ref_tag_type").alias("ref_tag_type"))
    return tags.join(lists, keys, "left")


def encodings(store: DataFrame) -> DataFrame:
    """(key, enc_idx, token, token_type, weight): each token in full, its proper prefixes, and all tokens joined."""
    one = lambda t, kind, w: F.struct(t.alias("token"), F.lit(kind).alias("token_type"), F.lit(w).alias("weight"))
    each = F.flatten(F.transform("tokens", lambda t: F.concat(F.array(one(t, "Full", 1.0)), F.transform(proper_prefixes(t), lambda p: one(p, "EdgeGram", EDGE_GRAM_WEIGHT)))))
    none = F.array().cast("array<struct<token:string,token_type:string,weight:double>>")
    joined = F.when(F.size("tokens") > 1, F.array(one(F.array_join("tokens", ""), "Joined", 1.0))).otherwise(none)
    return store.select("key", F.posexplode(F.concat(each, joined)).alias("enc_idx", "e")).select("key", "enc_idx", "e.token", "e.token_type", "e.weight")


def postings(store: DataFrame, phonetic: DataFrame | None = None) -> DataFrame:
    """(key, enc_idx, kind, value, weight). phonetic: more encodings (token, kind, value) of the vocabulary, as functions.phonetics makes them."""
    entries = encodings(store)
    token = F.array(F.struct(F.lit("token").alias("kind"), F.col("token").alias("value")))
    out = entries.select("key", "enc_idx", "weight", F.explode(F.concat(token, gram_encodings(F.col("token")))).alias("p")).select("key", "enc_idx", "p.kind", "p.value", "weight")
    if phonetic is not None:
        out = out.unionByName(entries.join(phonetic, "token").select("key", "enc_idx", "kind", "value", "weight"))
    return out
