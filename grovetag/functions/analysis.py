"""Analyzers: from a string column to an array of tokens, in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with the inner punctuation that word segmentation keeps: don't, 1.5, a_b. Ideographs and emoji aren't split one by one.
WORD = r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=\p{L})['’.:·](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*"
EDGE = "e#"


def words(text: Column) -> Column:
    """Lower-case words; also the query analyzer. Null gives null, no words give an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def keyword(text: Column) -> Column:
    """The whole string as one lower-case token."""
    return F.array(F.lower(text))


def edge_grams(tokens: Column, low: int = 1, high: int = 20, prefix: str = EDGE) -> Column:
    """Prefixes of low to high characters, marked unless they are the whole token; shorter tokens pass, and a token of more than high characters has no unmarked form."""

    def grams(token: Column) -> Column:
        n = F.length(token)
        marked = F.transform(F.sequence(F.lit(low), F.least(n, F.lit(high))), lambda i: F.when(i < n, F.concat(F.lit(prefix), F.substring(token, F.lit(1), i))).otherwise(token))
        return F.when(n < low, F.array(token)).otherwise(marked)

    return F.flatten(F.transform(tokens, grams))


def edge_grams_with_source(tokens: Column, low: int = 1, high: int = 20, prefix: str = EDGE) -> Column:
    """edge_grams as structs of the gram and the token that it comes from."""
    return F.flatten(F.transform(tokens, lambda t: F.transform(edge_grams(F.array(t), low, high, prefix), lambda g: F.struct(g.alias("gram"), t.alias("source")))))


def plain_edge_grams(tokens: Column, low: int = 3, high: int = 20) -> Column:
    """Unmarked prefixes of low to high characters; shorter tokens vanish."""

    def grams(token: Column) -> Column:
        n = F.length(token)
        return F.when(n >= low, F.transform(F.sequence(F.lit(low), F.least(n, F.lit(high))), lambda i: F.substring(token, F.lit(1), i))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(tokens, grams))


def prefixed(tokens: Column, prefix: str = EDGE) -> Column:
    """Tokens with a prefix; empty ones are skipped."""
    return F.transform(F.filter(tokens, lambda t: F.length(t) > 0), lambda t: F.concat(F.lit(prefix), t))


def _once(tokens: Column, make: Callable[[Column], Column]) -> Column:
    """make(tokens), with tokens worked out once however often make names them."""
    return F.element_at(F.transform(F.array(tokens), make), 1)


def shingles(tokens: Column, output_unigrams: bool = False) -> Column:
    """Neighbouring pairs without a separator; with output_unigrams after the tokens themselves."""

    def pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        both = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, b))
        return F.concat(t, both) if output_unigrams else both

    return F.when(tokens.isNotNull(), _once(tokens, pairs))


def normalised_query(query: Column) -> Column:
    """Trimmed lower-case text; null where nothing is left."""
    text = F.lower(F.trim(query))
    return F.when(F.length(text) > 0, text)


def is_number(token: Column) -> Column:
    return token.rlike(r"^-?\p{Nd}*\.?\p{Nd}+$")


ANALYZERS = {
    "standard": words,
    "query": words,
    "keyword": keyword,
    "text": lambda c: edge_grams(words(c)),
    "descriptive_text": lambda c: edge_grams(words(c), low=2),
    "edge_query": lambda c: prefixed(words(c)),
    "shingle_text": lambda c: shingles(words(c)),
    "vernacular": lambda c: plain_edge_grams(words(c)),
}


def analyze(text: Column, analyzer: str) -> Column:
    return ANALYZERS[analyzer](text)
