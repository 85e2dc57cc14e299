"""Encodings of tokens: n-gram sets, prefixes and refined Soundex as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import is_number

_NONE = "array<string>"
#: The digit of each letter A to Z.
SOUNDEX_DIGITS = "01360240043788015936020505"


def longest_gram(token: Column) -> Column:
    n = F.length(token)
    return F.when(n > 5, 4).when(n == 5, 3).otherwise(2)


def encodable(token: Column, stop_word: bool = False) -> Column:
    """Short tokens, stop words and numbers have no encodings."""
    return F.lit(not stop_word) & (F.length(token) > 2) & ~is_number(token)


def all_grams(token: Column) -> Column:
    """The token and its substrings of the sizes that its length allows."""
    n = F.length(token)
    low = F.when(n >= 5, 2).otherwise(1)
    of_size = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(token, i, k))
    return F.array_distinct(F.concat(F.array(token), F.flatten(F.transform(F.sequence(low, F.least(longest_gram(token), n)), of_size))))


def start_grams(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.least(longest_gram(token), F.length(token))), lambda k: F.substring(token, F.lit(1), k))


def end_grams(token: Column) -> Column:
    n = F.length(token)
    return F.transform(F.sequence(F.lit(1), F.least(longest_gram(token), n)), lambda k: F.substring(token, n - k + 1, k))


def proper_prefixes(token: Column, low: int = 1, high: int = 20) -> Column:
    """Prefixes of low to high characters without the token itself."""
    last = F.least(F.length(token) - 1, F.lit(high))
    return F.when(last >= low, F.transform(F.sequence(F.lit(low), F.greatest(last, F.lit(low))), lambda k: F.substring(token, F.lit(1), k))).otherwise(F.array().cast(_NONE))


def refined_soundex(token: Column) -> Column:
    """First letter and the digits of all letters, runs once; null for tokens without a Latin letter or of fewer than three characters."""
    letters = F.upper(F.regexp_replace(token, "[^A-Za-z]", ""))
    digits = F.regexp_replace(F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", SOUNDEX_DIGITS), r"(.)\1+", "$1")
    return F.when((F.length(letters) > 0) & (F.length(token) > 2), F.concat(F.substring(letters, 1, 1), digits))


def gram_encodings(token: Column) -> Column:
    """Rows (kind, value) of the encodings that expressions give, as an array of structs; phonetic kinds but rs come from `phonetics`."""

    def kind(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))

    sound = refined_soundex(token)
    none = F.array().cast("array<struct<kind:string,value:string>>")
    found = F.concat(kind("ng", all_grams(token)), kind("ng_s", start_grams(token)), kind("ng_e", end_grams(token)), F.when(sound.isNotNull() & (sound != token), kind("rs", F.array(sound))).otherwise(none))
    return F.when(encodable(token), found).otherwise(none)
