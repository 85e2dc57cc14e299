"""Edit distances and the fuzzy subsequence score."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, changes, and swaps of neighbours that aren't edited again."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + (x != y))
            new.append(cost)
        before, row = row, new
    return row[-1]


def fuzzy(term: str, query: str) -> int:
    """One point for each character of query found in order in term, two more if it follows the one found before; case and j/z don't matter."""
    same = str.maketrans("j", "z")
    term, query = term.lower().translate(same), query.lower().translate(same)
    score, at, last = 0, 0, None
    for c in query:
        found = term.find(c, at)
        if found < 0:
            break
        score += 1 + 2 * (last is not None and found == last + 1)
        last, at = found, found + 1
    return score


@F.pandas_udf(T.IntegerType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], int] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if None in pair:
            out.append(None)
        else:
            if pair not in memo:
                memo[pair] = osa(*pair)
            out.append(memo[pair])
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(T.IntegerType())
def fuzzy_score(term: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or q is None else fuzzy(t, q) for t, q in zip(term, query, strict=True)], dtype="Int32")


def osa_distance(a: Column, b: Column) -> Column:
    """The distance is Levenshtein's where that is 0 or 1; only the other pairs leave the JVM."""
    near = F.levenshtein(a, b)
    return F.when(near <= 1, near).otherwise(_osa(F.when(near > 1, a), F.when(near > 1, b)))


def percent_distance(distance: Column, a: Column, b: Column) -> Column:
    """200 times the distance over both lengths, halves rounded up."""
    return F.floor(F.lit(200.0) * distance / (F.length(a) + F.length(b)) + 0.5).cast("int")


def percent(a: str, b: str) -> int:
    return math.floor(200.0 * osa(a, b) / (len(a) + len(b)) + 0.5)
