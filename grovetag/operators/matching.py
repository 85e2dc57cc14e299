"""How a candidate's tokens match the tokens of a conjunct."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from ..functions.distance import percent

EXACT, EDGE, PHONETIC, EDGE_PHONETIC = 0, 1, 2, 3


# ---- expressions for the classes that need no distance


def exact_match(tokens: Column, result: Column) -> Column:
    """The first token equal to result."""
    return F.element_at(F.filter(tokens, lambda t: t == result), 1)


def edge_match(tokens: Column, result: Column) -> Column:
    """The first token that result starts with."""
    return F.try_element_at(F.filter(tokens, lambda t: F.startswith(result, t)), F.lit(1))


def edge_score(token: Column, result: Column) -> Column:
    return F.lit(config.EDGE_SCORE) / (F.length(result) - F.length(token) + 1)


def compare_column(one: dict[str, Column], two: dict[str, Column]) -> Column:
    """Negative where `one` is the better match (score, weight, level, results): weights decide scores within the band, then scores, levels and numbers of result tokens."""
    sign = lambda a, b: F.when(a > b, 1).when(a < b, -1).otherwise(0)
    gap = F.abs(two["score"] - one["score"]) * 100.0 / F.greatest(two["score"], one["score"])
    steps = [F.when(gap < config.SAME_SCORE_PERCENT, sign(two["weight"], one["weight"])).otherwise(0), sign(two["score"], one["score"]), sign(one["level"], two["level"]), sign(one["results"], two["results"])]
    out = steps[-1]
    for s in reversed(steps[:-1]):
        out = F.when(s != 0, s).otherwise(out)
    return out


# ---- the same in Python, for the forests


@dataclass(frozen=True)
class Match:
    input: str
    matched: str
    code: int
    score: float

    @property
    def level(self) -> int:
        return min(self.code, 1)


@lru_cache(200_000)
def _percent(a: str, b: str) -> int:
    return percent(a, b)


def phonetic_match(tokens: tuple[str, ...], result: str, edges: bool, threshold: int) -> Match | None:
    """The nearest token within threshold percent; with edges, prefixes of result from three characters stand in, at four fifths of it."""
    best = None
    for token in tokens:
        if edges and 3 <= len(token) < len(result):
            tries = [(result[:i], threshold if i == len(result) else 0.8 * threshold, len(result) - i + 1) for i in range(3, len(result) + 1)]
        else:
            tries = [(result, threshold, 1)]
        for part, most, divisor in tries:
            d = _percent(part, token)
            score = float(np.float32(1 - d / 100) / np.float32(divisor))
            if d <= most and (score <= 0 or best is None or score > best.score):
                best = Match(token, part, EDGE_PHONETIC if len(part) < len(result) else PHONETIC, score)
    return best


@lru_cache(200_000)
def match_token(tokens: tuple[str, ...], result: str, edges: bool, threshold: int) -> Match | None:
    """Exact, then prefix, then by distance with a threshold that widens twice."""
    if result in tokens:
        return Match(result, result, EXACT, config.EXACT_SCORE)
    for t in tokens:
        if result.startswith(t):
            return Match(t, t, EDGE, config.EDGE_SCORE / (len(result) - len(t) + 1))
    for wider in config.WIDER:
        if found := phonetic_match(tokens, result, edges, threshold * wider // 100):
            return found
    return None


@dataclass(frozen=True)
class MatchSet:
    inputs: tuple[str, ...]
    matches: tuple[Match, ...]
    code: int
    score: float
    weight: float
    tags: tuple
    results: int

    @property
    def level(self) -> int:
        return min(self.code, 1)


def inflate(tags: list[dict], weights: dict[str, float], partial: bool) -> tuple:
    """Tags with weights; in a partial match those that aren't n-grams become n-grams of weight 0. By level, then weight."""
    out = []
    for t in tags:
        gram = t["tag_type"] == "NGram"
        if partial and not gram:
            out.append(t | {"tag_type": "NGram", "ref_tag_type": t["tag_type"], "weight": 0.0, "level": 1})
        else:
            out.append(t | {"weight": float(weights.get(t["name"], 0.0)), "level": int(gram)})
    return tuple(sorted(out, key=lambda t: (t["level"], -t["weight"])))


def token_matches(tokens: tuple[str, ...], results: tuple[str, ...]) -> list[Match]:
    """The best match of each result token; of two that share an input or a matched token the better one stays."""
    found: list[Match] = []
    for result in results:
        m = match_token(tokens, result, True, config.TOKEN_THRESHOLD)
        if m is None:
            continue
        i = next((i for i, x in enumerate(found) if x.input == m.input or x.matched == m.matched), None)
        if i is None:
            found.append(m)
        elif (m.level, -m.score) < (found[i].level, -found[i].score):
            del found[i]
            found.append(m)
    return found


def token_wise(tokens: tuple[str, ...], results: tuple[str, ...], tags: list[dict], weights: dict[str, float]) -> MatchSet | None:
    found = token_matches(tokens, results)
    if not found:
        return None
    own = inflate(tags, weights, len(found) < len(results))
    return MatchSet(tuple(m.input for m in found), tuple(found), max(m.code for m in found), math.prod(m.score for m in found), own[0]["weight"] if own else 0.0, own, len(results))


def joined(tokens: tuple[str, ...], results: tuple[str, ...], tags: list[dict], weights: dict[str, float]) -> MatchSet | None:
    """All inputs as one token against all results as one."""
    if len(tokens) < 2 and len(results) < 2:
        return None
    m = match_token(("".join(tokens),), "".join(results), False, config.JOINED_THRESHOLD)
    if m is None:
        return None
    own = inflate(tags, weights, False)
    each = tuple(Match("".join(tokens), r, m.code, m.score) for r in results)
    return MatchSet(tuple(tokens), each, m.code, m.score, own[0]["weight"] if own else 0.0, own, len(results))


def compare(one, two) -> int:
    """Negative: one is better. In 32-bit floats, as scores near the band must fall on the same side everywhere."""
    a, b = np.float32(one.score), np.float32(two.score)
    sign = lambda x, y: int(x > y) - int(x < y)
    gap = abs(b - a) * np.float32(100) / max(a, b) if max(a, b) else np.float32(0)
    out = sign(two.weight, one.weight) if gap < config.SAME_SCORE_PERCENT else 0
    out = out or sign(b, a) or sign(one.level, two.level)
    if not out and isinstance(one, MatchSet) and isinstance(two, MatchSet):
        out = sign(one.results, two.results)
    return out


def best_match(tokens: tuple[str, ...], results: tuple[str, ...], tags: list[dict], weights: dict[str, float]) -> MatchSet | None:
    one, two = token_wise(tokens, results, tags, weights), joined(tokens, results, tags, weights)
    if one is None or two is None:
        return one or two
    return one if compare(one, two) <= 0 else two
