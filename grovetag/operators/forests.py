"""Tag forests: the consistent readings of a query, ranked.

The fold over candidates depends on their order, so all candidates of a query go to one task, in
order of conjunct and rank; there are at most 22 conjuncts of MOST_CANDIDATES each.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Instance
from .matching import MatchSet, best_match, compare

#: Readings of a query; a query that would have more raises an error, nothing is left out silently.
MOST_FORESTS = 20_000


@dataclass
class Member:
    """A match set in a forest: a graph if it matched several tokens, else a node."""

    set: MatchSet
    tags: list = field(default_factory=list)

    def __post_init__(self):
        self.tags = self.tags or list(self.set.tags)
        first = self.set.matches[0]
        self.graph = len(self.set.matches) > 1
        # a node knows its first input token alone, also when that match joined several
        self.inputs = self.set.inputs if self.graph else self.set.inputs[:1]
        self.matched = tuple(m.matched for m in self.set.matches) if self.graph else (first.matched,)
        # what another match set must share to be in conflict with this member
        self.claimed = self.set.inputs if self.graph else (first.input,)

    score = property(lambda self: self.set.score)
    weight = property(lambda self: self.set.weight)
    level = property(lambda self: self.set.level)

    def contains_inputs(self, other: MatchSet) -> bool:
        return set(other.inputs) <= set(self.inputs)

    def contains_matched(self, other: MatchSet) -> bool:
        return {m.matched for m in other.matches} <= set(self.matched)

    def inside_inputs(self, other: MatchSet) -> bool:
        return set(self.inputs) <= set(other.inputs)

    def inside_matched(self, other: MatchSet) -> bool:
        return set(self.matched) <= {m.matched for m in other.matches}

    def meets(self, other: MatchSet) -> bool:
        return bool(set(self.claimed) & set(other.inputs))

    def merge(self, tags: tuple) -> None:
        have = {(t["tag_type"], t["name"]): i for i, t in enumerate(self.tags)}
        for t in tags:
            i = have.get((t["tag_type"], t["name"]))
            if i is None:
                have[t["tag_type"], t["name"]] = len(self.tags)
                self.tags.append(t)


def better_than_members(one: MatchSet, members: list[Member]) -> bool:
    """Whether a match set may take the place of the members that it covers; equal is good enough."""

    @dataclass
    class Whole:
        score: float = math.prod(m.score for m in members)
        weight: float = math.prod(m.weight for m in members)
        level: int = max(m.level for m in members)

    return compare(one, Whole()) <= 0


def fold(candidates: Iterator[MatchSet]) -> list[list[Member]]:
    forests: list[list[Member]] = []
    for one in candidates:
        placed = False
        for forest in forests:
            for i, member in enumerate(forest):
                if member.contains_inputs(one):
                    if member.inside_inputs(one) and member.contains_matched(one) and member.inside_matched(one):
                        member.merge(one.tags)
                    elif not member.contains_matched(one) and compare(member.set, one) > 0:
                        forest[i] = Member(one)
                    placed = True
                    break
            else:
                covered = [m for m in forest if m.inside_inputs(one) and m.inside_matched(one)]
                if covered:
                    placed = True
                    if better_than_members(one, covered):
                        forest[:] = [m for m in forest if m not in covered] + [Member(one)]
            if placed:
                break
        if placed:
            continue
        if not forests:
            forests.append([Member(one)])
            continue
        for forest in list(forests):
            apart = [m for m in forest if not m.meets(one)]
            if len(apart) == len(forest):
                forest.append(Member(one))
            else:
                forests.append([Member(m.set, list(m.tags)) for m in apart] + [Member(one)])
        if len(forests) > MOST_FORESTS:
            raise ValueError(f"a query has more than {MOST_FORESTS} readings")
    return forests


SCHEMA = (
    "query_id long, forest_id int, score double, members array<struct<inputs:array<string>,matches:array<struct<input:string,matched:string,code:int,score:double>>,"
    "code:int,score:double,weight:double,tags:array<struct<tag_type:string,name:string,ref_tag_type:string,normalised_value:string,weight:double,ancestors:map<string,array<string>>>>>>"
)


def _row(query_id, i: int, forest: list[Member]) -> dict:
    members = [
        {
            "inputs": list(m.set.inputs),
            "matches": [{"input": x.input, "matched": x.matched, "code": x.code, "score": float(x.score)} for x in m.set.matches],
            "code": m.set.code,
            "score": float(m.score),
            "weight": float(m.weight),
            "tags": [{"tag_type": t["tag_type"], "name": t["name"], "ref_tag_type": t["ref_tag_type"], "normalised_value": t["normalised_value"], "weight": t["weight"], "ancestors": t["ancestors"]} for t in m.tags],
        }
        for m in forest
    ]
    return {"query_id": query_id, "forest_id": i, "score": sum(m.score for m in forest), "members": members}


def tag_forests(candidates: DataFrame, spans: DataFrame, instance: Instance) -> DataFrame:
    """(query_id, forest_id, score, members) from candidates (query_id, conjunct, rank, key, tags) and the conjuncts' tokens."""
    inputs = spans.select("query_id", "conjunct", F.col("tokens").alias("inputs"))
    rows = candidates.join(inputs, ["query_id", "conjunct"]).select("query_id", "conjunct", "rank", "inputs", F.split("key", "/").alias("results"), F.to_json("tags").alias("tags"))
    weights = dict(instance.tag_weights)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conjunct", "rank"])

        def sets() -> Iterator[MatchSet]:
            for r in pdf.itertuples(index=False):
                tags = [{"ref_tag_type": None, "normalised_value": None, "ancestors": None} | t for t in json.loads(r.tags)]
                if one := best_match(tuple(r.inputs), tuple(r.results), tags, weights):
                    yield one

        out = [_row(int(pdf["query_id"].iloc[0]), i, f) for i, f in enumerate(fold(sets()))]
        return pd.DataFrame(out, columns=["query_id", "forest_id", "score", "members"])

    return rows.groupBy("query_id").applyInPandas(run, SCHEMA)


def normalised(forests: DataFrame) -> DataFrame:
    """With norm_score: exp(10 score / best) over its sum; where the best score is 0, the score itself."""
    own = Window.partitionBy("query_id")
    top = F.max("score").over(own)
    part = F.exp(F.lit(10.0) * F.col("score") / top)
    return forests.withColumn("part", F.when(top > 0, part)).withColumn("norm_score", F.coalesce(F.col("part") / F.sum("part").over(own), "score")).drop("part")


def best_forests(forests: DataFrame) -> DataFrame:
    """The best reading of each query; of equal ones the first found."""
    order = Window.partitionBy("query_id").orderBy(F.col("norm_score").desc(), "forest_id")
    return forests.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
