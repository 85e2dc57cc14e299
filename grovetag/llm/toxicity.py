"""Toxicity by a subsequence string kernel, Nystrom landmarks and a linear SVM.

A unit is a token's letters and digits in lower case; tokens of one letter in a row make one unit
more (`i d i o t`). Two units, each between two boundary marks, are compared by their common subsequences of three
characters, each weighing DECAY to the power of the stretch that it spans, up to SPAN
characters, so inserted and missing characters lower the similarity and don't end it.
Kernel values against landmark units, times the inverse root of the landmarks' own kernel
matrix, are the features of the SVM. Kernel and SVM are linear in the subsequences, so the trained
model folds into one weight per subsequence, and a unit is scored without visiting
the landmarks. A document's margin is the largest of its units'; Platt's sigmoid, fitted on
the training documents, makes it a score.

Labels say which documents are toxic, not which words: the words of each toxic document are
instances of a bag. The first witnesses are words that toxic documents hold far
more often than others, then each toxic document's best word (when its margin is positive); witnesses are also trained with
a character put in between.

Cases: null and empty texts have no units and the lowest score; labels that are null are
left out, a doc_id with several labels is toxic if one says so; without toxic (or without
other) training labels each score is 0; repeated rows are scored each; texts are
scored whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, slices, text_or_empty, tidy

#: Labelled documents of each class that the model is fitted on at most.
MOST_LABELLED = 4000
LANDMARKS = 240
#: Units of clean documents that the SVM is trained against, half of them the most frequent ones.
NEGATIVES = 8000
DECAY, SPAN = 0.7, 6
#: Longest unit; a longer token is cut into overlapping pieces of this length, so all of it is read.
LONGEST = 24
BUCKETS = 1 << 20
THRESHOLD = 0.7
REMEMBERED = 200_000
#: Units that are scored at a time.
BLOCK = 20_000
#: Units whose kernel values are worked out at a time.
ROWS = 100
#: Tokens of texts that are held as words at a time.
TOKENS = 200_000

#: (first step, second step) of a subsequence of three characters.
STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]

_not_word = re.compile(r"[\W_]+")


def held_out(column: str = "doc_id", parts: int = 3, out: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == out


def units(token: str) -> list[str]:
    """The units of one token."""
    unit = _not_word.sub("", token.lower())
    if len(unit) <= LONGEST:
        return [unit] if unit else []
    step = LONGEST - 2 * SPAN
    return [unit[i : i + LONGEST] for i in range(0, len(unit) - 2 * SPAN, step)]


def spaced(tokens: list[str]) -> list[str]:
    """Units of tokens of one letter in a row, three at least."""
    out, run = [], ""
    for t in tokens:
        t = _not_word.sub("", t.lower())
        if len(t) == 1:
            run += t
        elif t:
            if len(run) > 2:
                out += units(run)
            run = ""
    if len(run) > 2:
        out += units(run)
    return out


def document_units(text: str) -> set[str]:
    tokens = text.split()
    return {u for t in set(tokens) for u in units(t)} | set(spaced(tokens))


def norm(length: int) -> float:
    return math.sqrt(sum(max(0, length - a - b) * DECAY ** (2 * (a + b + 1)) for a, b in STEPS)) or 1.0


_NORMS = np.array([norm(n + 2) for n in range(LONGEST + 1)])


def occurrences(names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each step pair: the unit's number and the bucket of each subsequence, and its weight."""
    names = [f"^{u}$" for u in names]
    lengths = np.array([len(u) for u in names], np.int64)
    chars = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(names)), lengths)
    if not len(chars):
        return
    left = np.cumsum(lengths)[own] - np.arange(len(chars))  # characters up to the unit's end, itself included
    one, two, three = (chars * np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    for a, b in STEPS:
        i = np.flatnonzero(left > a + b)
        key = one[i] + two[i + a] + three[i + a + b]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield own[i], (key >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1), DECAY ** (a + b + 1)


def features(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units' normalised subsequence vectors as (unit, bucket, value) triples."""
    parts = [(u, k, np.full(len(u), w) / _NORMS[[len(names[x]) for x in u.tolist()]]) for u, k, w in occurrences(names)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    u, k, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    return u, k, v


@dataclass
class Model:
    weights: np.ndarray  # by bucket
    bias: float
    slope: float
    shift: float

    def margins(self, names: list[str]) -> np.ndarray:
        out = np.zeros(len(names))
        for at in range(0, len(names), BLOCK):
            part = names[at : at + BLOCK]
            for u, k, w in occurrences(part):
                out[at : at + BLOCK] += w * np.bincount(u, self.weights[k], len(part))
            out[at : at + BLOCK] /= _NORMS[[len(x) for x in part]]
        return out + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def kernel(names: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of units against landmarks."""
    lu, lk, lv = features(landmarks)
    used, place = np.unique(lk, return_inverse=True)
    table = np.zeros((len(used) + 1, len(landmarks)))
    np.add.at(table, (place, lu), lv)
    out = np.zeros((len(names), len(landmarks)))
    for at in range(0, len(names), ROWS):
        u, k, v = features(names[at : at + ROWS])
        i = np.searchsorted(used, k)
        hit = used[np.minimum(i, len(used) - 1)] == k
        part = out[at : at + ROWS]
        order = np.argsort(u[hit], kind="stable")
        rows, cells = u[hit][order], table[i[hit][order]] * v[hit][order][:, None]
        if len(rows):
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            part[rows[starts]] = np.add.reduceat(cells, starts, 0)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps on the rows within the margin. y: -1 or 1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        a, c = x1[active], cost * weight[active][:, None]
        new = np.linalg.solve((a * c).T @ a + np.diag(ridge), (a * c).T @ y[active])
        done = np.allclose(new, w, atol=1e-6)
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, toxic: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the sigmoid, with Platt's softened targets."""
    n1 = toxic.sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (len(toxic) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * margin).sum(), g.sum()])
        hess = np.array([[(h * margin**2).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1, 5 / np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def with_insertion(names: list[str], rng: np.random.Generator) -> list[str]:
    out = []
    for u in names:
        if len(u) > 3:
            i = int(rng.integers(1, len(u)))
            out.append((u[:i] + "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(36))] + u[i:])[:LONGEST])
    return out


@dataclass
class Bags:
    """Labelled documents: whether each is toxic, and the numbers of its distinct units (document i has ids[starts[i]:starts[i + 1]])."""

    toxic: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    names: list[str]

    def held_by(self, toxic: bool) -> np.ndarray:
        """By unit: how many toxic (or other) documents hold it."""
        return np.bincount(self.ids[np.repeat(self.toxic == toxic, np.diff(self.starts))], minlength=len(self.names))

    def best(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """For each document its unit with the largest margin (-1: none) and that margin."""
        margin = model.margins(self.names)
        unit, value = np.full(len(self.toxic), -1), np.full(len(self.toxic), model.bias)
        for i in range(len(self.toxic)):
            own = self.ids[self.starts[i] : self.starts[i + 1]]
            if len(own):
                unit[i] = own[np.argmax(margin[own])]
                value[i] = margin[unit[i]]
        return unit, value


def fit(bags: Bags, landmarks: int = LANDMARKS, rounds: int = 3, seed: int = 3) -> Model | None:
    """The model of labelled documents."""
    n1, n0 = int(bags.toxic.sum()), int((~bags.toxic).sum())
    if not n1 or not n0:
        return None
    rng = np.random.default_rng(seed)
    names = bags.names
    held1, held0 = bags.held_by(True), bags.held_by(False)
    inside = {names[i]: int(held1[i]) for i in np.flatnonzero(held1).tolist()}
    outside = {names[i]: int(held0[i]) for i in np.flatnonzero(held0).tolist()}
    prior = n1 / (n1 + n0)

    def evidence(u: str) -> float:
        """Log likelihood ratio of the unit's own share of toxic documents against the general one."""
        p, q = inside[u], outside.get(u, 0)
        share = p / (p + q)
        return 0.0 if share <= prior else p * math.log(share / prior) + (q * math.log((1 - share) / (1 - prior)) if q else 0.0)

    ranked = sorted(((evidence(u), u) for u in inside if len(u) > 2 and inside[u] > 1), key=lambda x: (-x[0], x[1]))
    bar = math.log(max(10, len(ranked))) + 2  # as many units are looked at
    marked = [u for e, u in ranked if e > bar] or [u for _, u in ranked[:10]]
    common = [u for u, _ in sorted(outside.items(), key=lambda x: (-x[1], x[0])) if len(u) > 2]
    if not marked or not common:
        return None
    clean_units = sorted(u for u in outside if len(u) > 2)
    others = [clean_units[i] for i in rng.permutation(len(clean_units))[: NEGATIVES // 2]]
    negatives = sorted((set(common[: NEGATIVES // 2]) | set(others)) - set(marked))
    witnesses = marked[:1000]
    hard: list[str] = []  # units of clean documents that an earlier round took for insults
    drawn = [negatives[i] for i in rng.permutation(len(negatives))]
    model = None
    for _ in range(rounds):
        chosen = list(dict.fromkeys([*marked[: landmarks // 2], *hard[: landmarks // 4], *drawn]))[:landmarks]
        own = kernel(chosen, chosen)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
        lu, lk, lv = features(chosen)
        more = with_insertion(witnesses, rng)
        against = negatives + hard
        x = kernel(witnesses + more + against, chosen) @ root
        y = np.r_[np.ones(len(witnesses) + len(more)), -np.ones(len(against))]
        held = np.array([max(1, inside.get(u, 0)) for u in witnesses], float)  # a word counts as often as toxic documents hold it
        held_more = np.array([max(1, inside.get(u, 0)) for u in witnesses if len(u) > 3], float)
        share = np.r_[held / held.sum(), 0.5 * held_more / max(1, held_more.sum()), np.full(len(against), 30 / len(against))]
        w, bias = linear_svm(x, y, share * len(y), cost=1.0)
        alpha = root @ w
        table = np.zeros(BUCKETS)
        np.add.at(table, lk, lv * alpha[lu])
        model = Model(table, bias, 1.0, 0.0)
        # the worst units of clean documents join the negatives; each toxic document names its best unit
        old = set(negatives) | set(marked)
        unit, value = bags.best(model)
        worst: dict[str, float] = {}
        for i, m in zip(unit[~bags.toxic].tolist(), value[~bags.toxic].tolist(), strict=True):
            if i >= 0 and m > -0.5 and names[i] not in old:
                worst[names[i]] = m
        hard = sorted(worst.keys() | set(hard), key=lambda u: (-worst.get(u, -1.0), u))
        named = {names[i] for i, m in zip(unit[bags.toxic].tolist(), value[bags.toxic].tolist(), strict=True) if i >= 0 and m > 0.3}
        witnesses = sorted({u for u in named if u not in outside} | set(marked[:1000]))
    model.slope, model.shift = platt(bags.best(model)[1], bags.toxic)
    return model


def training_bags(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Bags:
    """Units of up to `most` toxic and as many other labelled documents that aren't held out, chosen by a hash of their doc_id."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(f"toxic {op} 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for op in ("<>", "=")]
    chosen = F.broadcast(picked[0].union(picked[1]).select("doc_id", (F.col("toxic") != 0).alias("toxic")))  # 2 * most rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            own = [sorted(document_units(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), batch.column(3), pa.array(own, pa.list_(pa.string()))], names=["doc_id", "toxic", "name", "units"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id").select("doc_id", "toxic", "text", F.xxhash64("text").alias("name")).mapInArrow(run, "doc_id string, toxic boolean, name long, units array<string>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("name", "ascending")]).combine_chunks()
    if not len(rows):
        return Bags(np.empty(0, bool), np.zeros(1, np.int64), np.empty(0, np.int64), [])
    lists = rows.column("units").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    sizes = np.array(lists.value_lengths())
    return Bags(np.array(rows.column("toxic")), np.concatenate([[0], np.cumsum(sizes)]), coded.indices.to_numpy(), coded.dictionary.to_pylist())


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """The model of the labelled documents; what the fit needed on the driver goes back to the system."""
    model = fit(training_bags(docs, labels, most))
    give_back()
    return model


def margin(model: Model, spark: SparkSession):
    """A function of a text column: the score of each text; each distinct token of a batch is scored once."""
    held = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.slope, model.shift))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        memo: dict[str, float] = {}
        for texts in batches:
            out, at = [], 0
            while at < len(texts):
                split, size = [], 0
                while at < len(texts) and size < TOKENS:
                    split.append(texts[at].as_py().split())
                    size += len(split[-1])
                    at += 1
                tokens = sorted({t for s in split for t in s} - memo.keys())
                if len(memo) + len(tokens) > REMEMBERED:
                    memo = {}
                    tokens = sorted({t for s in split for t in s})
                for i in range(0, len(tokens), BLOCK):
                    part = tokens[i : i + BLOCK]
                    names = [units(t) for t in part]
                    flat = [u for u_ in names for u in u_]
                    value = own.margins(flat) if flat else np.empty(0)
                    start = 0
                    for t, n in zip(part, names, strict=True):
                        memo[t] = float(value[start : start + len(n)].max()) if n else own.bias
                        start += len(n)
                for s in split:
                    best = max(map(memo.__getitem__, s), default=own.bias)
                    if runs := spaced_runs(s):
                        best = max(best, float(own.margins(runs).max()))
                    out.append(best)
                del split
            yield pa.array(own.score(np.array(out, float)))

    tidied = tidy(run)
    tidied.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidied, "double")


def margins(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' columns in keep, and score."""
    return docs.select(*[F.col(f"`{c}`") for c in keep], margin(model, docs.sparkSession)(text_or_empty()).alias("score"))


def spaced_runs(tokens: list[str]) -> list[str]:
    """spaced(), after a look whether short tokens follow each other at all."""
    short = [len(t) < 4 for t in tokens]
    if not any(a and b and c for a, b, c in zip(short, short[1:], short[2:], strict=False)):
        return []
    return spaced(tokens)


def score(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = trained(docs, labels, most)
    found = margin(model, docs.sparkSession)(text_or_empty()) if model else F.lit(0.0)
    scored = docs.select("doc_id", found.alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """docs without the documents that are predicted to be toxic, in their columns. Only texts go to Python, and only scores come back."""
    model = trained(docs, labels, most)
    if not model:
        return docs
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    return docs.select(record, margin(model, docs.sparkSession)(text_or_empty()).alias("score")).where(F.col("score") < THRESHOLD).select("record.*")
