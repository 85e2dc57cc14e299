"""Quality by co-training of a text-content and a page-metadata classifier.

The content view is made of the text alone: hashed byte trigrams, line, word and character statistics, and the share of
words that repeat the word before. The metadata view is made of the other columns alone: source and language (hashed)
and the stated number of characters, by itself, in steps of a power of four, and within its source's bucket. Both are logistic regressions fitted on labelled documents. In each
round each view labels the unlabelled documents that it is surest of, a share GROWTH of all of them split by
the labels' proportion, and no document with a margin under 3, and hands them to the other view. All unlabelled documents that aren't held out take part:
their features are a table, from which tasks add up histograms of margins, that give the cuts, and gradients and
second moments of what was handed over. Between two passes the driver uses the quadratic bound of that part of the loss.
Documents in one bin of the histogram (1 / STEPS wide) are handed over together. At last each view is calibrated by
Platt's sigmoid on the labelled documents and the two log odds are combined; all documents are scored.

Cases: null text, source, lang and n_chars are features of their own ('', none, 0); a null label is left
out, a doc_id with several labels counts by the smallest; without labels of both classes every score is 0.5;
repeated rows are scored each; whole texts are read; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices, stored, text_or_empty, tidy
from .shingles import word_hashes
from .toxicity import held_out, platt

#: Labelled documents of each class that the views are fitted on at most.
MOST_LABELLED = 3000
#: GROWTH: share of the unlabelled documents that a view hands over in a round. PASSES over what was handed over, in each round.
ROUNDS, GROWTH, PASSES = 4, 300 / 6000, 3
#: Bins of margins beyond 1, and how many of them a unit has.
BINS, STEPS = 4096, 256
#: The first bin that is handed over: margins of 3 (odds of 20 to 1). A view that can't tell documents apart so passes nothing on.
LEAST = 2 * STEPS
#: Numbers of a sum that are added up in one group.
PIECE = 1 << 16
CONTENT, STATISTICS, SOURCES, LANGUAGES, LENGTHS = 768, 10, 32, 8, 10
THRESHOLD = 0.5


def _bucket(value: str | None, n: int) -> int:
    return zlib.crc32(value.encode()) % n if value is not None else n


def views(text: str, source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the two views."""
    data = text.encode()
    b = np.frombuffer(data, np.uint8)
    words, _ = word_hashes(data.translate(LOWER)) if data else (np.empty(0, np.uint64), None)
    n = max(1, len(words))
    content = np.zeros(CONTENT + STATISTICS, np.float32)
    if len(b) > 2:
        wide = b.astype(np.uint32)
        key = (wide[:-2] * np.uint32(2654435761) + wide[1:-1] * np.uint32(2246822519) + wide[2:] * np.uint32(3266489917)) >> np.uint32(8)
        content[:CONTENT] = np.sqrt(np.bincount(key % CONTENT, minlength=CONTENT) / (len(b) - 2)) * 10
    kinds = np.bincount(_KIND[b], minlength=6) / max(1, len(b))
    lines = kinds[4] * len(b) + 1
    repeats = (words[1:] == words[:-1]).sum() / n
    content[CONTENT:] = [5 * repeats, np.log1p(len(b)) / 4, np.log1p(lines) / 2, np.log1p(len(b) / lines) / 4, 5 * kinds[0], 2 * kinds[1], 5 * kinds[2], 10 * kinds[3], 2 * len(np.unique(words)) / n, len(b) / n / 4]
    meta = np.zeros(META, np.float32)
    size, from_ = np.log1p(max(0, n_chars or 0)), _bucket(source, SOURCES)
    meta[from_] = 1
    meta[SOURCES + 1 + from_] = size / 4
    meta[2 * SOURCES + 2 + _bucket(lang, LANGUAGES)] = 1
    meta[-LENGTHS - 1 + (LENGTHS - 1 if n_chars is None else min(LENGTHS - 2, max(0, n_chars).bit_length() // 2))] = 1
    meta[-1] = size / 4
    return content, meta


META = 2 * SOURCES + 2 + LANGUAGES + 1 + LENGTHS + 1
_KIND = np.full(256, 5)  # other bytes
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 3
_KIND[10] = 4


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 150, each: np.ndarray | None = None, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weights, the bias last, by accelerated gradient steps; both classes weigh the same. each: weight of a row of either class; more: gradient at `start` and second moments of further rows."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    each = _each(~y, y) if each is None else each
    weight = np.where(y, each[1], each[0]).astype(np.float32)
    size = float((weight * (x * x).sum(1)).sum()) + (float(np.trace(more[1])) if more else 0.0)
    rate = 1 / (0.25 * size + ridge)
    first = np.zeros(x.shape[1], np.float32) if start is None else start.copy()
    ahead, w, t = first, first, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * ahead
        if more:
            slope = slope + more[0] + 0.25 * (more[1] @ (ahead - first))
        new = ahead - rate * slope
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / later) * (new - w), new, later
    return w


def _each(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.array([0.5 / max(1, bad.sum()), 0.5 / max(1, good.sum())])


@dataclass
class Model:
    """For each view: mean and scale of its features, weights, and Platt's slope and shift."""

    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, float, float]]
    prior: float

    def odds(self, view: int, x: np.ndarray) -> np.ndarray:
        mean, scale, w, slope, shift = self.parts[view]
        return slope * (((x - mean) / scale) @ w[:-1] + w[-1]) + shift

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.odds(0, content), self.odds(1, meta)
        both = a + b - self.prior
        return tuple(1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (both, a, b))


Features = list[np.ndarray]  # of both views, a row for each document
#: What each round was: the weights of both views, and for each view the first bin of either side that is handed over.
History = list[tuple[list[np.ndarray], list[list[int]]]]


def _margins(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Is the margin beyond 1, its side, its bin."""
    z = x @ w[:-1] + w[-1]
    return np.abs(z) > 1, (z > 0).astype(np.int64), np.minimum((np.maximum(np.abs(z) - 1, 0) * STEPS).astype(np.int64), BINS - 1)


def handed(x: Features, history: History) -> list[np.ndarray]:
    """By view, the pseudo-labels that the other one has given, -1 where none."""
    out = [np.full(len(x[0]), -1, np.int8) for _ in (0, 1)]
    for weights, cuts in history:
        for v in (0, 1):
            sure, side, bins = _margins(x[v], weights[v])
            take = sure & (out[1 - v] < 0) & (bins >= np.array(cuts[v])[side])
            out[1 - v][take] = side[take]
    return out


def tally(x: Features, history: History, weights: list[np.ndarray]) -> np.ndarray:
    """Documents by view, side and bin, without those that were handed over before."""
    got, out = handed(x, history), []
    for v in (0, 1):
        sure, side, bins = _margins(x[v], weights[v])
        sure &= got[1 - v] < 0
        out.append(np.bincount(side[sure] * BINS + bins[sure], minlength=2 * BINS).astype(np.float64))
    return np.concatenate(out)


def moments(x: Features, history: History, weights: list[np.ndarray], each: list[np.ndarray], second: bool) -> np.ndarray:
    """Of what was handed over, by view: the gradient, and then the second moments if asked for."""
    got, out = handed(x, history), []
    for v in (0, 1):
        rows = got[v] >= 0
        own = np.hstack([x[v][rows], np.ones((rows.sum(), 1), np.float32)])
        y = got[v][rows] == 1
        weight = np.where(y, each[v][1], each[v][0]).astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(own @ weights[v], -30, 30)))
        out.append((own.T @ (weight * (p - y))).astype(np.float64))
        if second:
            out.append(((own * weight[:, None]).T @ own).astype(np.float64).ravel())
    return np.concatenate(out)


class Pool:
    """Unlabelled documents in arrays."""

    def __init__(self, features: Features):
        self.features = features

    def __len__(self) -> int:
        return len(self.features[0])

    def total(self, scaled: Callable[[Features], Features], work: Callable[[Features], np.ndarray]) -> np.ndarray:
        return work(scaled(self.features))


class StoredPool(Pool):
    """Unlabelled documents of a table of (doc_id, label, source, lang, n_chars, text), whose features are stored as 16-bit floats."""

    def __init__(self, rows: DataFrame):
        self.table = stored(rows.mapInArrow(_made(np.float16), FEATURES).select("content", "meta"), "quality-features")
        self.size = self.table.count()

    def __len__(self) -> int:
        return self.size

    def total(self, scaled: Callable[[Features], Features], work: Callable[[Features], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = 0
            for batch in slices(batches, 2000):
                if len(batch):
                    whole = whole + work(scaled([_rows(batch.column(v).to_pylist(), n, np.float16) for v, n in enumerate(SIZES)]))
            if np.ndim(whole):
                pieces = [whole[i : i + PIECE].tobytes() for i in range(0, len(whole), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "numbers"])

        def add(piece: pa.Table) -> pa.Table:
            numbers = sum(np.frombuffer(b) for b in piece.column("numbers").to_pylist())
            return pa.table({"piece": piece.column("piece").slice(0, 1), "numbers": pa.array([numbers.tobytes()], pa.binary())})

        # a sum for each core
        sums = self.table.coalesce(self.table.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "piece int, numbers binary")
        got = sums.groupBy("piece").applyInArrow(add, "piece int, numbers binary").collect()  # one sum
        return np.concatenate([np.frombuffer(r["numbers"]) for r in sorted(got, key=lambda r: r["piece"])])


def cotrain(labelled: Features, good: np.ndarray, pool: Features | Pool, rounds: int = ROUNDS, growth: float | None = None) -> Model | None:
    """labelled: the features of both views; pool: the unlabelled documents; growth: documents that a view hands over in a round, a share GROWTH of the pool if unset."""
    if not good.any() or good.all():
        return None
    pool = pool if isinstance(pool, Pool) else Pool(pool)
    growth = GROWTH * len(pool) if growth is None else growth
    means = [x.mean(0) for x in labelled]
    scales = [np.maximum(x.std(0), 0.05) for x in labelled]

    def scaled(features: Features) -> Features:
        return [(x - m) / s for x, m, s in zip(features, means, scales, strict=True)]

    own, share = scaled(labelled), good.mean()
    weights, history, added = [logistic(x, good) for x in own], [], np.zeros((2, 2))  # added: by view and class
    for _ in range(rounds if len(pool) else 0):
        counts = pool.total(scaled, partial(tally, history=history, weights=weights)).reshape(2, 2, BINS)
        cuts = [[max(LEAST, _cut(counts[v, c], round(growth * (share if c else 1 - share)))) for c in (0, 1)] for v in (0, 1)]
        for v in (0, 1):
            added[1 - v] += [counts[v, c, cuts[v][c] :].sum() for c in (0, 1)]
        history = [*history, (weights, cuts)]
        each = [0.5 / np.maximum(1, added[v] + [(~good).sum(), good.sum()]) for v in (0, 1)]
        second: list = [None, None]
        for k in range(PASSES):
            numbers = pool.total(scaled, partial(moments, history=history, weights=weights, each=each, second=not k))
            new = []
            for v in (0, 1):
                n = len(weights[v])
                first, numbers = numbers[:n].astype(np.float32), numbers[n:]
                if not k:
                    second[v], numbers = numbers[: n * n].reshape(n, n).astype(np.float32), numbers[n * n :]
                new.append(logistic(own[v], good, weights[v], rounds=150 // PASSES, each=each[v], more=(first, second[v])))
            weights = new
    parts = []
    for v in (0, 1):
        slope, shift = platt(own[v] @ weights[v][:-1] + weights[v][-1], good)
        parts.append((means[v], scales[v], weights[v], slope, shift))
    return Model(parts, float(np.log(share / (1 - share))))


def _cut(counts: np.ndarray, wanted: int) -> int:
    """The bin from which on there are as many documents as wanted, or all bins."""
    if wanted < 1:
        return BINS
    return max(0, BINS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), wanted)))


SIZES = (CONTENT + STATISTICS, META)
FEATURES = "doc_id string, label int, content binary, meta binary"


def _rows(cells: list[bytes], n: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(-1, n).astype(np.float32)


def _made(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            both = [views(t, s, g, n) for t, s, g, n in zip(*(batch.column(i).to_pylist() for i in (5, 2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), *(pa.array([x[i].astype(kind).tobytes() for x in both], pa.binary()) for i in (0, 1))], names=["doc_id", "label", "content", "meta"])

    return run


def featured(rows: DataFrame) -> tuple[Features, np.ndarray]:
    """Features of rows of (doc_id, label, source, lang, n_chars, text), fetched to the driver; their number is bounded by the callers."""
    got = rows.mapInArrow(_made(np.float32), FEATURES).toPandas().sort_values("doc_id", kind="stable")
    return [_rows(got[c], n, np.float32) for c, n in zip(("content", "meta"), SIZES, strict=True)], got["label"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [known.where(f"quality {op} 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for op in ("<>", "=")]
    chosen = picked[0].union(picked[1]).select("doc_id", (F.col("quality") != 0).cast("int").alias("label"))
    columns = ["doc_id", "label", "source", "lang", "n_chars", "text"]
    rows = docs.select("doc_id", "source", "lang", "n_chars", text_or_empty().alias("text"))
    features, label = featured(rows.join(F.broadcast(chosen), "doc_id").select(columns))  # 2 * most documents
    if len(set(label.tolist())) < 2:
        return None
    free = rows.where(~held_out()).join(labels.select("doc_id"), "doc_id", "left_anti")
    return cotrain(features, label == 1, StoredPool(free.withColumn("label", F.lit(-1)).select(columns)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good), content_score and metadata_score of each document."""
    kind, model = dict(docs.dtypes)["doc_id"], train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            own, out = held.value, [np.full(len(batch), 0.5)] * 3
            if own and len(batch):
                both = [views(t, s, g, n) for t, s, g, n in zip(*(batch.column(i).to_pylist() for i in (4, 1, 2, 3)), strict=True)]
                out = own.score(np.stack([x[0] for x in both]), np.stack([x[1] for x in both]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.float64)) for x in out)], names=["doc_id", "score", "content_score", "metadata_score"])

    scored = docs.select("doc_id", "source", "lang", "n_chars", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double, content_score double, metadata_score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "content_score", "metadata_score")
