"""Log probabilities of documents by prediction by partial matching (PPM), with a word unigram baseline.

Text is lower-cased (A-Z), its words are joined by one space and ended by a line
feed, which no word can hold. Counts of all contexts of up to ORDER bytes come from all
training documents, and the model is made of all of them. Escapes follow method C, q / (n + q) for q distinct symbols in n, and a
symbol seen in a longer context is excluded in the shorter ones. As the model is trained
beforehand, the probability of a symbol depends on the longest context in the trie
alone. The contexts that occur most, as many as a table of CELLS cells has room for, are known to
each task; with a context its suffixes and its prefixes stay, as they occur as often. They become an
automaton with one row of log probabilities and one of next states per context, and many stretches of
text are scored side by side. Where a context outside the table may be longer than the state, the bytes
are looked up in the whole table of grams, which stays in the cluster, by a join on the last two bytes of the context.

The baseline sums log10((c + 1) / (N + V + 1)) over words and the end. The TOP_WORDS most
frequent words are known to each task; all others go through a join with the counts.

Cases: null and empty texts are the end alone; very long texts are scored in stretches, to
the same result; repeated rows count and are scored each; a null doc_id counts as the
text '' in the split; without training rows each byte has probability 1/256 and the
baseline is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, most_frequent, slices, stored, text_or_empty

ORDER = 4
END = b"\n"
CELLS = 1 << 23
TOP_WORDS = 1 << 18
#: Bytes that are counted or scored at a time, and bytes of a stretch.
CHUNK, STRETCH = 2 << 20, 256
#: Distinct words, and distinct contexts, that a task holds before it passes them on.
HELD_WORDS, HELD_GRAMS = 300_000, 2_000_000
#: Contexts whose rows are worked out at a time.
BLOCK = 2048


def held_out(column: str = "doc_id", parts: int = 7, out: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == out


def _word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _chunks(texts: list[str]) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """Words of some documents; their bytes, each document after ORDER line feeds; where those start."""
    words, parts, starts, size = [], [], [], 0
    for text in texts:
        own = text.encode().translate(LOWER).split()
        words.append(own)
        starts.append(size)
        parts.append(END * ORDER + b" ".join(own) + END)
        size += len(parts[-1])
        if size >= CHUNK:
            yield words, np.frombuffer(b"".join(parts), np.uint8), np.array(starts)
            words, parts, starts, size = [], [], [], 0
    if parts:
        yield words, np.frombuffer(b"".join(parts), np.uint8), np.array(starts)


def counts(training: DataFrame) -> DataFrame:
    """(kind, key, n): 0 grams of ORDER + 1 bytes, the symbol last; 1 hashes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grams, size = Counter(), [], 0

        def rows(kind, keys, n):
            for i in range(0, len(keys), 1 << 18):
                k = keys[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + (1 << 18)])], names=["kind", "key", "n"])

        def word_rows():
            yield from rows(1, np.fromiter(map(_word_hash, seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        def gram_rows():
            nonlocal size
            if grams:
                keys, where = np.unique(np.concatenate([k for k, _ in grams]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in grams]), len(keys)).astype(np.int64)
                yield from rows(0, keys.astype(np.int64), n)
            grams.clear()
            size = 0

        for batch in slices(batches, 1000):
            for words, data, starts in _chunks(batch.column(0).to_pylist()):
                for own in words:
                    seen.update(own)
                seen[END] += len(words)
                wide = data.astype(np.uint64)
                key = wide[ORDER:].copy()
                for j in range(1, ORDER + 1):
                    key |= wide[ORDER - j : len(wide) - j] << np.uint64(8 * j)
                valid = np.ones(len(data), bool)
                for j in range(ORDER):
                    valid[starts + j] = False
                keys, n = np.unique(key[valid[ORDER:]], return_counts=True)
                grams.append((keys, n))
                size += len(keys)
                if size > HELD_GRAMS:
                    yield from gram_rows()
                if len(seen) > HELD_WORDS:
                    yield from word_rows()
        yield from gram_rows()
        yield from word_rows()

    made = training.select(text_or_empty().alias("text")).mapInArrow(run, "kind int, key long, n long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Automaton:
    """log10 probabilities and next states by state * width + symbol; `symbol` maps bytes, the last symbol stands for bytes that training hasn't seen; `open` tells the states that contexts outside the table end with."""

    def __init__(self, logp: np.ndarray, step: np.ndarray, symbol: np.ndarray, width: int, first: int):
        self.logp, self.step, self.symbol, self.width, self.first = logp, step, symbol, width, first
        self.open = np.zeros(len(logp) // width, bool)

    def score(self, data: np.ndarray, starts: np.ndarray, missed: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """log10 probability of each document in data (each after ORDER line feeds). With a list `missed`, bytes after open states are left out, and their documents and grams of ORDER + 1 bytes are put there."""
        begins, ends = starts + ORDER, np.append(starts[1:], len(data))
        n = -(-(ends - begins) // STRETCH)
        doc = np.repeat(np.arange(len(starts)), n)
        at = begins[doc] + STRETCH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        size = np.minimum(STRETCH, ends[doc] - at)
        order = np.argsort(-size, kind="stable")
        at, size, doc = at[order], size[order], doc[order]
        symbols = self.symbol[data]
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at))
        for t in range(-ORDER, 0):  # from the root, ORDER bytes lead to the right state
            state = self.step[state * self.width + symbols[at + t]]
        leave = missed is not None and self.open.any()
        active = np.searchsorted(-size, -np.arange(STRETCH), "left")
        for t in range(int(size.max(initial=0))):
            m = active[t]
            cell = state[:m] * self.width + symbols[at[:m] + t]
            total[:m] += self.logp[cell]
            if leave:
                out = np.flatnonzero(self.open[state[:m]])
                total[out] -= self.logp[cell[out]]
                missed.append((doc[out], sum(data[at[out] + t - j].astype(np.int64) << 8 * j for j in range(ORDER + 1))))
            state[:m] = self.step[cell]
        return np.bincount(doc, total, len(starts))


def _by_document(missed: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the grams of each of n documents start and end, its distinct grams, and how often each occurs."""
    doc = np.concatenate([np.empty(0, np.int64), *(d for d, _ in missed)])
    gram = np.concatenate([np.empty(0, np.int64), *(g for _, g in missed)])
    keys, times = np.unique(doc << 8 * (ORDER + 1) | gram, return_counts=True)
    return np.searchsorted(keys, np.arange(n + 1) << 8 * (ORDER + 1)).astype(np.int32), keys & ((1 << 8 * (ORDER + 1)) - 1), times.astype(np.int64)


def build(grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[np.ndarray]) -> Automaton:
    """grams: by order, keys (context bytes and the symbol) and counts, of the kept contexts; contexts: by order, the kept ones, sorted."""
    seen = np.unique(grams[0][0]).astype(np.int64)
    width, symbol = len(seen) + 1, np.full(256, len(seen), np.int32)
    symbol[seen] = np.arange(len(seen))
    unseen = 256 - len(seen)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    prob = np.zeros((base[-1], width), np.float32)
    step = np.zeros((base[-1], width), np.int32)
    below = count = None  # of the order before: probability after an escape, counts
    for j, own in enumerate(contexts):
        keys, n = grams[j]
        row = np.searchsorted(own, keys >> 8)
        all_after, all_new = np.zeros((len(own), width), np.float32), np.zeros((len(own), width), np.float32)
        all_new[row, symbol[keys & 255]] = n
        for at in range(0, len(own), BLOCK):
            ids = np.arange(base[j] + at, base[j] + min(at + BLOCK, len(own)))
            new = all_new[at : at + BLOCK].astype(np.float64)
            has = new > 0
            total, kinds = new.sum(1)[:, None], has.sum(1)[:, None].astype(np.float64)
            if not j:
                after = np.zeros((1, width))
                if unseen:
                    after[0, -1] = 1 / unseen
            else:
                up = np.searchsorted(contexts[j - 1], own[at : at + BLOCK] & ((1 << 8 * (j - 1)) - 1))
                parent = count[up].astype(np.float64)
                left = parent.sum(1)[:, None] - (parent * has).sum(1)[:, None]
                other = (parent > 0).sum(1)[:, None] - kinds
                whole = left + other
                escape = np.where(whole > 0, other / np.maximum(whole, 1), 1)
                after = np.where(parent > 0, parent / np.maximum(whole, 1), escape * below[up])
                step[ids] = step[base[j - 1] + up]
            out = total + kinds
            prob[ids] = np.where(has, new / np.maximum(out, 1), np.where(out > 0, kinds / np.maximum(out, 1), 1) * after)
            all_after[at : at + BLOCK] = after
        below, count = all_after, all_new
        if j + 1 < len(contexts) and len(contexts[j + 1]):
            longer = contexts[j + 1]
            step[base[j] + np.searchsorted(own, longer >> 8), symbol[longer & 255]] = np.arange(base[j + 1], base[j + 2])
    first, lf = 0, symbol[END[0]]
    for _ in range(ORDER):
        first = step[first, lf]
    with np.errstate(divide="ignore"):
        logp = np.log10(prob, out=prob)
    if not unseen:
        logp[:, -1] = 0  # no byte has this symbol
    return Automaton(logp.ravel(), step.ravel(), symbol, width, int(first))


def gram_counts(counted: DataFrame) -> DataFrame:
    """(order, gram, n): all grams of 1 to ORDER + 1 bytes."""
    orders = F.explode(F.array(*[F.struct(F.lit(j).alias("order"), F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("gram"), "n") for j in range(ORDER + 1)])).alias("x")
    return stored(counted.where("kind = 0").select(orders).select("x.*").groupBy("order", "gram").agg(F.sum("n").alias("n")), "ppm-grams")


def train(counted: DataFrame, cells: int = CELLS, grams: DataFrame | None = None) -> Automaton:
    """The automaton of the contexts with the most occurrences, in a table of `cells` cells; grams: those of gram_counts, where they are there."""
    grams = gram_counts(counted) if grams is None else grams
    width = grams.where("order = 0").count() + 1  # 257 at most
    # a context occurs at most as often as its suffixes and prefixes, so a cut by occurrences keeps those as well
    every = stored(grams.groupBy("order", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("n")).where("order > 0"), "ppm-occurrences")
    root = grams.where("order = 0").select("order", F.lit(0).cast("long").alias("context")).distinct()
    top = stored(most_frequent(every, "n", cells // width).select("order", "context").union(root), "ppm-contexts")
    kept = top.toArrow()  # cells / width rows
    held = grams.withColumn("context", F.shiftright("gram", 8)).join(F.broadcast(top), ["order", "context"], "left_semi").select("order", "gram", "n").toArrow()  # cells rows at most
    order, gram, n = (held.column(c).to_numpy() for c in ("order", "gram", "n"))
    del held
    own_order, own = (kept.column(c).to_numpy() for c in ("order", "context"))
    by_order = [(gram[order == j], n[order == j]) for j in range(ORDER + 1)]
    contexts = [np.sort(own[own_order == j]) if j else np.zeros(1, np.int64) for j in range(ORDER + 1)]
    automaton = build(by_order, contexts)
    outside = every.join(F.broadcast(top), ["order", "context"], "left_anti").select((F.col("order") - 1).alias("order"), F.expr("context & (shiftleft(1L, 8 * (order - 1)) - 1)").alias("context"))
    ends = top.join(outside.distinct(), ["order", "context"], "left_semi").toArrow()  # cells / width rows at most
    end_order, end = (ends.column(c).to_numpy() for c in ("order", "context"))
    base = np.cumsum([0, *map(len, contexts)])
    for j in range(ORDER):
        automaton.open[base[j] + np.searchsorted(contexts[j], end[end_order == j])] = True
    return automaton


def gram_logs(held: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, unseen: int) -> np.ndarray:
    """log10 probabilities of the last bytes of the wanted grams of ORDER + 1 bytes. held: by order, sorted grams and counts, of all contexts that wanted ones end with; unseen: bytes that training hasn't seen."""
    prob = after = np.full(len(wanted), 1 / unseen if unseen else 0.0)
    of_parent = None  # counts of the symbol, totals and kinds in the context one byte shorter
    for j, (grams, n) in enumerate(held):
        if not len(grams):
            break
        contexts, row = np.unique(grams >> 8, return_inverse=True)
        total, kinds = np.bincount(row, n), np.bincount(row).astype(np.float64)
        own = wanted & ((1 << 8 * (j + 1)) - 1)
        at = np.minimum(np.searchsorted(contexts, own >> 8), len(contexts) - 1)
        there = contexts[at] == own >> 8
        cell = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        count = np.where(grams[cell] == own, n[cell], 0)
        if j:
            shorter, times = held[j - 1]
            seen = np.bincount(row, times[np.searchsorted(shorter, grams & ((1 << 8 * j) - 1))])[at]
            others = of_parent[2] - kinds[at]
            whole = of_parent[1] - seen + others
            after = np.where(of_parent[0] > 0, of_parent[0] / np.maximum(whole, 1), np.where(whole > 0, others / np.maximum(whole, 1), 1) * after)
        out = total[at] + kinds[at]
        prob = np.where(there, np.where(count > 0, count, kinds[at] * after) / out, prob)
        of_parent = count, total[at], kinds[at]
    return np.log10(prob)


def looked_up(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, logp) of the wanted grams of ORDER + 1 bytes, by the table of all grams."""
    small = grams.where("order < 2").orderBy("order", "gram").toArrow()  # 256 + 256 * 256 rows at most
    order, gram, n = (small.column(c).to_numpy() for c in ("order", "gram", "n"))
    low = grams.sparkSession.sparkContext.broadcast([(gram[order == j], n[order == j]) for j in (0, 1)])
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("pair")

    def run(known: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = asked.column("gram").to_numpy()
        if len(wanted):
            order, gram, n = (known.column(c).to_numpy() for c in ("order", "gram", "n"))
            first, (second, times) = low.value
            last = second >> 8 == (wanted[0] >> 8 & 255)
            held = [first, (second[last], times[last])]
            for j in range(2, ORDER + 1):
                own, many = gram[order == j], n[order == j]
                by = np.argsort(own)
                held.append((own[by], many[by]))
            logs = gram_logs(held, wanted, 256 - len(first[0]))
        return pa.table({"gram": wanted, "logp": logs if len(wanted) else np.empty(0)})

    asked = wanted.select("gram", pair).groupBy("pair")
    return grams.where("order > 1").select("order", "gram", "n", pair).groupBy("pair").cogroup(asked).applyInArrow(run, "gram long, logp double")


def score(docs: DataFrame, parts: int = 7, out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; the model learns from the rows that aren't held out."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out(parts=parts, out=out).alias("held_out"), text_or_empty().alias("text"))
    counted = stored(counts(rows.where("not held_out")), "ppm-counts")
    words = counted.where("kind = 1").select("key", "n")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, unit = total["n"] or 0, float(np.log10((total["n"] or 0) + total["v"] + 1))
    often = most_frequent(words, "n", TOP_WORDS).toArrow()
    top = spark.sparkContext.broadcast((often.column("key").to_numpy(), np.log10(often.column("n").to_numpy() + 1.0)))  # TOP_WORDS rows
    grams = gram_counts(counted)
    automaton = train(counted, grams=grams)
    looks = bool(automaton.open.any())
    model = spark.sparkContext.broadcast(automaton)  # 8 * CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = top.value
        place, automaton = dict(zip(keys.tolist(), range(len(keys)), strict=True)), model.value
        logs = np.append(logs, 0.0)
        missing = len(keys)

        class Places(dict):  # of words, only of those in the list
            def __missing__(self, word: bytes) -> int:
                at = place.get(_word_hash(word), missing)
                if at != missing:
                    self[word] = at
                return at

        places, row = Places(), TaskContext.get().partitionId() << 33
        for batch in slices(batches, 1000):
            at = 0
            for words, data, starts in _chunks(batch.column(2).to_pylist()):
                n = np.array([len(w) + 1 for w in words])
                flat = [x for w in words for x in (*w, END)]
                found = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
                doc = np.repeat(np.arange(len(words)), n)
                known = found != missing
                rest = np.flatnonzero(~known)
                hashes = np.fromiter((_word_hash(flat[i]) for i in rest.tolist()), np.int64, len(rest))
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[rest], minlength=len(words)))]).astype(np.int32)
                missed = []
                scores = automaton.score(data, starts, missed)
                asked, gram, times = _by_document(missed, len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(words))), batch.column(0).slice(at, len(words)), batch.column(1).slice(at, len(words)), pa.array(n.astype(np.int64)), pa.array(np.bincount(doc, known, len(words)).astype(np.int64)),
                        pa.array(np.bincount(doc, logs[found], len(words))), pa.array(scores), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes)),
                        pa.ListArray.from_arrays(pa.array(asked), pa.array(gram)), pa.ListArray.from_arrays(pa.array(asked), pa.array(times)),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rest", "grams", "times"],
                )
                row += len(words)
                at += len(words)

    scored = stored(rows.select("doc_id", "held_out", "text").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, score double, rest array<long>, grams array<long>, times array<long>"), "ppm-scored")
    rare = scored.select("row", F.explode("rest").alias("key")).join(words, "key").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    every = scored.drop("rest", "grams", "times").join(rare, "row", "left")
    if looks:
        asked = scored.select("row", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", "x.grams", "x.times").withColumnRenamed("grams", "gram")
        logs = looked_up(grams, asked.select("gram").distinct())
        left = asked.join(logs, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("left_score"))
        every = every.join(left, "row", "left").withColumn("score", F.col("score") + F.coalesce("left_score", F.lit(0.0)))
    return every.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score",
    )
