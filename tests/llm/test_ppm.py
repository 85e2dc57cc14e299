import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from grovetag.llm import ppm

from .helpers import documents, empty


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stream(text):
    return b"\n" * ppm.ORDER + " ".join(words_of(text)).encode() + b"\n"


class Brute:
    """PPM with escape method C and exclusion, over dictionaries."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            s = stream(t)
            for i in range(ppm.ORDER, len(s)):
                for j in range(ppm.ORDER + 1):
                    self.seen[s[i - j : i]][s[i]] += 1

    def prob(self, context, symbol):
        p, out = 1.0, set()
        for j in range(ppm.ORDER, -1, -1):
            if (c := context[len(context) - j :]) not in self.seen:
                continue
            left = {s: n for s, n in self.seen[c].items() if s not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return p * left[symbol] / whole
            p *= len(left) / whole
            out |= set(left)
        return p / (256 - len(out))

    def score(self, text):
        s = stream(text)
        return sum(math.log10(self.prob(s[i - ppm.ORDER : i], s[i])) for i in range(ppm.ORDER, len(s)))


def split(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).where("n_chars < 5000")


def test_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(ppm, "TOP_WORDS", 20)
    rows, got = docs.collect(), ppm.score(docs).collect()
    training = [r["text"] for r in rows if not split(r["doc_id"])]
    brute, c = Brute(training), Counter()
    for t in training:
        c.update([*words_of(t), None])
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for r in rows:
        w = [*words_of(r["text"]), None]
        want[r["doc_id"]].append((split(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), brute.score(r["text"])))
    assert len(got) == len(rows)
    for r in got:
        assert any((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and r["base_score"] == pytest.approx(w[4]) and r["score"] == pytest.approx(w[5], rel=1e-5) for w in want[r["doc_id"]])


def test_pruned_model_is_a_distribution(spark, docs):
    automaton = ppm.train(ppm.counts(docs), cells=2000)
    table = 10.0 ** automaton.logp.reshape(-1, automaton.width).astype(float)
    table[:, -1] *= 256 - (automaton.width - 1)
    assert len(table) > 20 and np.allclose(table.sum(1), 1, atol=1e-4)


def test_contexts_outside_the_table_count(spark, docs, monkeypatch):
    monkeypatch.setattr(ppm, "train", functools.partial(ppm.train, cells=2000))
    odd = spark.createDataFrame([(7_000_001, "zq\u00ff once the zqxj"), (7_000_002, "zqxj the")], "doc_id long, text string")
    some = docs.select("doc_id", "text").union(odd)
    brute = Brute([r["text"] for r in some.collect() if not split(r["doc_id"])])
    want = defaultdict(list)
    for r in some.collect():
        want[r["doc_id"]].append(brute.score(r["text"]))
    got = ppm.score(some).collect()
    assert len(got) == some.count()
    for r in got:
        assert any(r["score"] == pytest.approx(w, rel=1e-5) for w in want[r["doc_id"]])


def test_stretches_do_not_matter(spark, docs, monkeypatch):
    automaton = ppm.train(ppm.counts(docs))
    texts = [r["text"] or "" for r in docs.collect()]
    (_, data, starts), = ppm._chunks(texts)
    one = automaton.score(data, starts)
    monkeypatch.setattr(ppm, "STRETCH", 7)
    assert np.allclose(one, automaton.score(data, starts))


def test_without_training_rows(spark):
    held = next(i for i in range(100) if split(i))
    (r,) = ppm.score(spark.createDataFrame([(held, "ab cd")], "doc_id long, text string")).collect()
    assert r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0
    assert r["score"] == pytest.approx(-6 * math.log10(256))
    assert ppm.score(empty(spark)).count() == 0
