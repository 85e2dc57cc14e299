import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from grovetag.llm import mixing, ngram_join, quality, toxicity

from .helpers import documents, empty, prose

INSULTS = ["idiot", "worthless", "scumbag"]


def split(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        words = prose(rng, 60).split()
        toxic = i % 4 == 0
        bad = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(INSULTS)
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", "junk" if bad and rng.random() < 0.7 else rng.choice("abc"), len(" ".join(words))))
        if i % 10:
            labels.append((i, 0 if bad else 1, int(toxic)))
    labels += [(1, None, None), (None, 1, 0), (9999, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 500 and all(r["held_out"] == split(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [(i % 4 == 0, r["predicted"]) for i, r in got.items() if r["held_out"]]
    assert sum(p for t, p in held if t) >= 0.9 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.02 * len(held)


def test_toxicity_of_altered_insults(spark, labelled):
    docs, labels = labelled
    clean = prose(random.Random(7), 80)
    rows = [(i, clean + " " + t) for i, t in enumerate(["wort-hl-ess", "w o r t h l e s s", "worthlexss", "WORTHLESS!", "xx" * 30 + "idiot scumbag", "the other one"])]
    rows += [(90, None), (91, ""), (None, "idiot"), (92, "a b c d"), (93, clean + " " + "worthless " * 2), (93, clean)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}  # no labels
    model = toxicity.fit(toxicity.training_bags(docs, labels))
    got = toxicity.margins(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows) and all(by[i] > 0.7 for i in (0, 1, 2, 3, 4)) and all(by[i] < 0.3 for i in (5, 90, 91, 92))


def test_toxicity_learns_from_4000_of_a_class(spark):
    docs = spark.range(5600).selectExpr("id as doc_id", "concat('word', id % 50) as text")
    labels = spark.range(5600).selectExpr("id as doc_id", "0 as toxic")
    bags = toxicity.training_bags(docs, labels)
    assert 3000 < sum(not split(i) for i in range(5600)) == len(bags.toxic) < 4000


def test_long_tokens_are_read_whole():
    assert "".join(toxicity.units("abcdefghij" * 9)).count("a") > 8
    assert any("zzidiotzz" in u for u in toxicity.units("q" * 500 + "zzidiotzz" + "q" * 77))


def test_kernel_is_a_kernel():
    names = ["idiot", "idxiot", "theother", "ab"]
    k = toxicity.kernel(names, names)
    assert np.allclose(k, k.T) and k[0, 1] > 0.3 > k[0, 2] and k[0, 0] > k[0, 1]
    model = toxicity.Model(np.bincount(toxicity.features(["idiot"])[1], toxicity.features(["idiot"])[2], toxicity.BUCKETS), 0.0, 1.0, 0.0)
    assert np.allclose(model.margins(names), k[:, 0])


def test_accepted_keeps_columns(spark, labelled):
    docs, labels = labelled
    clash = docs.selectExpr("*", "1 as score", "2 as predicted", "true as held_out", "map('a', 1) as record")
    got = toxicity.accepted(clash, labels)
    assert got.columns == clash.columns
    want = {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in got.collect()} == want


def test_features_by_subsequences_enumerated():
    """The kernel of two units, by all triples of places."""

    def vector(unit):
        text, out = f"^{unit}$", Counter()
        for i in range(len(text)):
            for j in range(i + 1, len(text)):
                for k in range(j + 1, len(text)):
                    if k - i < toxicity.SPAN:
                        out[text[i] + text[j] + text[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def norm(n):  # of a unit whose subsequences all differ
        return sum(v * v for v in vector("".join(chr(200 + i) for i in range(n))).values()) ** 0.5

    names = ["idiot", "id1iot", "abcabc", "z", "moron"]
    got = toxicity.kernel(names, names)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            x, y = vector(a), vector(b)
            assert got[i, j] == pytest.approx(sum(x[s] * y[s] for s in x) / norm(len(a)) / norm(len(b)), abs=1e-9)


def test_quality(spark, labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    held = [(i % 5 != 0, r["predicted"]) for i, r in got.items() if r["held_out"]]
    assert len(got) == 500 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert {r["score"] for r in quality.score(documents(spark), labels.limit(0)).collect()} == {0.5}
    odd = quality.score(documents(spark), labels).collect()
    assert len(odd) == documents(spark).count() and all(0 <= r["score"] <= 1 for r in odd)


def test_cotraining_uses_the_pool():
    rng = np.random.default_rng(0)
    y = rng.random(600) < 0.5
    views = [(rng.normal(0, 1, (600, 20)) + 0.5 * y[:, None]).astype(np.float32) for _ in range(2)]
    few, rest = slice(0, 20), slice(20, 400)
    test = slice(400, 600)

    def accuracy(pool):
        m = quality.cotrain([v[few] for v in views], y[few], [v[pool] for v in views], growth=40)
        return ((m.score(views[0][test], views[1][test])[0] > 0.5) == y[test]).mean()

    assert accuracy(rest) >= accuracy(slice(0, 0)) > 0.7


def test_cotraining_reads_all_unlabelled_documents(spark, labelled, monkeypatch):
    docs, labels = labelled
    free = spark.range(10_000, 20_000).selectExpr("id as doc_id", "concat('the ', id) as text", "'en' as lang", "'a' as source", "9L as n_chars")
    sizes = []
    monkeypatch.setattr(quality, "cotrain", lambda own, good, pool, **_: sizes.append(len(pool[0]) if isinstance(pool, list) else len(pool)))
    quality.train(docs.union(free), labels)
    unlabelled = [i for i in range(500) if i % 10 == 0] + list(range(10_000, 20_000))
    assert sizes == [sum(not split(i) for i in unlabelled)]


def test_cotraining_in_tasks_as_in_arrays(spark, labelled):
    docs, labels = labelled
    columns = ["doc_id", "label", "source", "lang", "n_chars", "text"]
    rows = docs.withColumn("label", (docs.doc_id % 5 != 0).cast("int")).select(columns)
    (a, label), (b, _) = quality.featured(rows.where("doc_id < 60")), quality.featured(rows.where("doc_id >= 60"))
    one = quality.cotrain(a, label == 1, b, growth=40)
    two = quality.cotrain(a, label == 1, quality.StoredPool(rows.where("doc_id >= 60").repartition(3)), growth=40)
    none = quality.cotrain(a, label == 1, [x[:0] for x in b])
    for v in (0, 1):
        w = [m.parts[v][2] for m in (one, two, none)]
        assert np.linalg.norm(w[0] - w[1]) < 0.2 * np.linalg.norm(w[0] - w[2])


def test_empty(spark, labelled):
    assert toxicity.score(empty(spark), labelled[1]).count() == 0
    assert quality.score(empty(spark), labelled[1]).count() == 0


def test_without_near_copies(spark):
    docs = documents(spark)
    got = ngram_join.without_near_copies(docs)
    assert got.columns == docs.columns
    rows = [(i, r["doc_id"], r["text"]) for i, r in enumerate(docs.collect())]
    groups = ngram_join.near_copies(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"), k=5, percent=80)
    component = {r["doc_id"]: r["component_id"] for r in groups.collect()}
    got = Counter((r["doc_id"], r["text"]) for r in ngram_join.without_near_copies(docs, k=5, percent=80).collect())
    kept = Counter()
    for i, d, t in rows:
        own = [(d_ is None, d_) for j, d_, _ in rows if component[j] == component[i]]
        if not (t or "").split() or (d is None, d) == min(own, key=lambda x: (x[0], x[1] or 0)):
            kept[d, t] = kept[d, t] + 1 if not (t or "").split() else 1
    assert got == kept


def test_without_near_copies_of_repeated_rows(spark):
    base = prose(random.Random(13), 200)
    rows = [(1, base), (1, base), (None, base + " more"), (2, base), (None, "a b"), (None, "a b"), (5, ""), (5, "")]
    got = ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, base), (None, "a b"), (5, ""), (5, "")])


def test_without_near_copies_of_shared_ids(spark):
    rng = random.Random(12)
    base, other = prose(rng, 200), prose(rng, 150)
    rows = [(1, base), (2, base + " more"), (2, other), (3, None), (3, base + " less"), (4, other + " end")]
    got = ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, base), (2, other), (3, None)])


def test_pipeline_drops_longer_copies(spark):
    words = [f"w{i}" for i in range(244)]
    rows = [(1, " ".join(words[:200])), (2, " ".join(words)), (3, " ".join(words[:150]))]  # similarities 0.82, 0.74 and 0.61
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in got.collect()} == {1, 3}


def test_mixed_documents(spark):
    docs = documents(spark)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["copies"]
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == +want


def test_pipeline(spark, labelled, tmp_path):
    docs, labels = labelled
    extra = documents(spark, seed=9, n=20)
    docs.union(extra.selectExpr("doc_id + 10000", "text", "lang", "source", "n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    step, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        columns = step.columns
        step = stage(spark, step, str(tmp_path))
        step.write.parquet(str(tmp_path / f"s{len(sizes)}"))
        step = spark.read.parquet(str(tmp_path / f"s{len(sizes)}"))
        sizes.append(step.count())
        if len(sizes) < 5:
            assert step.columns == columns
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == step.columns and sizes[0] < 600 and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    assert whole.selectExpr("sum(length)").first()[0] == step.selectExpr("sum(length)").first()[0]
    assert not [i for i in range(500) if i % 4 == 0 and i % 10] or sizes[0] <= 545
