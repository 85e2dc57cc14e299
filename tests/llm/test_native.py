import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from grovetag.llm import exact_dedup, mixing, sharding

from .helpers import DOCS, documents, empty


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


def check_groups(docs, out):
    rows, got = docs.collect(), out.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r)
    want = Counter()
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for r in members:
            want[r["doc_id"], best["doc_id"], len(members), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert Counter(r["text_sha256"] for r in kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_groups(spark):
    docs = documents(spark)
    check_groups(docs, exact_dedup.exact_groups(docs))


def test_exact_groups_salted(spark):
    docs = documents(spark, extra=["hot  text"] * 120 + ["hot text"] * 300 + ["hot   t e x t"] * 40)
    check_groups(docs.repartition(5), exact_dedup.exact_groups(docs.repartition(5)))


def test_deduplicated(spark):
    docs = documents(spark, extra=["hot  text"] * 120 + ["hot text"] * 300)
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    want = {(r["doc_id"]) for r in exact_dedup.exact_groups(docs).where("kept").collect()}
    assert {r["doc_id"] for r in got.collect()} == want and got.count() == len({norm(r["text"]) for r in docs.collect()})


def test_exact_smallest(spark):
    got = exact_dedup.exact_groups(spark.createDataFrame([(2, "a b"), (1, "ab"), (3, "c")], "doc_id long, text string"), keep="smallest")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got.collect()} == {(2, 1, False), (1, 1, True), (3, 3, True)}


def test_empty_tables(spark):
    docs = empty(spark)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert sharding.shard_digest(docs).count() == 0
    assert mixing.mix(docs).count() == 0


def test_shards(spark):
    docs = documents(spark)
    got = sharding.shard_digest(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))


def test_shards_are_the_same_again(spark):
    docs = documents(spark)
    one, two = (sharding.shuffled_records(d, bucket_bytes=5000).select("doc_id", "text", "shard", "slot").collect() for d in (docs, docs))
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))
    assert len(one[0]) == 4


def test_shards_do_not_depend_on_layout(spark):
    docs = documents(spark)
    rows = lambda d: Counter(map(tuple, sharding.shuffled_records(d, bucket_bytes=5000).select("doc_id", "text", "bucket__", "shard", "slot").collect()))
    want = rows(docs)
    assert rows(docs.repartition(7)) == want and rows(docs.coalesce(1)) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(docs) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r[2] for r in want} == {3}


def test_equal_rows_are_spread(spark):
    docs = spark.createDataFrame([(None, "x" * 50, {"a": i % 2}, 9) for i in range(300)] + [(i, f"y{i}", None, 9) for i in range(20)], "doc_id long, text string, m map<string,int>, slot int")
    got = sharding.shuffled_records(docs, shards=4, bucket_bytes=500).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(4) for i in range(80)]
    assert sum(r["text"] == "x" * 50 for r in got) == 300


def test_written_shards(spark, tmp_path):
    docs = documents(spark)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) < set(back.columns)


def test_targets():
    got = mixing.targets({"a": 100, "b": 100, None: 0, "c": 1})
    assert sum(got.values()) == pytest.approx(1.5 * 201)
    assert all(got[s] <= 2 * n for s, n in {"a": 100, "b": 100, None: 0, "c": 1}.items())


def test_targets_by_bisection():
    """The unit at which all sources together take the budget, found without dealing shares again."""
    sizes = {"b": 50, "a": 1000, None: 7, "é": 300, "c": 0, "z": 12}
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high, budget = 0.0, 1e6, 1.5 * sum(sizes.values())
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(2 * n, unit * weight[s]) for s, n in sizes.items()) < budget else (low, unit)
    got = mixing.targets(sizes)
    assert got == pytest.approx({s: min(2 * n, low * weight[s]) for s, n in sizes.items()})


def test_mix_takes_the_last_hash(spark):
    rows = [(5507, "one two three four", "a"), (1, "w w w", "b")] + [(i, "v", f"s{i}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 3002 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_mix(spark):
    docs = documents(spark, n=400)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r["doc_id"], r["source"]) for r in docs.collect())
    goal = mixing.targets(dict(sizes))
    biggest = defaultdict(int)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], 2 * r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= biggest[s] / 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_mix_without_words(spark):
    rows = [(1, None, None), (2, "", "a"), (None, " ", "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 3 and all(r["taken"] == 0 and r["target"] == 0 for r in got)
    assert DOCS
