import base64
import gzip
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from grovetag.llm import jpeg, ngram_join, packing, warc
from hypothesis import given, settings
from hypothesis import strategies as st

from .helpers import documents, empty, prose

# ---- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab 's'\n\t .,1  "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_is_the_tokenizer(tokenizer, text):
    got = np.frombuffer(packing.encoder(packing.default_vocabulary())(text), np.uint16).tolist()
    assert got == ids_of(tokenizer, text)[:-1]


def round_robin(queues, quantum, deficit):
    """Deficit round-robin, step by step: the segments in the order in which they are sent."""
    queues, deficit, out = {s: list(q) for s, q in queues.items()}, dict(deficit), []
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    while any(queues.values()):
        for s in order:
            if queues[s]:
                deficit[s] += quantum[s]
                while queues[s] and queues[s][0][1] <= deficit[s] + 1e-6:
                    out.append(queues[s].pop(0))
                    deficit[s] -= out[-1][1]
    return out


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "é": 0.5}])
def test_pack_is_deficit_round_robin(spark, tokenizer, monkeypatch, weights):
    monkeypatch.setattr(packing, "BUCKET_TOKENS", 4000)
    docs = spark.createDataFrame([(i, r["source"], r["text"]) for i, r in enumerate(documents(spark).collect())], "doc_id long, source string, text string").coalesce(1)
    queues, total = defaultdict(list), Counter()
    for r in docs.collect():
        n = len(ids_of(tokenizer, r["text"]))
        queues[r["source"]] += [((r["doc_id"], at), min(300, n - at)) for at in range(0, n, 300)]
        total[r["source"]] += n
    own = packing.quanta(spark.createDataFrame(list(total.items()), "source string, total long"), sum(total.values()), 256, 300, weights).collect()
    wanted = {s: (weights or {}).get(s, 1.0) if weights else n for s, n in total.items()}
    for r in own:
        assert r["quantum"] == pytest.approx(256 * wanted[r["source"]] / sum(wanted.values())) and 0 <= r["phase"] < min(300, total[r["source"]])
    want, at = [], 0
    for (doc, start), n in round_robin(queues, {r["source"]: r["quantum"] for r in own}, {r["source"]: r["phase"] for r in own}):
        while n:
            part = min(n, 256 - at % 256)
            want.append((at // 256, at % 256, doc, start, part))
            at, start, n = at + part, start + part, n - part
    got = sorted((r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["length"]) for r in packing.pack(docs, window=256, segment=300, weights=weights).collect())
    assert got == want


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, None: 0.5}])
def test_pack_carries_deficits(spark, tokenizer, weights):
    """As long as no queue is empty, after any window the sources are within a round and a segment of their target proportions."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), prose(rng, rng.choice([3, 200, 900, 4000]))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    total, sent, left = Counter(), Counter(), Counter()
    pieces = packing.pack(docs.repartition(4), weights=weights).collect()
    for r in pieces:
        total[r["source"]] += r["length"]
    left.update(total)
    quantum = {s: 1024 * (weights[s] / sum(weights.values()) if weights else n / sum(total.values())) for s, n in total.items()}
    windows = 0
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        sent[r["source"]] += r["length"]
        left[r["source"]] -= r["length"]
        if min(left.values()) < 1024:
            break
        turns = {s: sent[s] / q for s, q in quantum.items()}
        for a in turns:
            for b in turns:
                assert abs(turns[a] - turns[b]) <= 1 + 1024 / quantum[a] + 1024 / quantum[b]
        windows = r["sequence_id"]
    assert windows > 20


def test_pack_many_sources(spark, tokenizer):
    rows = [(i, f"s{i % 2000}", "some words of a short document " * 8) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pieces = packing.pack(docs).collect()
    assert len(pieces) <= 2500 + sum(r["length"] for r in pieces) // 1024 + 1
    assert sum(r["length"] for r in pieces) == sum(len(ids_of(tokenizer, t)) for _, _, t in rows)


def test_pack(spark, tokenizer):
    docs = documents(spark)
    pieces = packing.pack(docs.repartition(3))
    got, want = packing.digest(pieces).collect(), Counter()
    by = defaultdict(list)
    for r in docs.collect():
        by[r["doc_id"]].append(ids_of(tokenizer, r["text"]))
    for doc, copies in by.items():
        own = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(map(len, copies))
        for r in own:
            ids = copies[0] if len({tuple(c) for c in copies}) == 1 else next(c for c in copies if len(c) == r["doc_tokens"])
            assert r["doc_tokens"] == len(ids)
            want[zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())] += 1
        if len(copies) == 1:
            assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
    assert want == Counter(r["ids_crc32"] for r in got)
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    total = sum(r["length"] for r in got)
    for k, parts in windows.items():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()]
        assert sum(n for _, n in parts) == min(1024, total - 1024 * k)
    # a document lies in few pieces
    assert all(n <= 2 * (-(-max(r["doc_tokens"] for r in got if r["doc_id"] == d) // 1024)) * len(by[d]) for d, n in Counter(r["doc_id"] for r in got).items())


def test_sequences(spark):
    docs = documents(spark, n=5)
    pieces = packing.pack(docs)
    rows = packing.sequences(pieces).collect()
    assert sum(len(r["ids"]) for r in rows) == 2 * sum(r["length"] for r in pieces.collect())
    assert packing.pack(empty(spark)).count() == 0


# ---- WARC


def pages(spark):
    body = "<p>" + "é" * 50 + "\r\n\r\nx</p>"
    rows = [(1, "http://a/\r\nb", body), (2, None, body), (3, "u", None), (4, "u", ""), (None, "u", body), (7, "u", "WARC/1.1\r\n\r\n"), (5, "u", "one"), (5, "u", "one"), (6, "u", "x" * 3_000_000)]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, record_id int, payload string")


def test_warc(spark):
    got = warc.archive_round_trip(pages(spark)).collect()
    best = {}
    for r in pages(spark).collect():
        best[r["html"] or ""] = max(best.get(r["html"] or "", -1), -1 if r["page_id"] is None else r["page_id"])
    assert len(got) == 9
    for r in pages(spark).collect():
        own = [g for g in got if g["page_id"] == r["page_id"]]
        b = (r["html"] or "").encode()
        for g in own:
            assert g["payload_bytes"] == len(b) and g["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        if r["page_id"] == 5:
            assert sorted((g["record_type"], g["refers_to"]) for g in own) == [("response", None), ("revisit", 5)]
        elif r["page_id"] == best[r["html"] or ""]:
            assert [(g["record_type"], g["refers_to"]) for g in own] == [("response", None)]
        else:
            assert [(g["record_type"], g["refers_to"]) for g in own] == [("revisit", best[r["html"] or ""])]


def test_warc_files(spark, tmp_path):
    warc.write_archive(warc.crawl_records(pages(spark)), str(tmp_path / "crawl"))
    warc.deduplicate(spark, str(tmp_path / "crawl"), str(tmp_path / "fresh"), least_bytes=5)
    found = [x for p in (tmp_path / "fresh").glob("part-*") for x in warc.records(gzip.decompress(p.read_bytes()))]
    assert Counter(h["warc-type"] for h, _ in found) == {"response": 7, "revisit": 2}
    assert len({h["warc-record-id"] for h, _ in found}) == 9
    for h, block in found:
        assert h["warc-block-digest"] == "sha1:" + warc.digest(block)
        assert ("warc-refers-to" in h) == (h["warc-type"] == "revisit")


def test_warc_rolls_over_by_bytes_and_hot_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROW_BYTES", 2000)
    monkeypatch.setattr(warc, "HOT", 3)
    rows = [(i, "u", "same page" if i % 2 else f"page {i} " * 50) for i in range(200)]
    warc.write_archive(warc.crawl_records(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), str(tmp_path / "crawl"))
    assert len(list((tmp_path / "crawl").glob("part-*"))) > 4
    warc.deduplicate(spark, str(tmp_path / "crawl"), str(tmp_path / "fresh"))
    got = {r["page_id"]: r["refers_to"] for r in warc.resolved(spark, str(tmp_path / "fresh")).collect()}
    assert got == {i: 199 if i % 2 and i != 199 else None for i in range(200)}


def test_warc_damage():
    whole = warc.record({"record_type": "response", "record_id": "r", "date": "d", "uri": "u", "payload_digest": "x", "payload_bytes": 1, "payload": b"1", "page_id": None, "refers_to": None}) + b"\r\n\r\n"
    assert len(list(warc.records(whole * 3))) == 3
    assert len(list(warc.records(gzip.compress(whole) * 2))) == 2
    with pytest.raises(ValueError):
        list(warc.records(whole[:-9]))


def test_warc_empty(spark):
    assert warc.archive_round_trip(pages(spark).limit(0)).count() == 0


# ---- JPEG


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=700))
def test_jpeg_round_trip(data):
    data = data.ljust(-(-len(data) // 64) * 64, b"\0")
    (f,) = jpeg.frames(jpeg.encode(data))
    assert jpeg.luminance(f).tobytes() == data
    dc, wide = jpeg._sequential(f, 1, 1)  # the same scan bit by bit
    assert np.array_equal(dc + 128, np.frombuffer(data, np.uint8)) and wide == 64


def test_jpeg_many_pictures():
    data = np.random.default_rng(1).integers(0, 256, 64 * jpeg.MOST_ROWS + 640, np.uint8).tobytes()
    parts = list(jpeg.frames(jpeg.encode(data)))
    assert len(parts) == 2 and b"".join(jpeg.luminance(f).tobytes() for f in parts) == data


def colour_jpeg(levels, cb, ac, restart):
    """A 4:2:0 picture of 16 x 16 units with AC coefficients: levels holds four luminance levels for each unit."""
    table = bytes([0, 0, 0, 0, 0, 0, 0, 12] + [0] * 8) + bytes(range(12))  # category c is code c of 8 bits
    run = bytes([0, 0, 3] + [0] * 13) + bytes([0x00, 0x12, 0xF0])  # EOB 000, (1, 2) 001, sixteen zeros 010
    bits, out, last = "", b"", [0, 0, 0]

    def flush(s):
        s += "1" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") if s else b""

    def block(k, level):
        d, last[k] = level - last[k], level
        c = abs(d).bit_length()
        s = f"{c:08b}" + (f"{d if d >= 0 else d + (1 << c) - 1:0{c}b}" if c else "")
        return s + ("001" + "10") * ac + "010" * ac + "000"

    for i, unit in enumerate(levels):
        if restart and i and not i % restart:
            out += flush(bits) + bytes([0xFF, 0xD0 + (i // restart - 1) % 8])
            bits, last = "", [0, 0, 0]
        bits += "".join(block(0, v) for v in unit) + block(1, cb) + block(2, -cb)
    seg = jpeg._segment
    return (
        b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 4] + [1] * 63)) + seg(0xC0, struct.pack(">BHHB", 8, 16, 16 * len(levels), 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + seg(0xC4, b"\x00" + table + b"\x10" + run) + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + out + flush(bits) + b"\xff\xd9"
    )


@pytest.mark.parametrize(("ac", "restart"), [(0, 0), (1, 0), (1, 2), (0, 1)])
def test_jpeg_colour(ac, restart):
    levels = np.random.default_rng(2).integers(-200, 200, (5, 4))
    (f,) = jpeg.frames(colour_jpeg(levels.tolist(), 7, ac, restart))
    want = np.concatenate([unit.reshape(2, 2) for unit in levels], axis=1)
    assert np.array_equal(jpeg.luminance(f), np.clip((want * 4 + 4) // 8 + 128, 0, 255))


def test_jpeg_with_a_scan_for_each_component():
    data = np.random.default_rng(3).integers(0, 256, 64, np.uint8).tobytes()
    grey, other = jpeg.encode(data), jpeg.encode(bytes(reversed(data)))
    frame, scan = grey.index(b"\xff\xc0"), grey.index(b"\xff\xda")
    (height, width), name = struct.unpack_from(">HH", grey, frame + 5), grey[frame + 10]
    head = jpeg._segment(0xC0, struct.pack(">BHHB", 8, height, width, 2) + bytes([name, 0x11, 0, name + 1, 0x11, 0]))
    (size,) = struct.unpack_from(">H", grey, frame + 2)
    later = other[other.index(b"\xff\xda") : -2]
    later = later[:5] + bytes([name + 1]) + later[6:]
    again = jpeg._segment(0xDB, bytes([0, 9] + [1] * 63))
    (f,) = jpeg.frames(grey[:frame] + head + grey[frame + 2 + size : -2] + again + later + b"\xff\xd9")
    assert scan > frame and jpeg.luminance(f).tobytes() == data


def test_media(spark):
    docs = documents(spark)
    got = jpeg.media_columns(jpeg.store_media(docs)).collect()
    want = Counter()
    for r in docs.collect():
        b = (r["text"] or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want[r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    same = defaultdict(set)
    for r in got:
        same[r["payload_sha256"]].add((r["feature"], r["media_sha256"], r["media_bytes"]))
    assert all(len(v) == 1 for v in same.values())
    assert jpeg.media_columns(jpeg.store_media(empty(spark))).count() == 0


def test_damaged_media(spark):
    good = jpeg.encode(bytes(range(64)))
    rows = [(1, 64, good), (2, 64, good[:40]), (3, 0, b""), (4, 9, b"not a jpeg"), (5, None, None), (6, 64, good.replace(b"\xff\xc0", b"\xff\xc2"))]
    got = {r["doc_id"]: r for r in jpeg.media_columns(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == 6 and got[1]["payload_bytes"] == 64
    assert all(got[i]["payload_bytes"] is None and got[i]["feature"] is None for i in range(2, 7))
    assert got[4]["media_bytes"] == 10 and got[5]["media_bytes"] is None


# ---- n-gram join


def brute(rows, k=4, percent=85):
    sets, at = {}, {}
    for i, r in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))) if words else frozenset()
        at[i] = i

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in sets:
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                at[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            best[find(i)] = min(best.get(find(i), r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], len(sets[i]), best.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("frequent", [32, 2])
def test_near_copies(spark, monkeypatch, frequent):

    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join.frequent_shingles, "__defaults__", (frequent, ngram_join.MOST_FREQUENT))
    rng = random.Random(8)
    passage, extra = prose(rng, 60), []
    for _ in range(25):  # a shared passage with a little or a lot around it
        extra.append(prose(rng, rng.choice([2, 4, 6, 9, 14, 120])) + " " + passage)
    short = prose(rng, 14).split()
    extra += [" ".join(short[: rng.randint(5, 14)]) for _ in range(20)]
    chain = prose(rng, 100).split()
    extra += [" ".join(chain[i : i + 60]) for i in range(0, 40, 2)]
    docs = documents(spark, extra=extra)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(docs.repartition(3)).collect())
    assert got == brute(docs.collect())


@pytest.mark.parametrize(("name_bits", "percent"), [(64, 85), (3, 85), (64, 60)])
def test_near_copies_of_very_frequent_shingles(spark, monkeypatch, name_bits, percent):

    monkeypatch.setattr(ngram_join, "VERY_FREQUENT", 4)
    monkeypatch.setattr(ngram_join, "NAME_BITS", name_bits)
    monkeypatch.setattr(ngram_join.frequent_shingles, "__defaults__", (2, 300))
    rng = random.Random(9)
    words, extra = [prose(rng, 1) + str(i) for i in range(70)], []
    for _ in range(40):  # copies of one text that differ more or less
        own = list(words)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(["x", "y", f"z{rng.randrange(9)}"])
        extra.append(" ".join(own))
    docs = documents(spark, n=20, extra=extra)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(docs.repartition(3), percent=percent).collect())
    assert got == brute(docs.collect(), percent=percent)


def test_near_copies_empty(spark):
    assert ngram_join.near_copies(empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 120), st.integers(0, 20), st.integers(0, 2**32), st.floats(0, 1))
def test_signatures_miss_no_partner(n, changed, seed, often):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**63, n, np.uint64))
    frequent = np.sort(base[rng.random(len(base)) < often])
    other = np.unique(np.concatenate([rng.permutation(base)[changed:], rng.integers(0, 2**63, int(rng.integers(0, changed + 1)), np.uint64)]))
    shared = len(np.intersect1d(base, other))
    if shared and 100 * shared >= 85 * (len(base) + len(other) - shared):
        assert ngram_join.may_link(ngram_join.bitmap(base), ngram_join.bitmap(other), len(base), len(other), 85)
        a, b = (ngram_join.signatures(x, frequent) for x in (base, other))
        assert len(np.intersect1d(a, b))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 150), st.integers(0, 40), st.integers(0, 2**32), st.floats(0, 1), st.floats(0, 1), st.sampled_from([50, 80, 85]))
def test_signatures_and_their_bound_miss_no_partner(n, changed, seed, often, top, percent):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**63, n, np.uint64))
    other = np.unique(np.concatenate([rng.permutation(base)[changed:], rng.integers(0, 2**63, int(rng.integers(0, changed + 1)), np.uint64)]))
    every = np.union1d(base, other)
    frequent = every[rng.random(len(every)) < often]
    very = frequent[rng.random(len(frequent)) < top]
    shared = len(np.intersect1d(base, other))
    if shared and 100 * shared >= percent * (len(base) + len(other) - shared):
        found = []
        for x in (base, other):
            sig, single, rare = ngram_join.split_signatures(x, frequent, percent, very)
            found.append({s: len(x) - (0 if i < single else rare) for i, s in enumerate(sig.tolist())})
        assert any(100 * m >= percent * (len(base) + len(other) - m) for m in (min(found[0][s], found[1][s]) for s in found[0].keys() & found[1].keys()))
