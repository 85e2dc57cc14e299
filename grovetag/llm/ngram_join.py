"""Jaccard self-join on word shingles with token-combination prefixes.

Tokens are the hashes of k-word shingles, ordered rare ones first, then frequent ones, then very
frequent ones, and by hash within these. Two sets can only reach the threshold if they share tokens in their
prefixes. A rare token is a signature by itself. Tokens that many documents
hold form classes that need a shared pair, and very frequent ones classes that need a shared
triple: a class of the prefix with n tokens counts n - 1 (n - 2) towards the length the prefix must
reach, so the prefix is extended, and its signatures are the pairs (triples) within a class. (With fewer
shared tokens in each class and no shared rare token, the prefix alone has more unshared tokens than
the threshold allows.) The number of classes follows the size of the set, in
powers of two; sets whose partners may fall in the next step use both steps.

A set with signatures of frequent tokens has all its rare tokens among its signatures. So a pair that
meets in a frequent signature alone shares no rare token, and its sets have at most as many tokens in
common as the one with fewer frequent tokens has of them. Pairs that can't reach the threshold so are never made:
copies of one text that differ too much from each other leave the group by this.

Signatures are range-partitioned by (signature, rare tokens, set), so a frequent one runs over many
partitions. A scan of the sorted rows pairs each set with the first set of its
signature, the one with the fewest tokens of its own; these pairs are verified on the whole sets (after a
look at bitmaps, which excludes most of those that aren't linked, and none that is) and give components. Only where a
signature still holds several components, the pairs across them are verified as well. So
no link that could join two components is missed, and groups of near copies cost a
few pairs a set, not all pairs.

Which shingles are frequent is counted over all documents and told by Bloom filters of bounded size. They may call a rare shingle
frequent, alike for all sets, which changes the cost and no result; so no number of frequent shingles is too large.
Shingles are 64-bit hashes, sets are named by 64 bits of a 128-bit hash; where two sets have one name
the other 64 bits give them new ones. Equal sets are one node from the start.

Cases: null, empty or blank texts have no shingles and are linked with nothing; texts with
fewer than k words have their whole word sequence as one shingle; repeated rows are copies; a
null doc_id takes part, but smallest doc_ids ignore it; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored, text_or_empty, tidy
from .components import components
from .shingles import mixed, shingles

WORDS = 4
PERCENT = 85
#: Documents from which a shingle counts as frequent and as very frequent, and shingles that a task counts at a time, on average, in as many groups as needed (MOST_GROUPS at most).
FREQUENT = 32
VERY_FREQUENT = 1024
MOST_FREQUENT = 1 << 21
MOST_GROUPS = 1 << 18
#: Bits of the filters of frequent shingles for each of these, and the most bits of a filter.
BITS_A_SHINGLE = 16
MOST_BITS = 1 << 28
#: Bits of a set's name.
NAME_BITS = 64
#: Shingles that a task deals to the groups at a time.
CHUNK = 1 << 20
#: Rows that a task works on at a time.
ROWS = 500
#: Bits of the filter of the documents whose sets are wanted.
FILTER_BITS = 1 << 24
#: Texts (or sets) that a task remembers to have seen.
SEEN = 300_000

_ONE, _TWO, _THREE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


class Bloom:
    """A filter of 64-bit hashes, without their last `drop` bits, with three bits each; `bits` is a power of two."""

    SHIFTS = (0, 18, 36)

    def __init__(self, bits: int, drop: int = 0):
        self.bits, self.drop, self.held = bits, drop, np.zeros(bits // 8, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        """keys: hashes without their last bits."""
        keys = mixed(keys)
        for shift in self.SHIFTS:
            at = keys >> np.uint64(shift) & np.uint64(self.bits - 1)
            np.bitwise_or.at(self.held, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        keys, out = mixed(hashes >> np.uint64(self.drop)), np.ones(len(hashes), bool)
        for shift in self.SHIFTS:
            at = keys >> np.uint64(shift) & np.uint64(self.bits - 1)
            out &= (self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out


def bloom_of(keys: DataFrame, bits: int, drop: int = 0) -> Bloom:
    """The filter of a table's first column; at most `bits` bits go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(np.uint64))
        step = 1 << 12
        for i in range(0, len(own.held), step):
            if (part := own.held[i : i + step]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, np.uint8)
                held[i] = held[i] | part if i in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], names=["at", "part"])

    out = Bloom(bits, drop)
    for r in keys.mapInArrow(run, "at int, part binary").repartition("at").mapInArrow(merge, "at int, part binary").collect():
        out.held[r["at"] : r["at"] + len(r["part"])] |= np.frombuffer(bytes(r["part"]), np.uint8)
    return out


def frequent_shingles(docs: DataFrame, k: int, frequent: int = FREQUENT, most: int = MOST_FREQUENT) -> tuple[Bloom, Bloom]:
    """Filters of the shingles that at least `frequent` and VERY_FREQUENT documents hold, equal texts counted once a task.

    All shingles are counted, by their first bits: the leading ones tell the group that a shingle is dealt to, and the 32 bits behind them go there,
    four bytes a shingle. Groups are sorted and counted one at a time. Shingles that share these bits count as one.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lead = min(MOST_GROUPS.bit_length() - 1, (size // 6 // most).bit_length())  # 6 bytes a word or more
    groups, drop = 1 << lead, 32 - lead

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = set(), [], 0
        edges = np.arange(1, groups, dtype=np.uint64) << np.uint64(64 - lead) if lead else np.empty(0, np.uint64)

        def rows() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            low = (keys >> np.uint64(drop)).astype(np.uint32)
            cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            full = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([low[cuts[g] : cuts[g + 1]].tobytes() for g in full.tolist()], pa.binary())], names=["part", "low"])

        for batch in slices(batches, ROWS):
            fresh = []
            for text in batch.column(0).to_pylist():
                name = xxhash.xxh3_64_intdigest(text)
                if name not in seen:
                    fresh.append(text)
                    if len(seen) < SEEN:
                        seen.add(name)
            for tokens in shingles(fresh, k):
                held.append(tokens)
                n += len(tokens)
                if n >= CHUNK:
                    yield rows()
                    held, n = [], 0
        if n:
            yield rows()

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []

        def rows() -> pa.RecordBatch:
            low = np.sort(np.frombuffer(b"".join(held), np.uint32))
            start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            n = np.diff(np.append(start, len(low)))
            many = n >= frequent
            keys = low[start[many]].astype(np.uint64) | np.uint64(part << 32)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[many])], names=["token", "n"])

        for batch in batches:
            for g, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if g != part:
                    if held:
                        yield rows()
                    part, held = g, []
                held.append(low)
        if held:
            yield rows()

    dealt = docs.select(text_or_empty().alias("text")).mapInArrow(deal, "part int, low binary")
    often = stored(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, "token long, n long"), "join-frequent")
    out = []
    for least in (frequent, VERY_FREQUENT):
        own = often.where(F.col("n") >= least).select("token")
        out.append(bloom_of(own, min(MOST_BITS, max(1 << 16, 1 << (BITS_A_SHINGLE * own.count()).bit_length())), drop))
    discard(often)
    return tuple(out)


def level(n: int) -> int:
    return 0 if n < 3 else 1 if n < 16 else n.bit_length() - 3


def _told(tokens: np.ndarray, which: Bloom | np.ndarray | None) -> np.ndarray:
    if which is None or not len(tokens):
        return np.zeros(len(tokens), bool)
    return which.has(tokens) if isinstance(which, Bloom) else np.isin(tokens, which)


def signatures(tokens: np.ndarray, frequent: Bloom | np.ndarray, percent: int = PERCENT, very: Bloom | np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set of sorted tokens."""
    return split_signatures(tokens, frequent, percent, very)[0]


def split_signatures(tokens: np.ndarray, frequent: Bloom | np.ndarray, percent: int = PERCENT, very: Bloom | np.ndarray | None = None) -> tuple[np.ndarray, int, int]:
    """The signatures of a set of sorted tokens, how many of them (the first ones) are rare tokens, and how many rare tokens the set has if it has other signatures, else 0."""
    n = len(tokens)
    if not n:
        return tokens, 0, 0
    need = n + percent * n // -100 + 1  # one more than the tokens that a partner may lack
    often = _told(tokens, frequent)
    rare = tokens[~often]
    if len(rare) >= need:
        return rare[:need], need, 0
    need -= len(rare)
    heavy, out = tokens[often], []
    top = _told(heavy, very)
    heavy, top = np.concatenate([heavy[~top], heavy[top]]), np.sort(top)
    for lv in {level(n), level(n * 100 // percent)}:
        if not lv:
            out.append(heavy[:need])
            continue
        # classes of pairs, then classes of triples, half as many
        triple = top if lv > 1 else np.zeros(len(heavy), bool)
        classes = np.where(triple, (1 << lv) + ((heavy >> np.uint64(7)) % np.uint64(1 << max(0, lv - 2))).astype(np.int64), ((heavy >> np.uint64(7)) % np.uint64(1 << (lv - 1))).astype(np.int64))
        order = np.argsort(classes, kind="stable")
        own = classes[order]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
        place = np.empty(len(heavy), np.int64)  # within the class
        place[order] = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        stop = int(np.searchsorted(np.cumsum(place >= 1 + triple), need)) + 1  # the first tokens of a class add nothing
        kept, own, three = heavy[:stop], classes[:stop], triple[:stop]
        order = np.argsort(own, kind="stable")
        kept, own, three = kept[order], own[order], three[order]
        for gap in range(1, len(kept)):
            same = own[gap:] == own[:-gap]
            if not same.any():
                break
            two = same & ~three[gap:]
            out.append(mixed(kept[:-gap][two] * _ONE + kept[gap:][two] * _TWO + np.uint64(lv)))
            if three.any():
                for more in range(1, len(kept) - gap):
                    far = same[:-more] & (own[gap + more :] == own[: -gap - more]) & three[gap + more :]
                    if not far.any():
                        break
                    out.append(mixed(kept[: -gap - more][far] * _ONE + kept[gap:-more][far] * _TWO + kept[gap + more :][far] * _THREE + np.uint64(lv)))
    return np.concatenate([rare, np.unique(np.concatenate(out))]), len(rare), len(rare)


def bitmap(tokens: np.ndarray) -> bytes:
    """Which of 2 to 4 times as many cells as there are tokens are hit, the cell being the token's low bits."""
    bits = np.zeros(max(64, 1 << (2 * len(tokens)).bit_length()), bool)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """Whether sets with these bitmaps can reach the threshold: each cell that one hits and the other doesn't is a token that isn't shared."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, n = 8 * len(a), 8 * len(b)
    while m > n:
        m //= 2
        x = (x >> m) | (x & ((1 << m) - 1))
    while n > m:
        n //= 2
        y = (y >> n) | (y & ((1 << n) - 1))
    both = x & y
    most = min(na - (x ^ both).bit_count(), nb - (y ^ both).bit_count())
    return 100 * most >= percent * (na + nb - most)


def set_name(tokens: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """`bits` bits of a set's hash, and 64 others."""
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return d & (1 << bits) - 1, d >> 64


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def sets_with_signatures(docs: DataFrame, k: int, percent: int, frequent: tuple[Bloom, Bloom]) -> DataFrame:
    """doc_id, set and check (two hashes of the set), n, its bitmap, its signatures, how many of them are rare tokens and how many rare tokens it has."""
    kind = dict(docs.dtypes)["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(frequent)  # 2 * MOST_BITS bits at most
    name_bits = NAME_BITS

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, very = held.value
        for batch in slices(batches, ROWS):
            names, sizes, bits, parts, first, own = [], [], [], [], [], []
            for tokens in shingles(batch.column(1).to_pylist(), k):
                names.append(set_name(tokens, name_bits))
                sizes.append(len(tokens))
                bits.append(bitmap(tokens))
                found, rare, lack = split_signatures(tokens, often, percent, very)
                parts.append(found.view(np.int64))
                first.append(rare)
                own.append(lack)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _longs([a for a, _ in names]), _longs([b for _, b in names]), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), _lists(parts), pa.array(first, pa.int32()), pa.array(own, pa.int32())],
                names=["doc_id", "set", "check", "n", "bits", "signatures", "single", "rare"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, set long, check long, n int, bits binary, signatures array<long>, single int, rare int")


def scan(postings: DataFrame, percent: int) -> DataFrame:
    """Rows (kind, a, b, n, lack) from signatures in order; lack: tokens of the set that no other set of the signature shares, if the pair isn't met elsewhere.

    kind 0: a pair of sets to verify; 1: a posting of a signature with three sets or more (a: signature, b: set, n: its size);
    2: the first and last sets of a partition's edge signatures, to pair up across partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind, a, b, n, lack):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n), pa.array(lack)], names=["kind", "a", "b", "n", "lack"])

        rest = None  # the last signature so far: its hash, first set with n and lack, last set, and number of rows
        edges = []
        for batch in batches:
            sig, ids, n, lack = (batch.column(i).to_numpy() for i in range(4))
            if not len(sig):
                continue
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(start, len(sig)))
            group = np.repeat(np.arange(len(start)), size)
            center, cn, cl = ids[start], n[start].astype(np.int64), lack[start].astype(np.int64)
            place, total = np.arange(len(sig)) - start[group], size[group]
            if carried := rest is not None and rest[0] == sig[0]:
                center[0], cn[0], cl[0] = rest[1]
                place[: size[0]] += rest[3]
                total[: size[0]] += rest[3]
            most = np.minimum((cn - cl)[group], n - lack)  # tokens in common
            pair = (place > 0) & (100 * most >= percent * (cn[group] + n - most))
            none = np.zeros(pair.sum(), np.int32)
            yield rows(0, center[group][pair], ids[pair], none, none)
            many = total > 2
            many[start[-1] :] = True  # it may go on
            if rest is None:
                many[: size[0]] = True  # it may have begun in another partition
                edges.append((int(sig[0]), int(ids[0])))
            yield rows(1, sig[many], ids[many], n[many], lack[many])
            going = carried and len(start) == 1
            rest = (int(sig[-1]), (int(center[-1]), int(cn[-1]), int(cl[-1])), int(ids[-1]), int(size[-1]) + (rest[3] if going else 0))
        if rest is not None:
            edges.append((rest[0], rest[1][0]))
            edges.append((rest[0], rest[2]))
            a, b = np.array(edges, np.int64).T
            none = np.zeros(len(a), np.int32)
            yield rows(2, a, b, none, none)

    ordered = postings.repartitionByRange("signature", "lack", "set").sortWithinPartitions("signature", "lack", "set")
    return ordered.select("signature", "set", "n", "lack").mapInArrow(run, "kind int, a long, b long, n int, lack int")


def whole_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """(set, tokens) of the wanted sets, made again from the texts of the documents that stand for them. A few others may be among them, and a set may come once from each of several tasks where rows repeat. renamed: names of the sets whose own name is another's as well."""
    ids = [F.xxhash64("doc_id").alias("id")]
    named = stored(wanted.select("set").distinct().join(nodes.select("set", "doc_id"), "set").select(*ids), "join-wanted")
    held = docs.sparkSession.sparkContext.broadcast(bloom_of(named, FILTER_BITS))  # if it is too full, more documents pass and none is missed
    discard(named)
    name_bits = NAME_BITS

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, seen = held.value, set()
        for batch in slices(batches, ROWS):
            hit = pa.array(filter_.has(batch.column(1).to_numpy().view(np.uint64)))
            names, parts = [], []
            for tokens in shingles(batch.column(0).filter(hit).to_pylist(), k):
                both = set_name(tokens, name_bits)
                if both not in seen:
                    if len(seen) < SEEN:
                        seen.add(both)
                    names.append(renamed.get(both, both[0]))
                    parts.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([_longs(names), _lists(parts)], names=["set", "tokens"])

    return docs.select(text_or_empty().alias("text"), *ids).mapInArrow(run, "set long, tokens array<long>")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    own = nodes.select("set", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            na, ba, nb, bb = (batch.column(c).to_pylist() for c in ("na", "ba", "nb", "bb"))
            keep = pa.array([may_link(*x, percent) for x in zip(ba, bb, na, nb, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    tried = pairs.join(own.toDF("a", "na", "ba"), "a").join(own.toDF("b", "nb", "bb"), "b").where(100 * F.least("na", "nb").cast("long") >= percent * F.greatest("na", "nb").cast("long"))
    fits = stored(tried.mapInArrow(run, "a long, b long"), "join-pairs")
    sets = stored(whole_sets(docs, nodes, fits.select(F.explode(F.array("a", "b")).alias("set")), k, renamed), "join-sets")
    both = fits.join(sets.toDF("b", "tb"), "b").join(sets.toDF("a", "ta"), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    links = stored(both.where(100 * shared.cast("long") >= percent * (F.size("ta") + F.size("tb") - shared).cast("long")).select("a", "b"), "join-links")
    discard(sets, fits)
    return links


def _renamed(named: DataFrame) -> dict[tuple[int, int], int]:
    """New names of the sets (set, check) that share a name with another: about the square of the number of sets over 2^65 of them."""
    twice = named.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.collect_list("check").alias("checks")).where("n > 1")
    out = {}
    for r in twice.collect():
        for check in r["checks"]:
            both = r["set"] & (1 << 64) - 1, check & (1 << 64) - 1
            out[both] = xxhash.xxh3_64_intdigest(b"%d %d" % both)
    return out


def near_copies(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each document; percent: 50 at least."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    spark = docs.sparkSession
    found = frequent_shingles(docs, k)
    sets = stored(sets_with_signatures(docs, k, percent, found), "join-signatures")
    full = sets.where("n > 0").groupBy("set", "check").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("signatures").alias("signatures"), F.first("single").alias("single"), F.first("rare").alias("rare"))
    full = stored(full, "join-full")
    members = stored(sets.select("doc_id", "set", "check", "n"), "join-members")
    discard(sets)
    renamed = _renamed(full.select("set", "check"))
    full_, members_ = full, members
    if renamed:
        new = F.broadcast(spark.createDataFrame([(*(x - (1 << 64) if x >> 63 else x for x in both), name - (1 << 64) if name >> 63 else name) for both, name in renamed.items()], "set long, check long, name long"))
        full_, members_ = (t.join(new, ["set", "check"], "left").withColumn("set", F.coalesce("name", "set")).drop("name") for t in (full, members))
    nodes = stored(full_.select("set", "doc_id", "n", "bits"), "join-nodes")
    postings = full_.select("set", "n", "single", "rare", F.posexplode("signatures").alias("at", "signature"))
    scanned = stored(scan(postings.select("signature", "set", "n", F.when(F.col("at") < F.col("single"), 0).otherwise(F.col("rare")).alias("lack")), percent), "join-scan")
    discard(full)

    # two or three rows of each partition: sets of one signature that continues in another partition
    edges: dict[int, set[int]] = {}
    for r in scanned.where("kind = 2").select("a", "b").distinct().collect():
        edges.setdefault(r["a"], set()).add(r["b"])
    across = [(min(g), x) for g in edges.values() for x in g if x != min(g)]
    pairs = scanned.where("kind = 0").select("a", "b")
    if across:
        pairs = pairs.union(spark.createDataFrame(across, "a long, b long"))
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "join-tried")
    links = verified(pairs, docs, nodes, k, percent, renamed)
    joined = components(links)

    # signatures that still hold several components: the pairs across them that can reach the threshold
    postings = scanned.where("kind = 1").select(F.col("a").alias("signature"), F.col("b").alias("set"), "n", "lack").join(joined.withColumnRenamed("id", "set"), "set", "left")
    postings = stored(postings.select("signature", "set", "n", (F.col("n") - F.col("lack")).alias("most"), F.coalesce("component", "set").alias("component")), "join-postings")
    discard(scanned)
    mixed = postings.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("signature")
    left = postings.join(mixed, "signature")
    a, b = left.toDF("signature", "a", "na", "ma", "ca"), left.toDF("signature", "b", "nb", "mb", "cb")
    most = F.least("ma", "mb").cast("long")
    more = a.join(b, "signature").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & (100 * most >= percent * (F.col("na") + F.col("nb") - most)))
    more = stored(more.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "join-more")
    discard(postings)
    if more.limit(1).count():
        joined = components(links.union(verified(more, docs, nodes, k, percent, renamed)))

    owner = nodes.select("set", "doc_id").join(joined.withColumnRenamed("id", "set"), "set", "left").select("set", "doc_id", F.coalesce("component", "set").alias("component"))
    smallest = owner.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = stored(owner.join(smallest, "component").select("set", "component_id"), "join-components")
    out = members_.join(final, "set", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last), then the smallest hash of the text, and one of those that repeat in both. Documents without words stay."""
    name = F.xxhash64(text_or_empty())
    key = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", name.alias("name"))
    groups = near_copies(docs.select(key.alias("doc_id"), "text"), k, percent)
    chosen = groups.where("n_shingles > 0").groupBy("doc_id").agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    chosen = stored(chosen.select(F.col("doc_id.doc_id").alias("id__"), F.col("doc_id.name").alias("name__"), (F.col("doc_id") == F.col("component_id")).alias("stays__"), "n"), "join-chosen")
    same = docs["doc_id"].eqNullSafe(F.col("id__")) & (name == F.col("name__"))
    own = [docs[f"`{c}`"] for c in docs.columns]
    out = docs.join(chosen.where("not stays__"), same, "left_anti").select(*own)
    repeated = chosen.where("stays__ and n > 1")
    if not repeated.limit(1).count():
        return out
    record = F.struct(*own).alias("record__")
    once = docs.join(repeated.select("id__", "name__"), same).select("id__", "name__", record).groupBy("id__", "name__").agg(F.first("record__").alias("record__"))
    return out.join(repeated, same, "left_anti").select(*own).union(once.select("record__.*"))
