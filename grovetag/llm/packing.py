"""Mixture-controlled packing of token streams into fixed windows.

Each source is a queue of its documents' ids, in segments of at most `segment` tokens (a document that is no longer
is one segment). Deficit round-robin serves the queues: in each round a source's
deficit grows by its quantum, its share of a window by the target weights, and the source sends
segments from the head of its queue while the deficit covers them; what is left is carried
to the next round, over windows and partitions alike. The stream of segments is cut into windows, all full but the last.

As a queue that holds segments is served in each round, the round of a segment follows from its place in the queue alone: the first round whose
quanta, together with the deficit at the start, reach the segment's end. So no task waits for
another: rounds are dealt to buckets, a bucket's segments are sorted by round and source, and
its place in the stream is the sum of the buckets before it. A source starts with a
deficit given by its hash, below its first segment's size, so that many sources of one document each
are spread over the rounds. After any round a source is within one segment of its quanta; when its queue is empty,
the others go on by their weights.

Cases: a null text is the empty text (only the end id); a null source is a source; repeated
rows are separate documents; very long documents run over many windows; sources that the weights don't
name weigh 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running, slices, stored, text_or_empty, tidy

WINDOW = 1024
END_ID = 0
SPECIAL = "<|endoftext|>"
#: Chunks that a worker remembers the ids of, texts that it works on at a time, pieces whose digests it works out at a time.
MEMO = 200_000
ROWS, PIECES = 500, 2000
#: Tokens of a bucket of rounds.
BUCKET_TOKENS = 4 << 20


class Encoder:
    """Ids of texts as little-endian uint16, with a memo of what stands between two spaces.

    The pre-tokenizer always starts a token at a single space between two other
    characters that aren't white space, so the ids of a text are those of its chunks
    (each with the space before it). Texts with other runs of white space after a space
    are encoded whole.
    """

    _odd = re.compile(r" (?:\s|\Z)")

    def __init__(self, vocabulary: str, most: int = MEMO):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        # the one special token of the vocabulary follows its ranks; as in the tokenizers library its string in a text is that token
        encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        self._encode, self._encode_all = encoding.encode_ordinary, encoding.encode
        encode = self.whole

        class Memo(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = encode(" " + chunk)
                if len(self) < most and len(chunk) < 64:
                    self[chunk] = ids
                return ids

        self._memo = Memo()

    def whole(self, text: str) -> bytes:
        return array("H", self._encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return array("H", self._encode_all(text, allowed_special={SPECIAL})).tobytes()
        if self._odd.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self._memo.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One per worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenised(docs: DataFrame, vocabulary: str, segment: int = WINDOW) -> DataFrame:
    """Segments: doc_id, source, block, start (within the block's part of the source's queue), at (within the document), n, doc_tokens and ids, the end id included."""
    kind = dict(docs.dtypes)
    schema = f"doc_id {kind['doc_id']}, source {kind['source']}, block int, start long, at long, n int, doc_tokens long, ids binary"
    end = END_ID.to_bytes(2, "little")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, queued = encoder(vocabulary), TaskContext.get().partitionId(), {}
        for batch in slices(batches, ROWS):
            row, starts, ats, sizes, totals, parts = [], [], [], [], [], []
            for i, (source, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                ids = encode(text) + end
                n, before = len(ids) // 2, queued.get(source, 0)
                queued[source] = before + n
                for at in range(0, n, segment):
                    row.append(i)
                    starts.append(before + at)
                    ats.append(at)
                    sizes.append(min(segment, n - at))
                    totals.append(n)
                    parts.append(ids[2 * at : 2 * (at + segment)])
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array([block] * len(row), pa.int32()), pa.array(starts, pa.int64()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int32()), pa.array(totals, pa.int64()), pa.array(parts, pa.binary())],
                names=["doc_id", "source", "block", "start", "at", "n", "doc_tokens", "ids"],
            )

    return docs.select("doc_id", "source", text_or_empty().alias("text")).mapInArrow(run, schema)


def quanta(sizes: DataFrame, tokens: int, window: int = WINDOW, segment: int = WINDOW, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(source, quantum, phase) from (source, total): what a source's deficit grows by in a round, and what it starts with. Without weights the target is each source's share of all tokens, so that the queues end together."""
    if weights is None:
        share = F.col("total") / F.lit(float(max(1, tokens)))
    else:
        if not all(w > 0 for w in weights.values()):
            raise ValueError("weights must be positive")
        named = [x for s, w in weights.items() if s is not None for x in (F.lit(s), F.lit(float(w)))]
        weight = F.coalesce(F.create_map(*named)[F.col("source")], F.lit(1.0)) if named else F.lit(1.0)
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 1.0)))).otherwise(weight)
        sizes = sizes.withColumn("weight", weight)
        share = F.col("weight") / F.lit(float(sizes.agg(F.sum("weight")).first()[0] or 1))
    return sizes.select("source", (share * window).alias("quantum"), F.pmod(F.xxhash64("source"), F.least("total", F.lit(segment))).alias("phase"))


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, weights: dict[str | None, float] | None = None, segment: int | None = None) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids (uint16), doc_tokens, sequence_id, offset. weights: target proportions by source, those of the documents by default."""
    segment = segment or window
    tokens = stored(tokenised(docs, vocabulary or default_vocabulary(), segment), "pack-tokens")
    blocks = tokens.groupBy("source", "block").agg(F.sum("n").alias("tokens"))
    blocks = stored(blocks, "pack-blocks")
    total = blocks.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    sizes = blocks.groupBy("source").agg(F.sum("tokens").alias("total"))
    own = quanta(sizes, total, window, segment, weights).withColumnRenamed("source", "source_")
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("source", F.col("block").alias("block_"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    bases = stored(bases.join(own, bases["source"].eqNullSafe(own["source_"])).drop("source"), "pack-bases")
    end = F.col("start") + F.col("base") + F.col("n")
    turn = F.greatest(F.lit(1), F.ceil((end - F.col("phase")) / F.col("quantum") - 1e-9)).cast("long")
    queued = tokens.join(bases, (tokens["block"] == bases["block_"]) & tokens["source"].eqNullSafe(bases["source_"]))
    # buckets of rounds: a window of tokens is dealt in a round, as long as no queue is empty
    width = max(1, BUCKET_TOKENS // window)
    queued = queued.select("doc_id", "source", "at", "n", "doc_tokens", "ids", end.alias("end"), turn.alias("turn"), F.floor(turn / width).cast("long").alias("bucket"))
    offsets = running(stored(queued.groupBy("bucket").agg(F.sum("n").alias("tokens")), "pack-buckets"), "bucket", "tokens").withColumnRenamed("bucket", "bucket_")
    sent = Window.partitionBy("bucket").orderBy("turn", F.col("source").asc_nulls_last(), "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = queued.withColumn("upto", F.sum("n").over(sent)).join(offsets, F.col("bucket") == F.col("bucket_"))
    first = F.col("before") + F.col("upto") - F.col("n")
    pieces = placed.select("doc_id", "source", "at", "n", "doc_tokens", "ids", first.alias("first")).withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("first") / window), F.floor((F.col("first") + F.col("n") - 1) / window))))
    low, high = F.greatest("first", F.col("sequence_id") * window), F.least(F.col("first") + F.col("n"), (F.col("sequence_id") + 1) * window)
    pieces = pieces.withColumn("low", low).withColumn("length", (high - low).cast("int"))
    return pieces.select(
        "doc_id", "source", (F.col("at") + F.col("low") - F.col("first")).alias("start"), "length", F.expr("substring(ids, cast(2 * (low - first) as int) + 1, 2 * length)").alias("ids"), "doc_tokens",
        "sequence_id", (F.col("low") - F.col("sequence_id") * window).cast("int").alias("offset"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed windows: sequence_id, ids (uint16, little-endian) and their doc_ids in order. A group holds a window at most."""
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("held"))
    joined = F.aggregate("held", F.encode(F.lit(""), "utf-8"), lambda a, x: F.concat(a, x["ids"]))
    return held.select("sequence_id", joined.alias("ids"), F.col("held.doc_id").alias("doc_ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """pieces with the CRC of the ids as unsigned 32-bit numbers in place of the ids."""
    kind = dict(pieces.dtypes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PIECES):
            ids = batch.column("ids")
            ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4).astype(np.int64) * 2
            base = int(ends[0])
            wide = memoryview(np.frombuffer(ids.buffers()[2] or b"", np.uint16, int(ends[-1] - base) // 4, base // 2).astype("<u4")).cast("B")
            crc = [zlib.crc32(wide[x - base : y - base]) for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("length").cast(pa.int64()), pa.array(crc, pa.int64()), batch.column("doc_tokens"), batch.column("sequence_id"), batch.column("offset").cast(pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset").mapInArrow(run, f"doc_id {kind['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
