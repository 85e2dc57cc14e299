"""WARC archives and the resolution of revisits.

Archives are written by Spark's text sink with the record separator CR LF CR LF as line
separator, gzip-compressed: any file system that Spark reaches, and its commit protocol,
so a lost executor leaves no half-written record. Readers take whole files in, decompress
them piece by piece and follow Content-Length.

Resolution: archive -> headers -> shuffle by payload digest -> the record with the largest
page_id of each digest is the response, the others become revisits that refer to it ->
a new archive with fresh headers. Reading it joins the revisits to their responses.

Cases: null html is the empty payload, which deduplicates like any other; a null page_id is
smaller than all others; of repeated rows (same page_id and payload) one is the
response; CR, LF and other control characters in a URL are percent-encoded; an empty
table gives an empty archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, slices, stored

#: Fixed values of the format.
VERSION = b"WARC/1.1"
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

#: Bytes of records in a row of the text sink (a longer record is a row by itself), and rows of a file: a reader takes whole files.
ROW_BYTES, ROWS_A_FILE = 4 << 20, 8
#: Pages that a task works on at a time.
PAGES = 200
#: Digests with more than a share of 1 / HOT of all records are joined by broadcast: HOT of them at most.
HOT = 1000
RECORD = "record_id string, record_type string, page_id long, uri string, date string, payload_digest string, payload_bytes long, refers_to string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_uri(uri: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in uri or "")


def record(r: dict) -> bytes:
    """The bytes of a record without its final separator; r has the columns of RECORD and payload (None in a revisit)."""
    block = HTTP % r["payload_bytes"] + (r["payload"] if r["record_type"] == "response" else b"")
    head = [
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]),
        ("WARC-Payload-Digest", "sha1:" + r["payload_digest"]), ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", "application/http; msgtype=response"),
    ]
    if r["record_type"] == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", r["refers_to"])]
    if r["page_id"] is not None:
        head.append(("X-Page-Id", str(r["page_id"])))
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"".join(f"\r\n{k}: {v}".encode() for k, v in head) + b"\r\n\r\n" + block


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive file, compressed (one or many members) or not."""
    pieces = _inflated(content) if content[:2] == b"\x1f\x8b" else iter([content])
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends within a record's headers")
                return
        version, *lines = bytes(held[:end]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(head["content-length"])
        while len(held) < stop + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        yield head, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def _inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    z = zlib.decompressobj(31)
    for i in range(0, len(content), step):
        data = content[i : i + step]
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def write_archive(rows: DataFrame, path: str) -> None:
    """rows: the columns of RECORD and payload."""
    between = SEPARATOR.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, PAGES):
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(dict(zip(names, row, strict=True))))
                n += len(held[-1])
                if n >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([between.join(held)], pa.binary())], names=["value"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([between.join(held)], pa.binary())], names=["value"])

    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    out.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", ROWS_A_FILE).text(path)


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all files in path; a response's digest and length are those of the bytes read. A revisit has no payload."""
    schema = RECORD + ", payload binary" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in schema.split(", ")])
        for batch in batches:
            for content in batch.column(0):
                held, n = [], 0
                for head, block in records(content.as_py()):
                    body = block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None
                    page, told = head.get("x-page-id"), head["warc-payload-digest"].removeprefix("sha1:")
                    if body is not None and digest(body) != told:
                        raise ValueError(f"record {head['warc-record-id']} doesn't have the payload that its digest names")
                    row = (head["warc-record-id"], head["warc-type"], None if page is None else int(page), head["warc-target-uri"], head["warc-date"], told, None if body is None else len(body), head.get("warc-refers-to"), body)
                    held.append(row if payload else row[:-1])
                    n += len(body or b"") * payload + 500
                    if n > ROW_BYTES:
                        yield _batch(held, arrow)
                        held, n = [], 0
                if held:
                    yield _batch(held, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def crawl_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for batch in slices(batches, PAGES):
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (html or "").encode()
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page}/{part}/{k}")
                k += 1
                rows.append((f"<urn:uuid:{name}>", "response", page, clean_uri(url), date, digest(body), len(body), None, body))
            if rows:
                yield _batch(rows, schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, RECORD + ", payload binary")


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Reads the archive in source and writes one to target in which repeated payloads of at least least_bytes are revisits."""
    heads = read_archive(spark, source).select("record_id", "page_id", "payload_digest", "payload_bytes")
    heads = stored(heads.where(F.col("payload_bytes") >= least_bytes), "warc-heads")
    first = heads.groupBy("payload_digest").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "record_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first, "warc-first")
    # a digest that many records share isn't joined by shuffle, as they would meet in one task
    bar = heads.count() // HOT + 1
    often = F.broadcast(first.where(F.col("n") > bar).select("payload_digest", F.col("first").alias("hot")))  # HOT rows at most
    marked = heads.select("record_id", "payload_digest").join(often, "payload_digest", "left")
    hot = marked.where("hot is not null").select("record_id", F.col("hot").alias("first"))
    rest = marked.where("hot is null").join(first.where(F.col("n") <= bar), "payload_digest").select("record_id", "first")
    links = hot.union(rest).where(F.col("record_id") != F.col("first.record_id")).select("record_id", F.col("first.record_id").alias("original"))
    links = stored(links, "warc-links")
    rows = read_archive(spark, source, payload=True).join(links, "record_id", "left")
    again = F.col("original").isNotNull()
    write_archive(
        rows.withColumn("record_type", F.when(again, F.lit("revisit")).otherwise(F.col("record_type"))).withColumn("payload", F.when(~again, F.col("payload"))).withColumn("refers_to", F.col("original")).drop("original"),
        target,
    )


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """The records of a deduplicated archive, revisits with the length of the response that they refer to (and its page_id)."""
    rows = stored(read_archive(spark, path), "warc-read")
    originals = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original_page"), F.col("payload_bytes").alias("original_bytes"), F.col("payload_digest").alias("original_digest"))
    revisits = rows.where("record_type = 'revisit'").join(originals, "refers_to", "left")
    checked = F.when(F.col("payload_digest") == F.col("original_digest"), F.col("original_bytes")).otherwise(F.raise_error(F.lit("a revisit's response is missing or has another payload")).cast("long"))
    out = rows.where("record_type = 'response'").select("page_id", "uri", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return out.unionByName(revisits.select("page_id", "uri", checked.alias("payload_bytes"), "payload_digest", "record_type", F.col("original_page").alias("refers_to")))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as an archive, deduplicates it, reads the result back."""
    spark = pages.sparkSession
    crawl, fresh = scratch_path(spark, "warc-crawl"), scratch_path(spark, "warc-fresh")
    write_archive(crawl_records(pages), crawl)
    deduplicate(spark, crawl, fresh, least_bytes)
    return resolved(spark, fresh).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS best FROM p),
     h AS (SELECT *, sha1(body) AS hex FROM m),
     b AS (SELECT *, list_reduce([CAST(strpos('0123456789abcdef', x) - 1 AS VARCHAR) FOR x IN string_split(hex, '')], lambda a, c: a || ',' || c) AS nibbles FROM h),
     g AS (SELECT page_id, body, best,
                  list_transform(range(0, 8), lambda i: list_reduce([CAST(n AS BIGINT) FOR n IN string_split(nibbles, ',')][5 * i + 1:5 * i + 5], lambda a, c: a * 16 + c)) AS groups FROM b)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(groups, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM g
"""
