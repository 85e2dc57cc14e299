"""Baseline JPEG media columns: markers, Huffman scans and DC-only luminance thumbnails in numpy.

`encode` stores bytes losslessly, one byte as the DC coefficient of one 8 x 8 block of a
grey picture (so the DC-only thumbnail is the payload), with Huffman tables whose code
and value bits have the same sum for each category: a block has 10 bits, so a scan is decoded
without following it bit by bit. `luminance` takes any baseline JPEG: scans without that
property, with colour, subsampling, AC coefficients or restarts go through a bit reader.

Cases: null and empty texts are one row of 64 zero bytes; payloads beyond the largest
picture are several pictures one after the other; equal texts give equal values;
repeated rows are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_or_empty, tidy

#: Blocks in a row of a stored picture, and rows of blocks of the largest one (16-bit heights).
ACROSS = 64
MOST_ROWS = 65_535 // 8

#: Category c has a code of 9 - c bits and c value bits; the AC table has the end of block alone, of one bit.
CATEGORIES = 9
BITS = CATEGORIES + 1


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, 8] + [1] * 63))
_TABLES = (
    _segment(0xC4, bytes([0x00] + [1] * CATEGORIES + [0] * (16 - CATEGORIES)) + bytes(range(CATEGORIES - 1, -1, -1)))
    + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0x00]))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _words() -> np.ndarray:
    """The 10 bits of each difference -255..255, at index difference + 255."""
    out = []
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code = (1 << (CATEGORIES - c)) - 2
        out.append(((code << c) | (d if d >= 0 else d + (1 << c) - 1)) << 1)
    return np.array(out, np.uint64)


_WORDS = _words()


def picture(payload: np.ndarray) -> bytes:
    """One JPEG of a multiple of ACROSS bytes, at most ACROSS * MOST_ROWS."""
    level = payload.astype(np.int16) - 128
    step = np.diff(level, prepend=np.int16(0))
    words = _WORDS[step + 255].reshape(-1, 4)
    packed = (words[:, 0] << np.uint64(30)) | (words[:, 1] << np.uint64(20)) | (words[:, 2] << np.uint64(10)) | words[:, 3]
    scan = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * (len(payload) // ACROSS), 8 * ACROSS, 1) + bytes([1, 0x11, 0]))
    return _HEAD + frame + _TABLES + scan.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def encode(payload: bytes) -> bytes:
    """Pictures, one after the other, of a payload of a positive multiple of ACROSS bytes."""
    data, most = np.frombuffer(payload, np.uint8), ACROSS * MOST_ROWS
    return b"".join(picture(data[i : i + most]) for i in range(0, len(data), most))


class _Table:
    """A Huffman table: its codes by (length, code), and the symbol and length for each 16 leading bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.lengths = np.repeat(np.arange(1, 17), np.frombuffer(counts, np.uint8))
        self.symbols = np.frombuffer(symbols, np.uint8).astype(np.int64)
        self.look_symbol, self.look_length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                low = code << (16 - n)
                self.look_symbol[low : low + (1 << (16 - n))] = symbols[at]
                self.look_length[low : low + (1 << (16 - n))] = n
                code, at = code + 1, at + 1
            code <<= 1


_tables: dict[bytes, _Table] = {}
_fast: dict[tuple[bytes, int], np.ndarray] = {}


def _extended(bits: int, c: int) -> int:
    return bits if not c or bits >> (c - 1) else bits - (1 << c) + 1


def frames(media: bytes) -> Iterator[dict]:
    """The parsed pictures in media: width, height, components, quantisers, tables, restart interval and the scan of the first component without stuffing, split at restarts, as they were in force for it."""
    at = 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        f, quant, tables, restart = {}, {}, {}, 0
        while True:
            if media[at] != 0xFF:
                raise ValueError("no marker where one must be")
            marker = media[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            at += 2
            if marker == 0xD9:
                break
            (n,) = struct.unpack_from(">H", media, at)
            body = media[at + 2 : at + n]
            at += n
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    quant[k] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]  # only the DC step is used
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    k = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:k]
                    body = body[k:]
            elif marker in (0xC0, 0xC1):
                _, f["height"], f["width"], count = struct.unpack_from(">BHHB", body)
                f["components"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)}
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                end = at
                while True:  # the next marker that isn't stuffing or a restart
                    end = media.index(b"\xff", end)
                    if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                raw, parts = media[at:end], []
                if restart:
                    start = i = 0
                    while (i := raw.find(b"\xff", i)) >= 0:
                        if raw[i + 1]:
                            parts.append(raw[start:i])
                            start = i + 2
                        i += 2
                    raw = raw[start:]
                if next(iter(f["components"])) in dict(scan):  # other scans hold other components
                    f |= {"quant": dict(quant), "tables": dict(tables), "restart": restart, "scan": scan}
                    f["data"] = [p.replace(b"\xff\x00", b"\xff") for p in (*parts, raw)]
                at = end
        yield f


def luminance(f: dict) -> np.ndarray:
    """The DC-only thumbnail of the first component: one sample for each 8 x 8 block."""
    first = f["scan"][0][0]
    h0, v0, q = f["components"][first]
    most_h, most_v = max(c[0] for c in f["components"].values()), max(c[1] for c in f["components"].values())
    across, down = -(-(-(-f["width"] * h0 // most_h)) // 8), -(-(-(-f["height"] * v0 // most_v)) // 8)
    dc = _constant_stride(f, across * down)
    if dc is None:
        dc, wide = _sequential(f, most_h, most_v)
        dc = dc.reshape(-1, wide)[:down, :across]
    else:
        dc = dc.reshape(down, across)
    return np.clip((dc * f["quant"][q] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _constant_stride(f: dict, blocks: int) -> np.ndarray | None:
    """Levels of the DC coefficients where each block of the scan has as many bits, else None."""
    if len(f["scan"]) != 1 or f["restart"]:
        return None
    ids = f["scan"][0][1]
    dc, ac = f["tables"][ids >> 4], f["tables"][16 | (ids & 15)]
    lengths = np.repeat(np.arange(1, 17), np.frombuffer(dc[:16], np.uint8))
    sums = lengths + np.frombuffer(dc[16:], np.uint8)
    if ac[16:] != b"\x00" or (sums != sums[0]).any() or sums[0] > 16:
        return None
    own, end = int(sums[0]), ac[:16].index(1) + 1
    if (dc, own) not in _fast:
        look, code = np.zeros(1 << own, np.int64), 0
        order = iter(dc[16:])
        for n in range(1, 17):
            for _ in range(dc[n - 1]):
                c = next(order)
                look[code << (own - n) : (code + 1) << (own - n)] = [_extended(b, c) for b in range(1 << c)]
                code += 1
            code <<= 1
        _fast[dc, own] = look
    data = np.frombuffer(f["data"][0], np.uint8)
    if own + end == BITS and not blocks % 4:  # four blocks are five bytes
        d = data[: blocks // 4 * 5].reshape(-1, 5).astype(np.int32)
        words = np.stack([d[:, 0] << 2 | d[:, 1] >> 6, (d[:, 1] & 63) << 4 | d[:, 2] >> 4, (d[:, 2] & 15) << 6 | d[:, 3] >> 2, (d[:, 3] & 3) << 8 | d[:, 4]], axis=1).ravel() >> end
    else:
        bits = np.unpackbits(data, count=blocks * (own + end)).reshape(blocks, own + end)[:, :own]
        words = bits.astype(np.int32) @ (1 << np.arange(own - 1, -1, -1))
    return np.cumsum(_fast[dc, own][words])


def _sequential(f: dict, most_h: int, most_v: int) -> tuple[np.ndarray, int]:
    """Levels of the first component's DC coefficients by reading the scan bit by bit; blocks in a row of them."""
    single = len(f["scan"]) == 1
    mcus_x, mcus_y = -(-f["width"] // (8 * most_h)), -(-f["height"] // (8 * most_v))
    parts = []
    for name, ids in f["scan"]:
        h, v, _ = f["components"][name]
        tables = []
        for key in (ids >> 4, 16 | (ids & 15)):
            raw = f["tables"][key]
            if raw not in _tables:
                _tables[raw] = _Table(raw[:16], raw[16:])
            tables.append(_tables[raw])
        parts.append((1 if single else h, 1 if single else v, *tables))
    if single:
        h, v, _ = f["components"][f["scan"][0][0]]
        mcus_x, mcus_y = -(-(-(-f["width"] * h // most_h)) // 8), -(-(-(-f["height"] * v // most_v)) // 8)
    h0, v0 = parts[0][:2]
    out, wide, mcu = np.zeros((mcus_y * v0, mcus_x * h0), np.int64), mcus_x * h0, 0
    for data in f["data"]:
        bits, left, at = 0, 0, 0
        before = [0] * len(parts)

        def need(n, data=data):
            nonlocal bits, left, at
            while left < n:
                bits, left, at = (bits << 8 | (data[at] if at < len(data) else 0)) & 0xFFFFFFFFFF, left + 8, at + 1

        def symbol(t):
            nonlocal left
            need(16)
            look = (bits >> (left - 16)) & 0xFFFF
            if not (n := int(t.look_length[look])):
                raise ValueError("no such code")
            left -= n
            return int(t.look_symbol[look])

        for _ in range(f["restart"] or mcus_x * mcus_y):
            if mcu >= mcus_x * mcus_y:
                break
            y, x = divmod(mcu, mcus_x)
            for k, (h, v, dc, ac) in enumerate(parts):
                for b in range(h * v):
                    c = symbol(dc)
                    need(c)
                    left -= c
                    before[k] += _extended((bits >> left) & ((1 << c) - 1), c)
                    if not k:
                        out[y * v + b // h, x * h + b % h] = before[0]
                    i = 1
                    while i < 64:
                        s = symbol(ac)
                        if not s:
                            break
                        i += (s >> 4) + 1
                        need(s & 15)
                        left -= s & 15
            mcu += 1
    return out.ravel(), wide


def thumbnail_hash(thumb: np.ndarray) -> int:
    """64 bits: which of 8 x 8 cells are lighter than their mean."""
    cells = thumb
    for axis in (0, 1):
        n = cells.shape[axis]
        low = np.arange(8) * n // 8
        high = np.maximum(low + 1, np.arange(1, 9) * n // 8)
        run = np.concatenate([np.zeros_like(cells[:1], np.int64) if not axis else np.zeros_like(cells[:, :1], np.int64), np.cumsum(cells, axis, dtype=np.int64)], axis)
        cells = (np.take(run, high, axis) - np.take(run, low, axis)) * 840 // np.expand_dims(high - low, 1 - axis)
    return int.from_bytes(np.packbits((cells * 64 > cells.sum()).ravel()).tobytes(), "big")


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's bytes, padded with zeros to a positive multiple of 64, as pictures."""
    kind = dict(docs.dtypes)["doc_id"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            media = [encode(b.ljust(max(ACROSS, -(-len(b) // ACROSS) * ACROSS), b"\0")) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def _read_back(m: bytes | None) -> tuple:
    """The columns of a row's media; of bytes that aren't whole baseline JPEG pictures only their size and digest."""
    if m is None:
        return (None,) * 9
    stored = len(m), hashlib.sha256(m).hexdigest()
    try:
        parsed = list(frames(m))
        thumbs = [luminance(f) for f in parsed]
        width, height = parsed[0]["width"], sum(f["height"] for f in parsed)
    except (ValueError, IndexError, KeyError, TypeError, struct.error):
        return None, None, None, *stored, None, None, None, None
    payload = b"".join(t.tobytes() for t in thumbs)
    marks = ":".join(f"{thumbnail_hash(t):016x}" for t in thumbs)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, f"jpeg {width}x{height} {marks}", width, height, len(parsed)


def media_columns(media: DataFrame) -> DataFrame:
    """For rows of doc_id, n_bytes and media: dimensions, thumbnail hash and digests of what is read back. Null or damaged media and other formats have nulls there."""
    kind = dict(media.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, pictures int"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_read_back(m.as_py()) for m in batch.column(2)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return media.mapInArrow(run, schema)
