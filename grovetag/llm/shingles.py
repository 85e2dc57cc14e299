"""Hashes of words and of word shingles, over the bytes of many texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .common import LOWER

#: Bytes that are hashed at a time.
CHUNK = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15  # odd
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)  # a fixed number for each byte
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_blank = re.compile(rb"[\x20\x09-\x0d]")
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers_of(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, f in enumerate((_FACTOR, _INVERSE)):
            x = np.full(n, f, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower-cased data, and where they start. A word's hash is a polynomial in its bytes: a difference of two running sums."""
    if len(data) > 2 * CHUNK:
        hashes, starts, at = [], [], 0
        while at < len(data):
            end = _blank.search(data, at + CHUNK)
            end = end.end() if end else len(data)
            h, s = word_hashes(data[at:end]) if end - at <= 2 * CHUNK else _hashes(data[at:end])
            hashes.append(h)
            starts.append(s + at)
            at = end
        return np.concatenate(hashes), np.concatenate(starts)
    return _hashes(data)


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[b].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers_of(len(b) + 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=run[1:])
    return mixed((run[ends] - run[starts]) * inverse[starts]), starts


def shingles(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of k words; fewer words are one shingle, none give none."""
    at = 0
    while at < len(texts):
        parts, offsets, size = [], [], 0
        while at < len(texts) and size < CHUNK:
            raw = texts[at].encode()
            offsets.append(size)
            parts.append(raw)
            size += len(raw) + 1
            at += 1
        words, starts = word_hashes(b"\n".join(parts).translate(LOWER))
        bounds = [*np.searchsorted(starts, offsets).tolist(), len(words)]
        if len(words) >= k:
            whole = words[: len(words) - k + 1] * _ODD[0]
            for i in range(1, k):
                whole += words[i : len(words) - k + 1 + i] * _ODD[i]
            whole = mixed(whole)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif a == b:
                yield np.empty(0, np.uint64)
            else:
                yield mixed((words[a:b] * _ODD[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
