"""Word shingles as 64-bit hashes, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPAN = 5
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_COEF = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK)
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[at] = np.multiply.accumulate(steps)
    return _POWERS


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, bytes, offsets) for runs of documents of about size bytes."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For every document the sorted distinct hashes of its shingles."""
    n_docs = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n_docs
    word = ~_SPACE[data]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    begin[filled] = word[filled]
    end[:-1] &= ~word[1:]
    lasts = filled[1:] - 1
    end[lasts] = word[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * power[: len(data)], out=total[1:])
    words = mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.searchsorted(starts, offsets)
    out = []
    if len(words) >= SPAN:
        n = len(words) - SPAN + 1
        grams = np.zeros(n, np.uint64)
        for j in range(SPAN):
            grams += words[j : j + n] * _COEF[j]
        grams = mix(grams)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= SPAN:
            out.append(np.unique(grams[a : b - SPAN + 1]))
        elif b > a:
            short = (words[a:b] * _COEF[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    a = mix(shingles + np.uint64(0x1234567)).sum(dtype=np.uint64)
    b = mix(shingles ^ np.uint64(0xABCDEF0123456789)).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes() + len(shingles).to_bytes(4, "big")
