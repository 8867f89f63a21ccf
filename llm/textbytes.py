"""Numpy helpers over the UTF-8 bytes of a batch of texts: views, rolling hashes, word spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_BYTE_CODES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets into them; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int = CHUNK) -> list[tuple[int, int]]:
    """Cuts rows into runs of at most `limit` bytes; a longer row is a run of its own."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        out.append((start, end))
        start = end
    return out


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 2 * CHUNK:
            _powers[name] = have
    return have[:n]


class RollingHash:
    """Hashes of any byte range by prefix sums of code * BASE**i modulo 2**64."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = _BYTE_CODES):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * _power("up", BASE, len(data)), out=self.prefix[1:])
        self.down = _power("down", _INVERSE, len(data) + 1)

    def ranges(self, start, end) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """The hash of every run of `width` bytes."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[width:] - self.prefix[:n]) * self.down[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs."""
    return mix(a * np.uint64(0xA0761D6478BD642F) + b + np.uint64(0x8EBC6AF09C88C6E3))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of `width` values, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Runs of bytes that `inside` marks, cut at row ends: starts, ends, and each row's first word number
    (length rows + 1)."""
    flag = inside[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = flag[:-1]
        cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[cuts] = False
    starts = np.flatnonzero(flag & ~before)
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = flag[1:] & before[1:]
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sentence_hashes(words: np.ndarray, first: np.ndarray, width: int):
    """Hashes of every run of `width` words inside a row; a row of fewer words, but not none, gives its whole
    sequence. Returns hashes and the row of each, rows in order."""
    n, rows = np.diff(first), len(first) - 1
    owner = np.repeat(np.arange(rows), n)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(first[1:], n) - np.arange(len(words))
    out = words.copy()
    for k in range(1, width):
        step = np.zeros(len(words), np.uint64)
        step[:-k or None] = words[k:] if k < len(words) else 0
        if k >= len(words):
            step[:] = 0
        out = np.where(left > k, combine(out, step), out)
    keep = (left >= width) | ((np.repeat(n, n) < width) & (np.arange(len(words)) == np.repeat(first[:-1], n)))
    return out[keep], owner[keep]
