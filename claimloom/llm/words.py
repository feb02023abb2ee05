"""Words of many texts at once: numpy arrays over the bytes of an Arrow string column.

A slice of a column is handled as one run of bytes, so the work per word is a few array
passes and no Python string is made.  Words are compared by 64-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; one-to-one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_CODES = np.arange(256, dtype=np.uint8)
SPACES = (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13))
#: ASCII that is neither letter nor digit.
MARKS = (_CODES < 128) & ~np.isin(_CODES, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
_BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x2545F4914F6CDD1D)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, _BASE, np.uint64))), dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """``first[r]`` to ``first[r + 1]`` are the words of row r; keys, and places in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    keys: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive rows of at most ``limit`` bytes together, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def split(texts: pa.Array, lower: bool = False, separators: np.ndarray = SPACES) -> Words:
    """The words of every row: runs of bytes that are no separators."""
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = ~separators[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(data, offsets, np.zeros(len(offsets), np.int64), none, none, np.zeros(0, np.uint64))
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its text
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    lengths = end - begin
    starts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    parts = _BYTE_KEYS[data[inside]] * _power_table(int(lengths.max()))[place]
    keys = mix(np.add.reduceat(parts, starts) + lengths.astype(np.uint64))
    return Words(data, offsets, np.searchsorted(begin, offsets), begin, end, keys)


_STEPS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def runs(keys: np.ndarray, n: int) -> np.ndarray:
    """A key for each run of n consecutive words, wherever texts end."""
    count = max(0, len(keys) - n + 1)
    total = np.full(count, np.uint64(n))
    for k in range(n):
        total = total + keys[k : k + count] * _STEPS[k % 64]
        if k % 64 == 63:
            total = mix(total)
    return mix(total)
