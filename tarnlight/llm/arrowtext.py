"""Vectorised views of Arrow text columns: byte buffers, word spans and 64-bit word keys.

Words are maximal runs of ASCII letters, digits and characters from U+0080 on, with A-Z lower-cased.
Each byte of a character from U+0080 on is itself 0x80 or more in UTF-8, so words can be found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
IS_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE_KEY = stream(256, 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = stream(64, 2) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        full = np.full(size, _BASE, dtype=np.uint64)
        full[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.cumprod(full)
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if len(offsets) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, dtype=np.uint8, count=hi)[lo:], offsets - lo


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `limit` bytes, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word, index of the first word of each row and at the end the number of words)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    is_word = IS_WORD[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    first[begin] = is_word[begin]
    end = offsets[1:][offsets[1:] > 0] - 1
    last[end] = is_word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), bounds
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        value = _BYTE_KEY[LOWER[data[is_word]]] * powers(int(lengths.max()) + 1)[place]
        keys = mix(np.add.reduceat(value, at) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return keys, bounds


def windows(keys: np.ndarray, size: int) -> np.ndarray:
    """Key of the `size` words from each position on (the last size - 1 positions are left out)."""
    n = len(keys) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = keys[:n] * _PLACE[0]
        for j in range(1, size):
            total = total + keys[j : j + n] * _PLACE[j]
        return mix(total + np.uint64(size))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle keys of each row. A row of fewer words, but not none, has one shingle."""
    keys, bounds = words(data, offsets)
    every = windows(keys, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = b - a
        if n >= size:
            out.append(np.unique(every[a : b - size + 1]))
        else:
            out.append(windows(keys[a:b], n) if n else np.zeros(0, np.uint64))
    return out
