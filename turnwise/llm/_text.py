"""Arrow text buffers, word hashes and shingle hashes computed on UTF-8 bytes with numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D; A-Z count as a-z.
Hashes are 64-bit, the same in every process, and independent of how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in slices of about this many bytes, so that temporaries stay small.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_ROW = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ROW[ord("A") : ord("Z") + 1] = _ROW[ord("a") : ord("z") + 1]
_ROW[~_WORD] = 0
_LETTERS = _WORD.copy()
_LETTERS[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_ROW_LETTERS = np.where(_LETTERS, _ROW, _U(0))
#: Digits, letters and all bytes beyond ASCII, for word_hashes(only=TERMS): words of lexical search.
TERMS = _LETTERS.copy()
TERMS[[*range(0x30), 0x7F]] = False
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_GRAM = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, after adding seed."""
    x = x + _U(seed & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK_BYTES)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the byte offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; one row at least."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, min(high, rows)
        low = high


def word_hashes(data: np.ndarray, offsets: np.ndarray, ends: bool = False, letters: bool = False, only: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Hashes of all words, the word range of each row, the first byte of each word (and its end).

    letters: ASCII signs other than the apostrophe end a word too. only: a table of 256 that says which bytes belong to words.
    """
    table, row = (_LETTERS, _ROW_LETTERS) if letters else (_WORD, _ROW)
    if only is not None:
        table, row = only, np.where(only, _ROW, _U(0))
    if not len(data):
        none = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none) + ((none,) if ends else ())
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    starts = np.flatnonzero(first)
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + CHUNK_BYTES)))
        at, to = int(starts[low]), int(starts[high]) if high < len(starts) else len(data)
        power, inverse = _powers(to - at)
        here = starts[low:high] - at
        out[low:high] = np.add.reduceat(row[data[at:to]] * power[: to - at], here) * inverse[here]
        low = high
    bounds = np.searchsorted(starts, offsets)
    if not ends:
        return mix(out), bounds, starts
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return mix(out), bounds, starts, np.flatnonzero(last) + 1


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words within a row, and the range of each row.

    A row of 1 to size - 1 words has one shingle, of all its words; a row without words has none.
    """
    lengths = np.diff(bounds)
    counts = np.maximum(lengths - size + 1, 0)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    n = len(words) - size + 1
    if n > 0:
        every = np.zeros(n, np.uint64)
        for j in range(size):
            every += words[j : n + j] * _GRAM[j]
        keep = np.ones(n, bool)
        for j in range(1, size):
            at = bounds[1:-1] - j
            keep[at[(at >= 0) & (at < n)]] = False
        every = mix(every[keep])
    else:
        every = np.zeros(0, np.uint64)
    if len(short):
        own = np.array([(words[bounds[i] : bounds[i + 1]] * _GRAM[: lengths[i]]).sum(dtype=np.uint64) for i in short], np.uint64)
        where = np.concatenate([[0], np.cumsum(counts)])[short]
        every = np.insert(every, where, mix(own, 99))
        counts[short] = 1
    return every, np.concatenate([[0], np.cumsum(counts)])
