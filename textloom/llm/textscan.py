"""Vectorised word and byte-window hashing on Arrow string buffers, without a Python object per word.

Hashes are sums of a random 64-bit value per byte times powers of an odd base, modulo 2**64, so that every
substring's hash follows from prefix sums; a finaliser mixes the bits. Values are fixed by SEED.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEED = 20240607
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20

_rng = np.random.default_rng(SEED)
BYTE_VALUES = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GRAM_FACTORS = _rng.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

#: Byte values with A-Z folded to a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED_VALUES = BYTE_VALUES[FOLDED]


def _table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        out = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        out[0] = 1
        _powers[base] = have = np.cumprod(out, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """P[i] = hash of data[:i]; the hash of data[s:e] is (P[e] - P[s]) * INVERSE**s."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * _table(BASE, len(data))[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * _table(INVERSE, len(prefix))[start]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges of consecutive texts that hold up to limit bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of word bytes; runs end with their text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[data]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    begins, ends = offsets[:-1][full], offsets[1:][full] - 1
    first[begins] = m[begins]
    last[ends] = m[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word with A-Z folded."""
    return mix(span_hash(prefix_sums(data, FOLDED_VALUES), start, end) + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, wherever texts end."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out += words[k : k + m] * GRAM_FACTORS[k]
    return mix(out)
