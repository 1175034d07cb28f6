"""HyperMinHash registers of word-shingle sets.

A set's 64-bit shingle hashes fall into REGISTERS buckets by their first bits. A bucket keeps its least remaining value as a
leading-zero count and MANTISSA mantissa bits, 16 bits together. Empty buckets borrow from others in an order fixed per
bucket, so that registers of small sets still agree with the probability of the sets' similarity.
"""

from __future__ import annotations

import numpy as np

from textloom.llm import textscan as ts

WORDS = 5
REGISTERS = 128
BITS = 7
MANTISSA = 10
BANDS = 32
ROWS = REGISTERS // BANDS
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False

_rng = np.random.default_rng(ts.SEED + 2)
_BORROW = np.stack([np.concatenate([[j], _rng.permutation(np.delete(np.arange(REGISTERS), j))]) for j in range(REGISTERS)])
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BITS)
_BAND_FACTORS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words is one shingle."""
    start, end, text = ts.word_spans(data, offsets, IS_WORD)
    hashes = ts.word_hashes(data, start, end)
    n = len(offsets) - 1
    bounds = np.searchsorted(text, np.arange(n + 1))
    grams = ts.gram_hashes(hashes, words)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= words:
            own = np.sort(grams[lo : hi - words + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        else:
            out.append(ts.gram_hashes(hashes[lo:hi], hi - lo) if hi > lo else grams[:0])
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set that isn't empty, as 16-bit numbers."""
    first = np.searchsorted(shingles, _EDGES)
    full = np.append(first[1:], len(shingles)) > first
    value = shingles[np.minimum(first, len(shingles) - 1)] << np.uint64(BITS)
    top = np.maximum(value, np.uint64(1))
    # leading zeros by the exponent; values are cut to 53 bits first so that rounding can't carry
    zeros = 63 - (np.frexp((top & ~np.uint64(0x7FF)).astype(np.float64) + (top < np.uint64(0x800)) * top.astype(np.float64))[1].astype(np.int64) - 1)
    zeros = np.clip(zeros, 0, 63)
    mantissa = ((top << zeros.astype(np.uint64)) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    if not full.all():
        lender = np.take_along_axis(_BORROW, full[_BORROW].argmax(1)[:, None], 1)[:, 0]
        out = out[lender]
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row of registers."""
    mixed = ts.mix((rows.astype(np.uint64) + np.uint64(1)) * _BAND_FACTORS)
    return ts.mix(mixed.reshape(len(rows), BANDS, ROWS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of two disjoint sets of n and m members agree: summed over leading-zero counts and mantissas."""
    z = np.arange(64 - BITS, dtype=np.float64)
    low, width = 2.0 ** -(z + 1), 2.0 ** -(z + 1 + MANTISSA)
    a, b = (np.maximum(1.0, np.asarray(x, np.float64) / REGISTERS)[..., None] for x in (n, m))
    # P(min in [v, v + w)) ~ w * n * (1 - v)**(n - 1), at the middle of each leading-zero class
    v = low * 1.5
    return ((2.0**MANTISSA) * (width * a * np.exp(-v * (a - 1))) * (width * b * np.exp(-v * (b - 1)))).sum(-1)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity by equal registers, corrected for chance collisions."""
    equal = (a == b).mean(-1)
    c = collision_rate(n, m)
    return np.clip((equal - c) / (1 - c), 0, 1)
