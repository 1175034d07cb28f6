"""Perceptual hashes of vectors that are squares of pixels, row by row."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("average", "gradient", "cosine", "haar")
#: Lowest frequencies of a row and of a column that the cosine hash looks at.
LOW = 8


@functools.cache
def _cosines(n: int) -> np.ndarray:
    out = np.cos(math.pi * np.outer(np.arange(n), 2 * np.arange(n) + 1) / (2 * n)) * math.sqrt(2 / n)
    out[0] /= math.sqrt(2)
    return out


@functools.cache
def _haar(n: int) -> np.ndarray:
    """The orthonormal Haar basis of n = 2**k points, a row a function; the first is constant."""
    out = np.ones((1, 1))
    while len(out) < n:
        out = np.concatenate([np.kron(out, [1, 1]), np.kron(np.eye(len(out)), [1, -1])]) / math.sqrt(2)
    return out


def bits(squares: np.ndarray) -> dict[str, np.ndarray | None]:
    """The bits of each hash of squares (k, n, n): above the mean; above the left neighbour; low cosine coefficients above their median; above the median once the mean is taken off by Haar wavelets (n a power of two)."""
    k, n, _ = squares.shape
    flat = lambda x: x.reshape(k, -1)
    above = lambda x, least: flat(x) > least(flat(x), axis=1)[:, None]
    c = _cosines(n)
    out = {"average": above(squares, np.mean), "gradient": flat(squares[:, :, 1:] > squares[:, :, :-1]), "cosine": above((c @ squares @ c.T)[:, :LOW, :LOW], np.median), "haar": None}
    if n & (n - 1) == 0:
        h = _haar(n)
        w = h @ squares @ h.T
        w[:, 0, 0] = 0
        out["haar"] = above(h.T @ w @ h, np.median)
    return out


@F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in KINDS]))
def hashes(vectors: pd.Series) -> pd.DataFrame:
    """Strings of 0 and 1; null of what is no square, has a null in it, or for `haar` no side that is a power of two."""
    out = pd.DataFrame(None, index=vectors.index, columns=list(KINDS), dtype=object)
    side = vectors.map(lambda v: math.isqrt(len(v)) if v is not None and len(v) and math.isqrt(len(v)) ** 2 == len(v) and not any(x is None or x != x for x in v) else 0)
    for n in sorted(set(side) - {0}):
        at = vectors.index[side == n]
        for kind, b in bits(np.stack([np.asarray(v, np.float64) for v in vectors[at]]).reshape(-1, n, n)).items():
            if b is not None:
                out.loc[at, kind] = ["".join(map(str, row)) for row in b.astype(int).tolist()]
    return out
