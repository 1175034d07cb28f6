"""Fuzzy hashes by numpy: context-triggered piecewise hashes and locality-sensitive bucket hashes. Workers import this module; it holds no UDFs."""

from __future__ import annotations

import numpy as np

# ---- context-triggered piecewise hashing --------------------------------------------------------------------------------

# Fixed values of the format.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST_BLOCK, LENGTH, WINDOW = 3, 64, 7
HASH_START, HASH_PRIME = 0x28021967, 0x01000193

#: Only six bits of a piece's hash are shown, and these depend on nothing but six bits of what came before: one row per byte value.
_STEP = [bytes(((h * HASH_PRIME) ^ c) & 63 for h in range(64)) for c in range(256)]


def _rolling(raw: np.ndarray) -> np.ndarray:
    """The rolling hash behind every byte: it sees the last WINDOW bytes."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), raw.astype(np.uint32)])
    last = [padded[WINDOW - 1 - k : len(padded) - k] for k in range(WINDOW)]
    plain, weighted, mixed = np.zeros((3, len(raw)), np.uint32)
    for k, c in enumerate(last):
        plain += c
        weighted += np.uint32(WINDOW - k) * c
        mixed ^= c << np.uint32(5 * k)
    return plain + weighted + mixed


def _pieces(raw: bytes, ends: np.ndarray, most: int, trailing: bool) -> str:
    """One letter per piece; the last of `most` letters takes all that is left."""
    out, at = [], 0
    for end in [*ends[: most - 1].tolist(), None]:
        if end is None:
            later = ends[most - 1 :]
            # what is left shows where it last ended, or at the end of the text
            stop = len(raw) if trailing else int(later[-1]) + 1 if len(later) else None
            if stop is None:
                break
        else:
            stop = end + 1
        h = HASH_START & 63
        for c in raw[at:stop]:
            h = _STEP[c][h]
        out.append(LETTERS[h])
        at = stop
    return "".join(out)


def ctph(text: str | bytes | None) -> str | None:
    """`block size:pieces:pieces of twice the size`."""
    if text is None:
        return None
    raw = text.encode() if isinstance(text, str) else text
    data = np.frombuffer(raw, np.uint8)
    rolled = _rolling(data) if len(raw) else np.zeros(0, np.uint32)
    block = LEAST_BLOCK
    while block * LENGTH < len(raw):
        block *= 2
    ends = lambda size: np.flatnonzero(rolled % np.uint32(size) == size - 1)
    while block > LEAST_BLOCK and len(ends(block)) < LENGTH // 2:
        block //= 2
    trailing = bool(len(rolled)) and int(rolled[-1]) != 0
    return f"{block}:{_pieces(raw, ends(block), LENGTH, trailing)}:{_pieces(raw, ends(2 * block), LENGTH // 2, trailing)}"


def short_runs(s: str) -> str:
    """Runs of a letter are cut to three."""
    return "".join(c for k, c in enumerate(s) if k < 3 or not (c == s[k - 1] == s[k - 2] == s[k - 3]))


def parts(digest: str) -> list[tuple[int, str]]:
    """(block size, pieces) of a digest, both sizes."""
    size, one, two = digest.split(":", 2)
    return [(int(size), short_runs(one)), (2 * int(size), short_runs(two))]


def masks(codes: np.ndarray) -> np.ndarray:
    """For rows of up to 64 codes below 64, padded with 64: the places of each code in a row, a bit each; one column more for the padding."""
    out = np.zeros((len(codes), 65), np.uint64)
    for k in range(codes.shape[1]):
        out[np.arange(len(codes)), codes[:, k]] |= np.uint64(1 << k)
    out[:, 64] = 0
    return out


def common(places: np.ndarray, codes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows x and rows y, a bit per code of x: what is matched is a 0."""
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 1 << 14):
        i, j = x[lo : lo + (1 << 14)], y[lo : lo + (1 << 14)]
        own, other = places[i], codes[j]
        free, row = np.full(len(i), np.iinfo(np.uint64).max, np.uint64), np.arange(len(i))
        for k in range(int((other < 64).sum(1).max(initial=0))):
            met = free & own[row, other[:, k]]
            free = (free + met) | (free - met)
        out[lo : lo + (1 << 14)] = np.bitwise_count(~free)
    return out


_CODE = np.full(256, 64, np.uint8)
_CODE[list(LETTERS.encode())] = np.arange(64)


def piece_codes(pieces: list[str]) -> np.ndarray:
    """Rows of codes for `common`."""
    return _CODE[np.frombuffer(b"".join(s.encode().ljust(LENGTH, b"\0") for s in pieces), np.uint8).reshape(-1, LENGTH)]


def scores_at(places: np.ndarray, codes: np.ndarray, n: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of rows x and y of piece strings of n letters, 0 to 100: a change counts as one letter out and one in."""
    n, m, size = n[x], n[y], size[x]
    distance = n + m - 2 * common(places, codes, x, y)
    score = 100 - 100 * (distance * LENGTH // np.maximum(1, n + m)) // LENGTH
    few = size < (99 + WINDOW) // WINDOW * LEAST_BLOCK  # short texts can't be very sure
    return np.where(few, np.minimum(score, size // LEAST_BLOCK * np.minimum(n, m)), score)


def piece_scores(a: list[str], b: list[str], size: np.ndarray) -> np.ndarray:
    """Scores of pairs of piece strings that have WINDOW letters in a row in common, 0 to 100."""
    codes, k = piece_codes([*a, *b]), len(a)
    return scores_at(masks(codes), codes, (codes < 64).sum(1), np.concatenate([size, size]), np.arange(k), k + np.arange(k))


def grams(s: str) -> set[str]:
    return {s[k : k + WINDOW] for k in range(len(s) - WINDOW + 1)}


def gram_codes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all WINDOW letters in a row of piece strings, six bits a letter."""
    codes = piece_codes(pieces).astype(np.int64)
    row, at = np.nonzero(codes[:, WINDOW - 1 :] < 64)
    return row, sum(codes[row, at + k] << 6 * k for k in range(WINDOW))


def ctph_score(a: str | None, b: str | None) -> int:
    """Score of two digests, 0 to 100."""
    if a is None or b is None:
        return 0
    if a == b:
        return 100
    found = [(p, q, size) for size, p in parts(a) for other, q in parts(b) if size == other and grams(p) & grams(q)]
    return int(piece_scores([f[0] for f in found], [f[1] for f in found], np.array([f[2] for f in found])).max()) if found else 0


# ---- locality-sensitive bucket hashing ----------------------------------------------------------------------------------

BUCKETS, SLIDE, LEAST_BYTES = 128, 5, 50
#: Salts and the places, counted backwards from the newest byte, of the triplets of a window.
TRIPLETS = ((2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4))


def table(seed: int = 1) -> np.ndarray:
    """A permutation of the byte values. Digests can be compared only if made with one table."""
    return np.random.default_rng(seed).permutation(256).astype(np.uint8)


_TABLE = table()


def bucket_hash(text: str | bytes | None, permutation: np.ndarray = _TABLE) -> bytes | None:
    """Checksum, length class, quartile ratios, then two bits a bucket: the quartile of its count. None for short or uniform texts."""
    raw = text.encode() if isinstance(text, str) else text
    if raw is None or len(raw) < LEAST_BYTES:
        return None
    data, t = np.frombuffer(raw, np.uint8), permutation
    at = [data[SLIDE - 1 - k : len(data) - k] for k in range(SLIDE)]
    mapped = lambda salt, i, j, k: t[t[t[t[salt] ^ i] ^ j] ^ k]
    counts = np.zeros(256, np.int64)
    for salt, j, k in TRIPLETS:
        counts += np.bincount(mapped(salt, at[0], at[j], at[k]), minlength=256)
    counts, check = counts[:BUCKETS], 0
    for i, j in zip(at[0].tolist(), at[1].tolist(), strict=True):
        check = int(t[t[t[t[0] ^ i] ^ j] ^ check])
    order = np.sort(counts)
    q1, q2, q3 = (int(order[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    if not q3 or (counts > 0).sum() <= BUCKETS // 2:
        return None
    n = np.log(len(raw))
    length = int(n / np.log(1.5)) if len(raw) <= 656 else int(n / np.log(1.3) - 8.72777) if len(raw) <= 3199 else int(n / np.log(1.1) - 62.5472)
    body = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    return bytes([check, length & 255, (q1 * 100 // q3) % 16, (q2 * 100 // q3) % 16]) + body.astype(np.uint8).tobytes()


def bucket_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of digests: 0 for equal ones, a few hundred for unlike ones."""
    x, y = a.astype(np.int64), b.astype(np.int64)

    def around(d, n):
        return np.minimum(d % n, -d % n)

    length = around(x[:, 1] - y[:, 1], 256)
    out = np.where(length <= 1, length, length * 12) + (x[:, 0] != y[:, 0])
    for k in (2, 3):
        d = around(x[:, k] - y[:, k], 16)
        out += np.where(d <= 1, d, (d - 1) * 12)
    apart = np.abs(x[:, 4:] - y[:, 4:])
    return out + np.where(apart == 3, 6, apart).sum(1)


def bucket_distance(a: bytes | None, b: bytes | None) -> int | None:
    return None if a is None or b is None else int(bucket_distances(*(np.frombuffer(v, np.uint8)[None, :] for v in (a, b)))[0])
