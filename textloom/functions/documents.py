"""Summaries by sentence graphs, and JSON with shared and circular parts. Workers import this module; it holds no UDFs."""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np

THRESHOLD, DAMPING, TOLERANCE = 0.1, 0.85, 1e-6
#: Cells of a block of the sentence graph, and common words that are gathered for it.
BLOCK_CELLS, BLOCK_WORDS = 1 << 21, 1 << 20
#: Topics of a text, dimensions that are followed beside them, and rounds.
TOPICS, BESIDE, ROUNDS = 8, 8, 40
#: Sentences of which all products are made.
GRAM = 256


def sentences(text: str | None) -> list[str]:
    """Sentences of more than two words, white space made plain."""
    plain = re.sub(r"[\x20\x09-\x0D]+", " ", text or "").strip(" ")
    return [s for s in re.split(r"(?<=[.!?]) ", plain) if len(s.split(" ")) > 2]


class Words:
    """The words of sentences, sparse: (row, column, count), by row and by column."""

    def __init__(self, found: list[str]):
        number: dict[str, int] = {}
        cells: dict[tuple[int, int], int] = {}
        for i, s in enumerate(found):
            for w in re.findall(r"[^\W_]+", s.lower()):
                key = i, number.setdefault(w, len(number))
                cells[key] = cells.get(key, 0) + 1
        self.n, self.m = len(found), len(number)
        row, column = np.array(list(cells), np.int64).reshape(-1, 2).T
        order = np.lexsort((column, row))
        self.row, self.column, self.count = row[order], column[order], np.array(list(cells.values()), np.float64)[order]
        self.by_column = np.argsort(self.column, kind="stable")
        self.have = np.bincount(self.column, minlength=self.m)  # sentences with a word

    def blocks(self):
        """(first, last) row of consecutive rows whose products with all rows stay within BLOCK_CELLS and BLOCK_WORDS, or one row."""
        cost = np.concatenate([[0], np.cumsum(np.bincount(self.row, self.have[self.column], self.n))])
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, min(lo + BLOCK_CELLS // self.n, int(np.searchsorted(cost, cost[lo] + BLOCK_WORDS, side="right")) - 1, self.n))
            yield lo, min(hi, self.n)
            lo = hi

    def products(self, weight: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Inner products of rows lo to hi with all rows, by what has each of their words."""
        a, b = np.searchsorted(self.row, [lo, hi])
        size = self.have[self.column[a:b]]
        starts = (np.cumsum(self.have) - self.have)[self.column[a:b]]
        upto = np.cumsum(size)
        other = self.by_column[np.repeat(starts - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        at = np.repeat(self.row[a:b] - lo, size) * self.n + self.row[other]
        return np.bincount(at, np.repeat(weight[a:b], size) * weight[other], (hi - lo) * self.n).reshape(hi - lo, self.n)


def _walk(n: int, spread) -> np.ndarray:
    """Stationary shares of a walk that `spread` (shares to shares) takes and that starts anew now and then."""
    p = step = np.full(n, 1 / n)
    for _ in range(1000):
        step = (1 - DAMPING) / n + DAMPING * spread(p)
        step += (1 - step.sum()) / n
        if np.abs(step - p).max() < TOLERANCE / n:
            break
        p = step
    return step


def ranks(found: list[str]) -> np.ndarray:
    """Shares of sentences that are alike: edges where the cosine of tf-idf vectors is above THRESHOLD. An edge is a bit; everything else is a block at a time."""
    words = Words(found)
    n = words.n
    if not len(words.row):
        return np.full(n, 1 / max(1, n))
    most = np.zeros(n)
    np.maximum.at(most, words.row, words.count)
    weight = words.count / most[words.row] * np.log(1 + n / words.have)[words.column]
    weight /= np.maximum(1e-12, np.sqrt(np.bincount(words.row, weight**2, n)))[words.row]
    blocks = [(lo, hi, np.packbits(words.products(weight, lo, hi) > THRESHOLD, axis=1)) for lo, hi in words.blocks()]
    edges = np.concatenate([np.bitwise_count(bits).sum(1, dtype=np.int64) for _, _, bits in blocks])

    def spread(p):
        p = p / np.maximum(1, edges)
        return sum(p[lo:hi] @ np.unpackbits(bits, axis=1, count=n) for lo, hi, bits in blocks)

    return _walk(n, spread)


def overlaps(found: list[str]) -> np.ndarray:
    """Shares of a walk along the words that sentences have in common, over the logarithms of their lengths. Blocks are made anew each round where they don't all fit one."""
    words = Words(found)
    n = words.n
    if not len(words.row):
        return np.full(n, 1 / max(1, n))
    length = np.log(np.maximum(1, np.bincount(words.row, words.count, n)))
    ones = np.ones(len(words.row))

    def block(lo, hi):
        both = length[lo:hi, None] + length[None, :]
        out = np.where(both > 0, words.products(ones, lo, hi) / np.maximum(both, 1e-12), 0.0)
        out[np.arange(hi - lo), np.arange(lo, hi)] = 0
        return out

    places = list(words.blocks())
    kept = [block(*places[0])] if len(places) == 1 else None
    total = np.concatenate([m.sum(1) for m in (kept or (block(*x) for x in places))])

    def spread(p):
        p = np.where(total > 0, p / np.maximum(total, 1e-12), 0.0)
        return sum(p[lo:hi] @ (kept[0] if kept else block(lo, hi)) for lo, hi in places)

    return _walk(n, spread)


def topics(found: list[str]) -> np.ndarray:
    """How much of the TOPICS strongest directions of the matrix of words and sentences each sentence holds: the root of its squared parts, each times its singular value.

    Beyond GRAM sentences the directions come by repeated products of the sparse matrix with a few vectors, so no larger matrix of sentences is made.
    """
    words = Words(found)
    n = words.n
    if not len(words.row):
        return np.full(n, 1 / max(1, n))
    weight = words.count * np.log(1 + n / words.have)[words.column]
    if n <= GRAM:  # few sentences: the matrix of their products has the same directions, and all of them at once
        square, turn = np.linalg.eigh(np.concatenate([words.products(weight, lo, hi) for lo, hi in words.blocks()]))
        return np.sqrt((turn[:, -TOPICS:] ** 2 * np.maximum(0.0, square[-TOPICS:])).sum(1))
    most = min(TOPICS + BESIDE, n, words.m)
    times = lambda rows, cols, x, size: np.stack([np.bincount(rows, weight * x[cols, k], size) for k in range(x.shape[1])], 1)
    v = np.linalg.qr(np.random.default_rng(1).normal(size=(n, most)))[0]
    for _ in range(ROUNDS):
        v = np.linalg.qr(times(words.row, words.column, times(words.column, words.row, v, words.m), n))[0]
    _, values, turn = np.linalg.svd(times(words.column, words.row, v, words.m), full_matrices=False)
    return np.sqrt((((v @ turn.T)[:, :TOPICS] * values[:TOPICS]) ** 2).sum(1))


def _best(text: str | None, rank, count: int) -> str:
    """The `count` sentences of the highest rank, in their order; ties go to the earlier one."""
    found = sentences(text)
    if len(found) <= count:
        return " ".join(found)
    best = sorted(np.lexsort((np.arange(len(found)), -np.round(rank(found), 9)))[:count].tolist())
    return " ".join(found[i] for i in best)


def lexrank(text: str | None, count: int = 5) -> str:
    """The sentences that most others resemble."""
    return _best(text, ranks, count)


def textrank(text: str | None, count: int = 5) -> str:
    """The sentences that share most words with others."""
    return _best(text, overlaps, count)


def lsa(text: str | None, count: int = 5) -> str:
    """The sentences that hold most of the text's strongest topics."""
    return _best(text, topics, count)


def frequent(found: list[str], stop: frozenset[str], share: float = 0.3) -> list[int]:
    """Places, in order, of the `share` of lower-case sentences whose words, but for `stop`, occur most often in all of them, on average; ties go to the earlier one."""
    words = [[w for w in re.findall("[a-z0-9]+", s) if w not in stop] for s in found]
    count = Counter(w for one in words for w in one)
    score = [sum(count[w] for w in one) / len(one) if one else 0.0 for one in words]
    return sorted(sorted(range(len(found)), key=lambda k: -score[k])[: max(1, int(len(found) * share))])


def flatten(value) -> str:
    """JSON of a list of parts: strings, objects and arrays are each one part, named by its number as a string wherever it occurs. Shared and circular parts are kept."""
    parts: list = []
    strings: dict[str, int] = {}
    others: dict[int, int] = {}

    def name(v):
        if isinstance(v, str):
            if v not in strings:
                strings[v] = len(parts)
                parts.append(v)
            return str(strings[v])
        if isinstance(v, (dict, list, tuple)):
            if id(v) not in others:
                others[id(v)] = len(parts)
                parts.append(v)
            return str(others[id(v)])
        return v

    first, out, k = name(value), [], 0
    if not parts:
        return json.dumps([first], ensure_ascii=False, separators=(",", ":"))
    while k < len(parts):
        v = parts[k]
        out.append(v if isinstance(v, str) else {key: name(x) for key, x in v.items()} if isinstance(v, dict) else [name(x) for x in v])
        k += 1
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def unflatten(text: str):
    """The value that `flatten` was given; parts that occur more than once are one object."""
    parts = json.loads(text)
    made = [p if isinstance(p, str) else {} if isinstance(p, dict) else [] if isinstance(p, list) else p for p in parts]

    def meant(x):
        return made[int(x)] if isinstance(x, str) else x

    for part, out in zip(parts, made, strict=True):
        if isinstance(part, dict):
            out.update({k: meant(x) for k, x in part.items()})
        elif isinstance(part, list):
            out.extend(meant(x) for x in part)
    return made[0]
