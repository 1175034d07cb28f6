"""Token ids of whole texts under a `tokenizers` vocabulary: numpy cuts texts into pieces, the library encodes each distinct piece.

The vocabulary's pre-tokeniser drops white space and never joins characters across pieces, so a text's ids are the
ids of its pieces in order. Characters below U+0300 are untouched by composition and are lower-cased one by one, so
texts of such characters are cut here, by the vocabulary's own rule, and repeated pieces are looked up by a 64-bit
hash and a second 64-bit sum. A text with any other character, or with a special token's string, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from textloom.llm import textscan as ts

END_ID = 1
CACHE_PIECES = 1_000_000
#: Bytes of texts that are cut at once.
CHUNK = 1 << 19
LIMIT = 0x300

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(LIMIT)], np.uint32)
_CLASS = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(LIMIT)], np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
_rng = np.random.default_rng(ts.SEED + 1)
_VALUES, _SUMS = (_rng.integers(1, 1 << 63, LIMIT, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
#: Letters after an apostrophe that make a piece of their own, fixed by the vocabulary's pattern.
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
_SPECIAL = re.compile(rb"<\|(?:startoftext|endoftext)\|>")
_loaded: dict[str, Encoder] = {}


def cut(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece of lower-cased characters; bounds are where texts begin."""
    n = len(chars)
    kind = _CLASS[chars]
    head = np.zeros(n + 4, bool)
    head[bounds] = True
    same = np.zeros(n, bool)
    same[1:] = (kind[1:] == kind[:-1]) & ~head[1:n]
    first = (kind == _NUMBER) | ((kind != _SPACE) & ~same)
    wide = np.concatenate([chars, np.zeros(4, chars.dtype)])
    quote = np.flatnonzero(first & (chars == ord("'")))
    if len(quote):
        size = np.zeros(len(quote), np.int64)
        for s in reversed(_SUFFIXES):
            ok = ~head[quote + 1] & (wide[quote + 1] == ord(s[0]))
            if len(s) == 2:
                ok &= ~head[quote + 2] & (wide[quote + 2] == ord(s[1]))
            size[ok] = len(s)
        quote, size = quote[size > 0], size[size > 0]
        first[quote + 1] = False
        after = quote + 1 + size
        inside = after < n
        after = after[inside]
        after = after[~head[after] & (kind[after] == _LETTER)]
        first[after] = True
    stop = first | (kind == _SPACE) | head[:n]
    stops = np.append(np.flatnonzero(stop), n)
    start = np.flatnonzero(first)
    return start, stops[np.searchsorted(stops, start, side="right")]


def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array with room for more behind what is used; it grows by halves, so that learning doesn't copy everything each time."""
    if used + more <= len(a):
        return a
    out = np.empty(used + more + len(a) // 2, a.dtype)
    out[:used] = a[:used]
    return out


class Encoder:
    """One vocabulary file; a worker keeps one, with a cache of at most CACHE_PIECES pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.size = size
        self.ends = np.zeros(size, bool)
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends[[i for s, i in spec["model"]["vocab"].items() if s.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        # sorted hashes with, for each, its place among the learnt pieces: most in one run, the latest in another
        self.old = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.young = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.learnt = self.used = 0
        self.check, self.at, self.length, self.flat = (np.zeros(0, t) for t in (np.uint64, np.int32, np.int32, np.uint32))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each of these sorted hashes, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, places in (self.old, self.young):
            if len(keys):
                k = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[k] == hashes, places[k], out)
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, hashes: np.ndarray, sums: np.ndarray, pieces: list[str]) -> None:
        ids = self.whole(" ".join(pieces))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):  # a piece whose own pieces differ: one by one
            each = [self.whole(p) for p in pieces]
            ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
        starts = np.concatenate([[0], stops[:-1]])
        keys, places = np.concatenate([self.young[0], hashes]), np.concatenate([self.young[1], np.arange(self.learnt, self.learnt + len(hashes), dtype=np.int32)])
        order = np.argsort(keys, kind="stable")
        self.young = (keys[order], places[order])
        if len(keys) > 20_000 + len(self.old[0]) // 4:
            keys, places = np.concatenate([self.old[0], self.young[0]]), np.concatenate([self.old[1], self.young[1]])
            order = np.argsort(keys, kind="stable")
            self.old, self.young = (keys[order], places[order]), (keys[:0], places[:0])
        self.check, self.at, self.length = (_room(x, self.learnt, len(hashes)) for x in (self.check, self.at, self.length))
        own, self.flat = slice(self.learnt, self.learnt + len(hashes)), _room(self.flat, self.used, len(ids))
        self.check[own], self.at[own], self.length[own] = sums, starts + self.used, stops - starts
        self.flat[self.used : self.used + len(ids)] = ids
        self.learnt, self.used = self.learnt + len(hashes), self.used + len(ids)

    def _places(self, text: str, bounds: np.ndarray):
        """Of texts below U+0300 that stand end to end: starts of pieces, their sums, distinct pieces' places, and which each piece is."""
        chars = _LOWER[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        start, end = cut(chars, bounds[:-1][bounds[:-1] < len(chars)])
        hashes = ts.mix(ts.span_hash(ts.prefix_sums(chars, _VALUES), start, end) + (end - start).astype(np.uint64))
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_SUMS[chars], dtype=np.uint64, out=total[1:])
        sums = total[end] - total[start]
        order = np.argsort(hashes)
        ordered = hashes[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        where = order[fresh]
        distinct = ordered[fresh]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(fresh) - 1
        place = self._find(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.learnt + len(new) > CACHE_PIECES and self.learnt:
                self._clear()
                new = np.arange(len(distinct))
            base = self.learnt
            a, b = start[where[new]].tolist(), end[where[new]].tolist()
            self._learn(distinct[new], sums[where[new]], [text[x:y] for x, y in zip(a, b, strict=True)])
            place[new] = np.arange(base, base + len(new))
        return start, np.array_equal(self.check[place][back], sums), place, back

    def _flatten(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        upto = np.cumsum(length, dtype=np.int64)
        return self.flat[np.repeat(self.at[place] - upto + length, length) + np.arange(upto[-1] if len(upto) else 0)]

    def _simple(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of such texts, and how many each has."""
        start, sure, place, back = self._places(text, bounds)
        if not sure:  # two pieces of one hash: the library decides
            each = [self.whole(text[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        by_piece = place[back]
        length = self.length[by_piece].astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(start, bounds)]
        return self._flatten(by_piece, length), np.diff(edge)

    def column(self, column: pa.Array):
        """Yields, for consecutive runs of texts, (first, last, ids with END_ID after each text, ids per text)."""
        for i, j, text, bounds, own in self._parts(column):
            ids, count = self._simple(text, bounds) if text else (np.zeros(0, np.uint32), np.zeros(j - i, np.int64))
            if own:
                edge = np.concatenate([[0], np.cumsum(count)])
                parts = [own[k] if k in own else ids[edge[k] : edge[k + 1]] for k in range(j - i)]
                ids, count = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
            out = np.full(len(ids) + j - i, END_ID, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(j - i), count)] = ids
            yield i, j, out, count + 1

    def _parts(self, column: pa.Array):
        """Yields (first, last, simple texts end to end, where each begins and the last ends, ids of the other texts)."""
        data, offsets = ts.string_buffers(column)
        for i, j in ts.chunks(offsets, CHUNK):
            part = data[offsets[i] : offsets[j]]
            at = offsets[i : j + 1] - offsets[i]
            raw = part.tobytes()
            # 0xCC leads U+0300; İ is C4 B0
            odd = np.flatnonzero(part >= 0xCC)
            turkish = np.flatnonzero(part[:-1] == 0xC4) if len(part) else odd
            odd = np.concatenate([odd, turkish[part[turkish + 1] == 0xB0], [m.start() for m in _SPECIAL.finditer(raw)]]).astype(np.int64)
            others = np.unique(np.searchsorted(at, odd, side="right") - 1)
            inner = at
            if len(others):
                raw = b"".join(raw[at[k] : at[k + 1]] for k in np.setdiff1d(np.arange(j - i), others).tolist())
                size = np.diff(at)
                size[others] = 0
                inner = np.concatenate([[0], np.cumsum(size)])
            heads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            yield i, j, raw.decode(), heads[inner], {k: self.whole(part[at[k] : at[k + 1]].tobytes().decode()) for k in others.tolist()}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def vocabulary_path() -> str:
    """The default vocabulary of the queries; it stays where the machine keeps it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
