"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by a heap over linked bytes; and back.

numpy cuts texts into pre-tokens and hashes each by prefix sums. A minimal perfect hash of the vocabulary (hash, displace: every token has a
slot of its own among as many slots as there are tokens) names the one token that a pre-token can be, and their bytes are compared, so a hit is exact. What is in no
slot is merged byte by byte: pairs wait in a heap by rank and place, links join what is left, and out-dated pairs are passed over. A worker
keeps at most CACHE_PIECES merged pre-tokens, and those of the slice at hand.

The driver reads the vocabulary, makes the tables (a few MB, by the size of the vocabulary file and of Unicode) and broadcasts them; executors need no file. Which characters are letters, numbers and
spaces is what the tiktoken library's own expressions say.

Cases: a null or empty text has no ids. A very long text is cut where a letter, a blank and a letter meet, wherever that is at least SLICE bytes on, so memory follows the slices, besides the row of ids
itself; a text without such a place is one slice. A pre-token of any length costs length times its logarithm. Repeated rows, null doc_ids and ids that repeat are rows like any other. An
empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import heapq
import itertools
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textscan as ts
from textloom.llm.common import table

CACHE_PIECES = 300_000
CACHED_BYTES = 64
SLICE = 1 << 19
BLOCK = 1 << 18
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Letters after an apostrophe that make a pre-token, fixed by the vocabulary's pattern.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
_BETWEEN = re.compile(rb"[A-Za-z](?= [A-Za-z])")
_FACTOR = np.uint64(ts.BASE)


def classes() -> np.ndarray:
    """Of every code point: letter, number, space or other, as the library's expressions have it."""
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        found = bytes(tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def cut(chars: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places where pre-tokens of texts begin that stand end to end; bounds are where texts begin and the last one ends."""
    n = len(chars)
    head = np.zeros(n + 4, bool)
    head[bounds] = True
    first = head[:n].copy()
    first[1:] |= kinds[1:] != kinds[:-1]
    after = np.flatnonzero(first[1:] & ~head[1:n] & (kinds[:-1] == _SPACE)) + 1  # what follows white space
    first[after - 1] = True
    first[after] = chars[after - 1] != 0x20
    quote = np.flatnonzero(first & (chars == 0x27))
    if len(quote):
        wide = np.concatenate([chars, np.zeros(3, chars.dtype)])
        size = np.zeros(len(quote), np.int64)
        for s in SUFFIXES:
            ok = ~head[quote + 1] & (wide[quote + 1] == ord(s[0]))
            if len(s) == 2:
                ok &= ~head[quote + 2] & (wide[quote + 2] == ord(s[1]))
            size[ok] = len(s)
        quote, size = quote[size > 0], size[size > 0]
        first[quote + 1] = False
        behind = quote + 1 + size
        first[behind[behind < n]] = True
    return np.flatnonzero(first)


@dataclass
class Tables:
    """A vocabulary: bytes of its tokens end to end, their ids, the perfect hash, and the classes of characters."""

    flat: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    moves: np.ndarray
    slots: np.ndarray
    hashes: np.ndarray
    kinds: np.ndarray

    @functools.cached_property
    def ranks(self) -> dict[bytes, int]:
        raw = self.flat.tobytes()
        return {raw[b : b + s]: i for b, s, i in zip(self.begin.tolist(), self.size.tolist(), self.ids.tolist(), strict=True)}

    @functools.cached_property
    def single(self) -> np.ndarray:
        """The id of every byte."""
        out, one = np.zeros(256, np.int64), np.flatnonzero(self.size == 1)
        out[self.flat[self.begin[one]]] = self.ids[one]
        return out

    @functools.cached_property
    def places(self) -> np.ndarray:
        """The token of every id, or -1."""
        out = np.full(int(self.ids.max(initial=-1)) + 1, -1, np.int64)
        out[self.ids] = np.arange(len(self.ids))
        return out

    @functools.cached_property
    def pairs(self) -> np.ndarray:
        """The rank of every two bytes, or -1."""
        out = np.full(1 << 16, -1, np.int64)
        two = np.flatnonzero(self.size == 2)
        at = self.begin[two]
        out[self.flat[at].astype(np.int64) << 8 | self.flat[at + 1]] = self.ids[two]
        return out

    @functools.cached_property
    def cache(self) -> dict[bytes, bytes]:
        """Packed ids of pre-tokens; of at most CACHE_PIECES and those of one slice."""
        return {}

    def __getstate__(self):
        return {k: self.__dict__[k] for k in self.__dataclass_fields__}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The one token that may have each hash."""
        move = self.moves[hashes % np.uint64(len(self.moves))]
        slot = np.where(move < 0, -1 - move, (ts.mix(hashes ^ (move.astype(np.uint64) * _FACTOR)) % np.uint64(len(self.slots))).view(np.int64))
        return self.slots[slot]


def perfect(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(moves, slots) of distinct hashes: slots[move of its bucket applied to a hash] is its index. A bucket of one takes a free slot by name, as -1 - slot."""
    n = len(hashes)
    bucket = (hashes % np.uint64(n // 3 + 1)).astype(np.int64)
    moves, slots = np.zeros(n // 3 + 1, np.int64), np.full(n, -1, np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    groups = sorted(np.split(order, starts[1:]), key=len, reverse=True) if n else []
    tries = np.arange(512, dtype=np.uint64)
    k = 0
    while k < len(groups) and len(groups[k]) > 1:
        own, base = groups[k], np.uint64(0)
        while True:
            at = (ts.mix(hashes[own] ^ ((base + tries)[:, None] * _FACTOR)) % np.uint64(n)).view(np.int64)
            ordered = np.sort(at, axis=1)
            good = np.flatnonzero((slots[at] < 0).all(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1))
            if len(good):
                slots[at[good[0]]] = own
                moves[bucket[own[0]]] = int(base) + int(good[0])
                break
            base += np.uint64(len(tries))
        k += 1
    free = np.flatnonzero(slots < 0)
    if len(free):
        single = np.concatenate(groups[k:])
        slots[free] = single
        moves[bucket[single]] = -1 - free
    return moves, slots


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return ts.mix(ts.span_hash(ts.prefix_sums(data, ts.BYTE_VALUES), start, end) + (end - start).astype(np.uint64))


def tables(ranks: dict[bytes, int]) -> Tables:
    """Tables of a vocabulary of byte strings; every single byte must be in it."""
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary holds every byte")
    tokens = sorted(ranks, key=ranks.get)
    size = np.array([len(t) for t in tokens], np.int64)
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    hashes = _hashes(flat, begin, begin + size)
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two tokens of one hash")
    return Tables(flat, begin, size, np.array([ranks[t] for t in tokens], np.int64), *perfect(hashes), hashes, classes())


@functools.lru_cache(2)
def _loaded(path: str, changed: float) -> Tables:
    return tables(read_ranks(path))


def load(path: str) -> Tables:
    """Tables of a rank file, made once a process for each state of the file."""
    return _loaded(path, os.path.getmtime(path))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ids: list[int], pairs: list[int], ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: while some neighbours are a token together, those of the least rank become one, the first of them where ranks are equal.

    ids: of the single bytes. pairs: for every place rank << 32 | place of the pair that begins there, or -1; the heap holds the same, and what differs from it by now is out of date.
    """
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part reaches from its place to the next one's
    heap = [x for x in pairs if x >= 0]
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)
        i = x & 0xFFFFFFFF
        if pairs[i] != x:
            continue
        k = after[i]
        after[i] = end = after[k]
        ids[i], ids[k], pairs[i], pairs[k] = x >> 32, -1, -1, -1
        if end < n:
            before[end] = i
            if (rank := get(piece[i : after[end]])) is not None:
                pairs[i] = rank << 32 | i
                heapq.heappush(heap, pairs[i])
        if i:
            p = before[i]
            pairs[p] = -1
            if (rank := get(piece[p:end])) is not None:
                pairs[p] = rank << 32 | p
                heapq.heappush(heap, pairs[p])
    return [i for i in ids if i >= 0]


def learn(own: Tables, pieces: list[bytes]) -> list[bytes]:
    """Packed ids of pre-tokens; bytes and pairs of bytes are looked up all at once."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(size)
    pairs = np.full(len(data), -1, np.int64)
    pairs[:-1] = own.pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
    pairs[ends - 1] = -1
    pairs = np.where(pairs < 0, -1, pairs << 32 | _spread(np.zeros(len(pieces), np.int64), size)).tolist()
    ids, ranks, at, out = own.single[data].tolist(), own.ranks, 0, []
    for piece, end in zip(pieces, ends.tolist(), strict=True):
        out.append(array.array("I", merged(piece, ids[at:end], pairs[at:end], ranks)).tobytes())
        at = end
    return out


def looked_up(own: Tables, pieces: list[bytes]) -> list[bytes]:
    """Packed ids of pre-tokens, from the worker's cache or merged."""
    cache = own.cache
    if len(cache) > CACHE_PIECES:
        cache.clear()
    out = list(map(cache.get, pieces))
    new = dict.fromkeys(p for p, x in zip(pieces, out, strict=True) if x is None)
    if new:
        new.update(zip(new, learn(own, list(new)), strict=True))
        out = [new[p] if x is None else x for p, x in zip(pieces, out, strict=True)]
        cache.update((p, x) for p, x in new.items() if len(p) <= CACHED_BYTES)
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indexes of ranges."""
    upto = np.cumsum(size)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


def encode_texts(own: Tables, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count) of texts in UTF-8 that stand end to end."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
    if raw.isascii():
        chars, place, inner = data, None, bounds
    else:
        chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        inner = np.searchsorted(place, bounds)
    begin = cut(chars, own.kinds[chars], inner)
    start = begin if place is None else place[begin]
    end = np.append(start[1:], len(data))
    hashes, size = _hashes(data, start, end), end - start
    token = own.find(hashes)
    hit = (own.hashes[token] == hashes) & (own.size[token] == size)
    at = np.flatnonzero(hit)
    same = data[_spread(start[at], size[at])] == own.flat[_spread(own.begin[token[at]], size[at])]
    if not same.all():
        hit[at[np.logical_and.reduceat(same, np.cumsum(size[at]) - size[at]) == 0]] = False
    ids, count = own.ids[token], np.ones(len(start), np.int64)
    missed = np.flatnonzero(~hit)
    if len(missed):
        found = looked_up(own, [raw[s:e] for s, e in zip(start[missed].tolist(), end[missed].tolist(), strict=True)])
        count[missed] = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        upto = np.cumsum(count)
        out = np.repeat(ids, count)
        out[_spread(upto[missed] - count[missed], count[missed])] = np.frombuffer(b"".join(found), np.uint32)
        ids = out
    edge = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, bounds)]
    return ids.astype(np.uint32), np.diff(edge)


def _slices(raw: memoryview, start: int, end: int):
    """Parts of a text that can be encoded one by one."""
    while end - start > SLICE:
        found = None
        for lo in range(start + SLICE, end, SLICE):  # a window at a time, the next one where this has no such place
            found = _BETWEEN.search(raw[lo : min(lo + SLICE + 2, end)])
            if found:
                yield start, lo + found.end()
                start = lo + found.end()
                break
        if not found:
            break
    yield start, end


def encode_column(own: Tables, column: pa.Array):
    """Yields, for consecutive runs of texts, (first, last, ids, ids per text)."""
    data, offsets = ts.string_buffers(column)
    for i, j in ts.chunks(offsets, SLICE):
        if j - i > 1 or offsets[j] - offsets[i] <= SLICE:
            yield i, j, *encode_texts(own, data[offsets[i] : offsets[j]].tobytes(), offsets[i : j + 1] - offsets[i])
        else:
            raw = memoryview(np.ascontiguousarray(data))
            parts = [encode_texts(own, bytes(raw[a:b]), np.array([0, b - a]))[0] for a, b in _slices(raw, int(offsets[i]), int(offsets[j]))]
            ids = np.concatenate(parts)
            yield i, j, ids, np.array([len(ids)])


def _binary(sizes: np.ndarray, raw: bytes) -> pa.Array:
    """A column of byte strings that stand end to end."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= 1 << 31:
        raise ValueError("over 2 GB of ids in a run of texts")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw)])


def encode(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): every text's ids as little-endian unsigned 32-bit integers. vocabulary: the driver's path of a rank file."""
    shared = documents.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches):
        own = shared.value
        for batch in batches:
            for i, j, ids, count in encode_column(own, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _binary(count * 4, ids.astype("<u4").tobytes())], names=["doc_id", "ids"])

    return documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def _blocks(own: Tables, value: pa.Scalar):
    """Ids and their bytes, a block of ids at a time."""
    raw = value.as_buffer()
    ids = np.frombuffer(raw, "<u4") if raw is not None and raw.size else np.zeros(0, "<u4")
    for k in range(0, len(ids), BLOCK):
        part = ids[k : k + BLOCK]
        token = own.places[part] if not len(part) or part.max() < len(own.places) else np.array([-1])
        if (token < 0).any():
            raise ValueError("an id that the vocabulary doesn't have")
        yield part, own.flat[_spread(own.begin[token], own.size[token])].tobytes()


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text = b"".join(raw for _, raw in _blocks(shared.value, batch.column(1)[k]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([text], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digest(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids): digests of the ids as decimals between blanks, and of the bytes that they decode to."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches):
        own = shared.value
        said = [b"%d" % i for i in range(len(own.places))]
        for batch in batches:
            rows = []
            for value in batch.column(1):
                n, names, text = 0, hashlib.sha256(), hashlib.sha256()
                for ids, raw in _blocks(own, value):
                    names.update(b" " * bool(n) + b" ".join([said[i] for i in ids.tolist()]))
                    text.update(raw)
                    n += len(ids)
                rows.append((n, names.hexdigest(), text.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return digest(encode(table(spark, sf_dir, "documents"), path), path)
