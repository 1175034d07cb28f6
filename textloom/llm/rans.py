"""Static range asymmetric numeral system over a shared frequency table: independent blocks of interleaved lanes.

Symbol i of a block belongs to lane i % LANES and step i // LANES. Each lane is a 64-bit state that gives off 32-bit
words; numpy runs all lanes of a step at once. Every CHECK_STEPS steps a checkpoint keeps all states, the place in
the words and the CRC-32 of the symbols up to the next one, so that segments decode on their own and are verified.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TLR1"
SCALE = 20
LANES = 1024
CHECK_STEPS = 256
LOWER = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIIII")


class Table:
    """Frequencies of all symbols that occur, scaled to sum to 2**SCALE with at least 1 each."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols = np.asarray(symbols)[order].astype(np.uint32)
        counts = np.asarray(counts)[order].astype(np.int64)
        size = 1 << SCALE
        if len(self.symbols) > size:
            raise ValueError("more symbols than the table has slots")
        freq = np.maximum(1, (counts.astype(np.float64) * (size / max(1, counts.sum()))).astype(np.int64))
        extra = int(freq.sum()) - size
        by = np.argsort(-freq, kind="stable")
        while extra > 0 and len(freq):  # take from the largest, never below 1
            take = np.minimum(freq[by] - 1, max(1, extra // len(by)))
            upto = np.cumsum(take)
            take = np.where(upto <= extra, take, np.maximum(0, take - (upto - extra)))
            freq[by] -= take
            extra -= int(take.sum())
        if len(freq):
            freq[by[0]] -= extra
        cum = np.concatenate([[0], np.cumsum(freq)[:-1]]) if len(freq) else np.zeros(0, np.int64)
        top = int(self.symbols[-1]) + 1 if len(self.symbols) else 0
        self.freq, self.cum = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.freq[self.symbols], self.cum[self.symbols] = freq.astype(np.uint64), cum.astype(np.uint64)
        self.slots = np.repeat(self.symbols, freq)


def encode(table: Table, ids: np.ndarray) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, LOWER, np.uint64)
    words: list = [None] * steps
    marks = []
    scale, word = np.uint64(SCALE), np.uint64(32)
    top = np.uint64(1 << (31 - SCALE + 32))
    for t in range(steps - 1, -1, -1):
        s = ids[t * LANES : (t + 1) * LANES]
        x, f = state[: len(s)], table.freq[s]
        full = x >= top * f
        words[t] = x[full].astype("<u4")
        x = np.where(full, x >> word, x)
        q = x // f
        state[: len(s)] = (q << scale) + (x - q * f) + table.cum[s]
        if t % CHECK_STEPS == 0:
            marks.append(state.copy())
    marks.reverse()
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    segments = b"".join(
        struct.pack("<II", int(at[k * CHECK_STEPS]), zlib.crc32(ids[k * CHECK_STEPS * LANES : (k + 1) * CHECK_STEPS * LANES].astype("<u4").tobytes())) + m.astype("<u8").tobytes() for k, m in enumerate(marks)
    )
    stream = np.concatenate(words).tobytes() if steps else b""
    out = _HEAD.pack(MAGIC, SCALE, LANES, CHECK_STEPS, n, len(marks), len(stream)) + segments + stream
    return out + struct.pack("<I", zlib.crc32(out))


def segments(block: bytes) -> int:
    return _HEAD.unpack_from(block)[5]


def decode_segment(table: Table, block: bytes, k: int) -> np.ndarray:
    """The symbols from checkpoint k to the next one."""
    magic, scale, lanes, check, n, marks, size = _HEAD.unpack_from(block)
    if magic != MAGIC or scale != SCALE:
        raise ValueError("not a block of this format")
    each = 8 + 8 * lanes
    at, crc = struct.unpack_from("<II", block, _HEAD.size + k * each)
    state = np.frombuffer(block, "<u8", lanes, _HEAD.size + k * each + 8).astype(np.uint64)
    words = np.frombuffer(block, "<u4", size // 4, _HEAD.size + marks * each)
    first, last = k * check * lanes, min(n, (k + 1) * check * lanes)
    out = np.empty(last - first, np.uint32)
    mask, shift, word = np.uint64((1 << scale) - 1), np.uint64(scale), np.uint64(32)
    for p in range(0, last - first, lanes):
        x = state[: min(lanes, last - first - p)]
        slot = x & mask
        s = table.slots[slot.astype(np.int64)]
        out[p : p + len(s)] = s
        x = table.freq[s] * (x >> shift) + slot - table.cum[s]
        low = np.flatnonzero(x < LOWER)
        x[low] = (x[low] << word) | words[at : at + len(low)].astype(np.uint64)
        at += len(low)
        state[: len(s)] = x
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError(f"checksum of segment {k} differs")
    return out


def decode(table: Table, block: bytes) -> np.ndarray:
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("checksum of a block differs")
    parts = [decode_segment(table, block, k) for k in range(segments(block))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
