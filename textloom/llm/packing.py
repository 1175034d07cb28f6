"""Best-fit packing by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the plan needs only their histogram: at most `capacity` counts,
whatever the corpus holds. Large lengths are sorted and cut into groups of equal cardinality, each rounded up to its
largest member; few sizes remain, and full configurations of them are chosen by repeated bounded knapsacks, largest
remaining size first. Actual lengths then take the slots of their group, and small ones go best-fit into what is left
of every sequence. The plan is a list of runs (length, first rank, count, first sequence, offset): the r-th document
of a length finds its place by bisection. Runs are bounded by lengths and distinct gaps, not by documents.

Cases: a null or empty text has its end id alone, one piece of length 1. Texts above the capacity are cut into full
pieces and a rest; only they are cut, however long. Repeated rows each keep their own pieces; pieces of equal length are placed in the order of
their tasks, so ties change the places but not the number of sequences. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import tokens
from textloom.llm.common import column, stage, table

CAPACITY = 4096
#: (groups, capacity over the largest small length) that are tried; the plan of the fewest sequences is taken.
SETTINGS = ((16, 6), (24, 4), (24, 6), (24, 8), (32, 6))

PIECES = "piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its place among the pieces of its length in the same task."""
    source = documents.select(column(text).cast("string").alias("__text"), column(doc_id).alias("doc_id"))

    def cut(batches):
        model, seen = tokens.encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for i, j, ids, count in model.column(batch.column(0)):
                each = -(-count // capacity)
                doc = np.repeat(np.arange(j - i), each)
                first = np.concatenate([[0], np.cumsum(each)])
                piece = np.arange(first[-1]) - first[doc]
                start = piece * capacity
                length = np.minimum(capacity, count[doc] - start)
                at = np.concatenate([[0], np.cumsum(count)])[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run = np.flatnonzero(np.diff(length[order], prepend=-1))
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(run, np.diff(np.append(run, len(length))))
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return source.mapInArrow(cut, f"doc_id {documents.schema[doc_id].dataType.simpleString()}, {PIECES}")


class Plan:
    """Places for a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = 24, small_share: int = 6):
        self.capacity, self.bins = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.used: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[list[int]]] = defaultdict(list)  # room: runs [first, end) of sequences
        small = max(1, capacity // small_share)
        large = {n: c for n, c in counts.items() if small < n < capacity and c}
        if full := counts.get(capacity):
            self._place(capacity, full, self._new(full), 0)
        if large:
            self._large(large, groups)
        for n in sorted((n for n, c in counts.items() if n <= small and c), reverse=True):
            self._best_fit(n, counts[n])

    def _new(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def _place(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs[length].append((self.used[length], count, first, offset))
        self.used[length] += count

    def _large(self, large: dict[int, int], groups: int) -> None:
        # linear grouping: groups of equal cardinality, each rounded up to its largest length
        total, sizes, seen, left = sum(large.values()), [], 0, {}
        for n in sorted(large, reverse=True):
            g = min(groups - 1, seen * groups // total)
            if not sizes or g != sizes[-1][1]:
                sizes.append((n, g))
            size = sizes[-1][0]
            left.setdefault(size, []).append([n, large[n]])
            seen += large[n]
        number = {s: sum(c for _, c in m) for s, m in left.items()}
        while number:
            pattern = self._configuration(number)
            count = min(number[s] // k for s, k in pattern.items())
            self._fill(pattern, count, left)
            for s, k in pattern.items():
                number[s] -= k * count
                if not number[s]:
                    del number[s]

    def _configuration(self, number: dict[int, int]) -> dict[int, int]:
        """The fullest multiset of rounded sizes, as far as they last, that holds the largest one."""
        top = max(number)
        room = self.capacity - top
        best: list = [None] * (room + 1)  # reachable sum: (size, copies, sum before)
        best[0] = (0, 0, 0)
        reach = [0]
        for s in sorted(number, reverse=True):
            have = number[s] - (s == top)
            if s > room or not have:
                continue
            new = []
            for at in reach:
                for k in range(1, min(have, (room - at) // s) + 1):
                    if best[at + k * s] is None:
                        best[at + k * s] = (s, k, at)
                        new.append(at + k * s)
            reach += new
            if best[room] is not None:
                break
        at, out = max(reach), defaultdict(int)
        out[top] = 1
        while at:
            s, k, before = best[at]
            out[s] += k
            at = before
        return out

    def _fill(self, pattern: dict[int, int], count: int, left: dict[int, list]) -> None:
        """Actual documents take the slots of `count` sequences of one configuration."""
        base = self._new(count)
        filled = [[base, base + count, 0]]
        for s in sorted(pattern, reverse=True):
            for _ in range(pattern[s]):
                nxt = []
                for first, end, offset in filled:
                    while first < end:
                        n, have = left[s][-1] if left[s][-1][1] else (left[s].pop(), left[s][-1])[1]
                        m = min(have, end - first)
                        self._place(n, m, first, offset)
                        left[s][-1][1] -= m
                        nxt.append([first, first + m, offset + n])
                        first += m
                filled = nxt
        for first, end, offset in filled:
            if offset < self.capacity:
                self.open[self.capacity - offset].append([first, end])

    def _best_fit(self, n: int, count: int) -> None:
        """`count` documents of length n, each into the sequence with the least room that takes it."""
        rooms = sorted(r for r in self.open if r >= n)
        k = 0
        while count:
            if k < len(rooms):
                r = rooms[k]
                if not self.open.get(r):
                    self.open.pop(r, None)
                    k += 1
                    continue
                first, end = self.open[r].pop()
            else:
                r, per = self.capacity, self.capacity // n
                m = -(-count // per)
                first = self._new(m)
                end = first + m
            each = max(1, r // n)  # as many as fit: best fit goes on with the same sequence
            for q in range(each):
                m = min(count, end - first)
                if not m:
                    break
                self._place(n, m, first, self.capacity - r + q * n)
                count -= m
                if m < end - first:
                    if (room := r - q * n) > 0:
                        self.open[room].append([first + m, end])
                    end = first + m
            room = r - (q + 1 if m else q) * n
            if room > 0 and end > first:
                self.open[room].append([first, end])

    def arrays(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {n: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for n, runs in self.runs.items()}


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, settings: tuple = SETTINGS) -> Plan:
    return min((Plan(counts, capacity, *s) for s in settings), key=lambda p: p.bins)


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", settings: tuple = SETTINGS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = documents.sparkSession
    cut = stage(spark, pieces(documents, vocabulary, capacity, doc_id, text), "pieces")
    by_task = cut.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(best_plan(counts, capacity, settings).arrays())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        runs = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, _, seq, off = runs[n]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:5])
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path())
