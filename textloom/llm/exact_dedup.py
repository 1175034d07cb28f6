"""Exact dedup by content sort.

Texts are equal when identical after every character of [\\x20\\x09-\\x0D] is deleted. Sampled splitters cut the normalised texts,
in the order of their bytes, into ranges: a splitter holds PREFIX characters, and a cut inside texts that agree so far falls
by a 64-bit hash and doc_id, so splitters stay small however long texts are, and a large group of copies spans
ranges instead of landing in one task. Each range is sorted externally by Spark, by all bytes and then doc_id. Equal texts
stand side by side, and a pass over neighbours compares them in full; it holds one batch and one row. What a range can't know is whether its
outermost runs go on next door: these, about two a range, are compared in full among themselves and their totals joined back,
as are the totals of runs that go on over batches. Of a run the row with the most code points, then the smallest doc_id stays.

Cases: a null text counts as empty; empty and white texts are one group. Very long texts cost what their comparison costs. Rows that
repeat a doc_id and text are copies like any other: all name the same keep_id and exactly one of them is kept. A null doc_id
sorts last among equals. An empty table gives no rows. Other columns are not read by `mark`; `keep` passes them through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textscan as ts
from textloom.llm.common import partitions, stage, table

PREFIX = 128
SPACES = " \t\n\x0b\x0c\r"
#: Totals that may be broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000
MARKS = "doc_id long, digest binary, part int, run long, row long, run_size long, best_chars long, best_id long, best_row long, norm string, member boolean"


class _Edges:
    """The runs that another range may have too: of the range's first PREFIX characters those of the least hash, of its last ones those of the greatest."""

    def __init__(self):
        self.first = self.last = None
        self.low, self.high = [], []

    def add(self, head: str, name: int, run: dict) -> list[dict]:
        """Takes the next run; returns those that are now known to be of this range alone."""
        before = {id(r): r for _, r in (*self.low, *self.high, (name, run))}
        self.first = head if self.first is None else self.first
        if head == self.first and (not self.low or name <= self.low[0][0]):
            self.low = [x for x in self.low if x[0] == name] + [(name, run)]
        if head != self.last:
            self.last, self.high = head, []
        if not self.high or name >= self.high[0][0]:
            self.high = [x for x in self.high if x[0] == name] + [(name, run)]
        held = {id(r) for r in self.runs()}
        return [r for k, r in before.items() if k not in held]

    def runs(self) -> list[dict]:
        return list({id(r): r for _, r in (*self.low, *self.high)}.values())


def _runs(marks: bool, names: list[str]):
    """Rows (norm, chars, name, id, more) of one sorted range -> MARKS, or the row of each run that stays with part, row, chars and, for an outermost run, norm."""

    def run(batches):
        part = TaskContext.get().partitionId()
        edges, current, row0, number = _Edges(), None, 0, -1

        def noted(runs: list[dict], outermost: bool):
            if marks:
                runs = [r for r in runs if outermost or r["long"]]
            if not runs:
                return
            n = len(runs)
            norms = pa.array([r["norm"] if outermost else None for r in runs], pa.string())
            key = [r["best"] for r in runs]
            ids = pa.array([None if k[1] else k[2] for k in key], pa.int64())
            if marks:
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([part] * n, pa.int32()), pa.array([r["run"] for r in runs], pa.int64()), pa.nulls(n, pa.int64()), pa.array([r["size"] for r in runs], pa.int64()),
                    pa.array([-k[0] for k in key], pa.int64()), ids, pa.array([k[3] for k in key], pa.int64()), norms, pa.array([False] * n),
                ], names=[x.split()[0] for x in MARKS.split(", ")])
            else:
                rows = pa.Table.from_batches([r["payload"] for r in runs]).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*rows.columns[4:], pa.array([part] * n, pa.int32()), pa.array([k[3] for k in key], pa.int64()), pa.array([-k[0] for k in key], pa.int64()), ids, norms], names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            norm, chars, name, ids = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            none, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            same = np.zeros(n, bool)
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            same[0] = current is not None and norm[0].as_py() == current["norm"]
            group = np.cumsum(~same) - (not same[0])  # 0 is the run before, if it goes on
            order = np.lexsort((np.arange(n), value, none, -chars, group))
            size = np.bincount(group)
            best = order[np.concatenate([[0], np.cumsum(size)[:-1]])]
            begin = np.flatnonzero(~same)
            goes_on = int(same[0])
            key = lambda i: (-int(chars[i]), bool(none[i]), int(value[i]), row0 + int(i))  # noqa: B023, E731
            one = lambda g, i, long: {
                "run": number + g + (not goes_on), "norm": norm[i].as_py(), "name": int(name[i]), "size": int(size[g]), "best": key(best[g]), "long": long, "payload": None if marks else batch.take(pa.array([best[g]])),  # noqa: B023
            }
            if goes_on:
                current["size"] += int(size[0])
                if key(best[0]) < current["best"]:
                    current["best"], current["payload"] = key(best[0]), None if marks else batch.take(pa.array([best[0]]))
            if marks:
                data, offsets = ts.string_buffers(norm)
                raw = memoryview(data)
                digests = [hashlib.sha256(raw[offsets[i] : offsets[i + 1]]).digest() for i in begin.tolist()]
                if goes_on:
                    digests = [current["digest"], *digests]
                inline = (group >= goes_on) & (group < len(size) - 1)
                known = lambda x: pa.array(x, pa.int64(), mask=~inline)  # noqa: B023, E731
                top = best[group]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(digests, pa.binary()).take(pa.array(group)), pa.array(np.full(n, part, np.int32)), pa.array(number + group + (not goes_on)), pa.array(row0 + np.arange(n)), known(size[group]),
                    known(chars[top]), pa.array(value[top], pa.int64(), mask=~inline | none[top]), known(row0 + top), pa.nulls(n, pa.string()), pa.array(np.ones(n, bool)),
                ], names=[x.split()[0] for x in MARKS.split(", ")])
            if len(begin):
                if current is not None:
                    yield from noted(edges.add(current["norm"][:PREFIX], current["name"], current), False)
                heads = pc.utf8_slice_codeunits(norm.take(pa.array(begin)), 0, PREFIX)
                change = np.flatnonzero(~pc.equal(heads.slice(1), heads.slice(0, len(begin) - 1)).to_numpy(zero_copy_only=False)) + 1
                inner = slice(int(change[0]), int(change[-1])) if len(change) else slice(0, 0)  # runs of heads that begin and end in this batch
                for k in (*range(inner.start), *range(inner.stop, len(begin) - 1)):
                    yield from noted(edges.add(heads[k].as_py(), int(name[begin[k]]), one(k + goes_on, int(begin[k]), False)), False)
                if not marks and inner.stop > inner.start:
                    at = best[goes_on + inner.start : goes_on + inner.stop]
                    rows, m = batch.take(pa.array(at)), len(at)
                    yield pa.RecordBatch.from_arrays([*rows.columns[4:], pa.array(np.full(m, part, np.int32)), pa.array(row0 + at), rows.column(1), rows.column(3), pa.nulls(m, pa.string())], names=names)
                current = one(len(size) - 1, int(begin[-1]), True)
                if marks:
                    current["digest"] = digests[-1]
            number += len(begin)
            row0 += n
        if current is not None:
            yield from noted(edges.add(current["norm"][:PREFIX], current["name"], current), False)
            yield from noted(edges.runs(), True)

    return run


def _sorted(rows: DataFrame, more: list[str]) -> DataFrame:
    """(norm, chars, name, id, more) of (id, text, more), in ranges of norm and id and sorted by them."""
    norm = F.translate(F.coalesce("text", F.lit("")), SPACES, "")
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), F.substring(norm, 1, PREFIX), F.xxhash64(norm), F.col("id"))
    made = ranged.select(norm.alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), "id", *more)
    return made.sortWithinPartitions("norm", "id").select("norm", "chars", F.xxhash64("norm").alias("name"), "id", *more)


def _best() -> list:
    return [(-F.col("best_chars")).alias("c"), F.col("best_id").isNull().alias("z"), F.col("best_id").alias("i"), F.col("part").alias("p"), F.col("best_row").alias("r")]


def mark(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = stage(spark, _sorted(rows, []).mapInArrow(_runs(True, []), MARKS), "runs")
    notes = runs.filter("not member")
    edges = notes.filter("norm is not null").groupBy("norm").agg(F.sum("run_size").alias("total"), F.min(F.struct(*_best())).alias("top"), F.collect_list(F.struct("part", "run")).alias("at"))
    totals = edges.select(F.explode("at").alias("at"), "total", "top").select("at.part", "at.run", "total", "top")
    totals = stage(spark, totals.unionByName(notes.filter("norm is null").select("part", "run", F.col("run_size").alias("total"), F.struct(*_best()).alias("top"))), "totals")
    few = totals.count() <= BROADCAST_ROWS  # two a range, and one a batch of rows
    out = runs.filter("member").join(F.broadcast(totals) if few else totals, ["part", "run"], "left")
    alone = F.col("total").isNull()
    kept = F.when(alone, F.col("row") == F.col("best_row")).otherwise((F.col("part") == F.col("top.p")) & (F.col("row") == F.col("top.r")))
    return out.select("doc_id", F.when(alone, F.col("best_id")).otherwise(F.col("top.i")).alias("keep_id"), F.coalesce("total", "run_size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: texts are shuffled once, with their rows."""
    spark = documents.sparkSession
    own = [f"c{i}" for i in range(len(documents.columns))]
    every = [F.col(f"`{c}`").alias(x) for c, x in zip(documents.columns, own, strict=True)]
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), *every)
    ranged = _sorted(rows, own)
    kinds = [f"{x} {ranged.schema[x].dataType.simpleString()}" for x in own]
    best = stage(spark, ranged.mapInArrow(_runs(False, [*own, "part", "best_row", "best_chars", "best_id", "norm"]), ", ".join([*kinds, "part int, best_row long, best_chars long, best_id long, norm string"])), "best")
    # about two rows a range may have equals next door
    edges = best.filter("norm is not null").groupBy("norm").agg(F.min(F.struct(*_best())).alias("top")).select(F.col("top.p").alias("part"), F.col("top.r").alias("best_row"))
    out = best.filter("norm is null").unionByName(best.filter("norm is not null").join(edges, ["part", "best_row"], "left_semi"))
    return out.select(*[F.col(x).alias(c) for c, x in zip(documents.columns, own, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
