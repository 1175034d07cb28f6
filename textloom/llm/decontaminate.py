"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

Words are maximal runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. A window is `n` consecutive
words of an item; an item of fewer words, but not none, is one window. Documents are scanned once, by hash; every
hash hit is verified word by word. The test windows are made and sorted by hash on executors, as blocks of flat arrays of about
`block_windows` rows (window, item). The driver takes one block at a time and broadcasts it. A worker reads them as they stand, without
building objects, and where there are several lets each go before it reads the next, so neither holds more than one block
however large the benchmark is; more blocks mean more passes over a batch, not more memory.
The scan has no shuffle, so hot sources or copies can't skew it.

Cases: a null or empty text has no words and is clean. A very long text is scanned whole, its arrays grow with its words. Repeated documents
each get a row. Repeated items all count. An item whose id is null can hit words but names nothing. An empty benchmark leaves every
document clean. Other columns of documents, whatever their names, pass through `scan` only if asked for with `keep`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textscan as ts
from textloom.llm.common import column, stage, table

N = 10
BLOCK_WINDOWS = 500_000
#: Bytes of documents that one walk over several blocks serves.
WALK = 8 << 20

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
IS_WORD[0x41:0x5B] = True

SCHEMA = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>"


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[s:e].lower() for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def item_windows(batches, n: int = N):
    """Distinct windows of items, as rows (hash, size, words, item_id)."""
    for batch in batches:
        data, offsets = ts.string_buffers(batch.column(1))
        ids = batch.column(0).to_pylist()
        start, end, text = ts.word_spans(data, offsets, IS_WORD)
        hashes = ts.word_hashes(data, start, end)
        words = _words(data, start, end)
        bounds = np.searchsorted(text, np.arange(len(ids) + 1))
        seen = set()
        for i, item in enumerate(ids):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if lo == hi:
                continue
            m = min(n, hi - lo)
            grams = ts.gram_hashes(hashes[lo:hi], m)
            for k, h in enumerate(grams.tolist()):
                key = b" ".join(words[lo + k : lo + k + m])
                seen.add((h, m, key, item))
        rows = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())],
            names=["hash", "size", "words", "item_id"],
        )


class Block:
    """Windows sorted by hash: flat arrays in one buffer, and for each window its words and its items."""

    KINDS = (("hash", np.uint64), ("size", np.int32), ("first", np.int64), ("item", np.int64), ("words", np.int64), ("text", np.uint8))

    def __init__(self, raw: bytes):
        counts, at = np.frombuffer(raw, np.int64, len(self.KINDS)), 8 * len(self.KINDS)
        for (name, kind), n in zip(self.KINDS, counts.tolist(), strict=True):
            setattr(self, name, np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.sizes = np.unique(self.size).tolist()

    @classmethod
    def pack(cls, hashes: np.ndarray, sizes: np.ndarray, words: list[bytes], items: np.ndarray) -> bytes:
        """From one row per window and item; item -1 - 2**62 stands for a null id."""
        order = np.lexsort((items, np.array(words, object), sizes, hashes))
        hashes, sizes, items, words = hashes[order], sizes[order], items[order], [words[i] for i in order.tolist()]
        new = np.ones(len(order), bool)
        new[1:] = [hashes[i] != hashes[i - 1] or sizes[i] != sizes[i - 1] or words[i] != words[i - 1] for i in range(1, len(order))]
        head = np.flatnonzero(new)
        own = [words[i] for i in head.tolist()]
        arrays = (hashes[head], sizes[head], np.append(head, len(order)), items, np.concatenate([[0], np.cumsum([len(w) for w in own])]), np.frombuffer(b"".join(own), np.uint8))
        arrays = [np.ascontiguousarray(x, k) for x, (_, k) in zip(arrays, cls.KINDS, strict=True)]
        return b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *(x.tobytes() for x in arrays)])

    def items_of(self, hash_: int, size: int, words: bytes) -> list[int] | None:
        """Items that have these words, or None where no window has them."""
        k = int(np.searchsorted(self.hash, np.uint64(hash_)))
        while k < len(self.hash) and int(self.hash[k]) == hash_:
            if self.size[k] == size and self.text[self.words[k] : self.words[k + 1]].tobytes() == words:
                return self.item[self.first[k] : self.first[k + 1]].tolist()
            k += 1
        return None


NO_ITEM = -1 - 2**62


def broadcast_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = N, block_windows: int = BLOCK_WINDOWS) -> list:
    """Broadcast blocks of the benchmark's windows, each of about block_windows rows (window, item). Equal hashes are in one block."""
    spark = benchmark.sparkSession
    windows = (
        benchmark.select(column(item_id).cast("long").alias("item_id"), column(text).cast("string").alias("text"))
        .mapInArrow(lambda b: item_windows(b, n), "hash long, size int, words binary, item_id long")
        .distinct()
    )
    windows = stage(spark, windows, "windows")
    count = windows.count()
    if not count:
        return []

    def packed(batches):
        whole = [b for b in batches if b.num_rows]
        if whole:
            t = pa.Table.from_batches(whole)
            items = t.column("item_id").fill_null(NO_ITEM).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([Block.pack(t.column("hash").to_numpy().view(np.uint64), t.column("size").to_numpy(), t.column("words").to_pylist(), items)], pa.binary())], names=["block"])

    blocks = windows.repartition(math.ceil(count / block_windows), "hash").mapInArrow(packed, "block binary")
    return [spark.sparkContext.broadcast(bytes(r.block)) for r in stage(spark, blocks, "blocks").toLocalIterator()]


def _each(shared: list):
    """The blocks, one after another; where there are several, each is let go before the next one is read."""
    for b in shared:
        yield Block(b.value)
        if len(shared) > 1:
            b.__dict__.pop("_value", None)  # PySpark keeps what value has read


def _scan_chunks(chunks: list, blocks) -> list:
    """Rows for the texts of every (bytes, offsets): words, hit words, items, and hit spans in bytes."""
    made = []
    for data, offsets in chunks:
        start, end, text = ts.word_spans(data, offsets, IS_WORD)
        made.append((data, offsets, start, end, text, ts.word_hashes(data, start, end), np.zeros(len(start) + 1, np.int64), {}))
    for block in blocks:
        for data, _, start, end, text, hashes, change, items in made:
            for m in block.sizes:
                grams = ts.gram_hashes(hashes, m)
                if not len(grams):
                    continue
                at = np.minimum(np.searchsorted(block.hash, grams), len(block.hash) - 1)
                for k in np.flatnonzero((block.hash[at] == grams) & (text[: len(grams)] == text[m - 1 :])).tolist():
                    words = b" ".join(data[start[k + j] : end[k + j]].tobytes().lower() for j in range(m))
                    found = block.items_of(int(grams[k]), m, words)
                    if found is not None:
                        change[k] += 1
                        change[k + m] -= 1
                        items.setdefault(int(text[k]), set()).update(found)
    out = []
    for _, offsets, start, end, text, _, change, items in made:
        bounds = np.searchsorted(text, np.arange(len(offsets)))
        hit = np.cumsum(change[:-1]) > 0
        hits = np.concatenate([[0], np.cumsum(hit)])
        for i in range(len(offsets) - 1):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            n_hit, spans = int(hits[hi] - hits[lo]), []
            if n_hit:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]])))
                # from the first hit word's first byte to the last one's end
                spans = [(int(start[lo + a] - offsets[i]), int(end[lo + b - 1] - offsets[i])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            out.append((hi - lo, n_hit, sorted(x for x in items.get(i, ()) if x != NO_ITEM), spans))
    return out


def scan(documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple = ("doc_id",), n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Adds n_words, n_hit, items and spans (byte ranges of the UTF-8 text that hits cover) to the columns in keep."""
    shared = broadcast_windows(benchmark, n=n, block_windows=block_windows)
    source = documents.select(column(text).cast("string").alias("text"), *[column(c).alias(f"c{i}") for i, c in enumerate(keep)])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]] + [SCHEMA])
    arrow_items, arrow_spans = pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        only = list(_each(shared)) if len(shared) == 1 else None
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(0))
            rows, chunks, held = [], [], 0
            for i, j in ts.chunks(offsets):
                chunks.append((data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                held += len(chunks[-1][0])
                if only is not None or held >= WALK:
                    rows += _scan_chunks(chunks, only if only is not None else _each(shared))
                    chunks, held = [], 0
            if chunks:
                rows += _scan_chunks(chunks, _each(shared))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], arrow_items), pa.array([[{"start": a, "end": b} for a, b in s] for s in cols[3]], arrow_spans)],
                names=[*batch.schema.names[1:], "n_words", "n_hit", "items", "spans"],
            )

    return source.mapInArrow(run, schema).toDF(*keep, "n_words", "n_hit", "items", "spans")


def report(scanned: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N) -> DataFrame:
    """The documents without any hit, with their own columns, whatever their names."""
    own = {c: f"c{i}" for i, c in enumerate(documents.columns)}  # other than the columns that a scan adds
    inner = documents.select(*[column(c).alias(x) for c, x in own.items()])
    left = scan(inner, benchmark, own[text], tuple(own.values()), n).filter("n_hit = 0")
    return left.select(*[F.col(x).alias(c) for c, x in own.items()])


def remove_spans(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """(doc_id, text) with the hit spans cut out of the text."""
    scanned = scan(documents.select(column(doc_id).alias("doc_id"), column(text).alias("text")), benchmark, "text", ("doc_id", "text"), n)

    def cut(batches):
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if t is not None and spans:
                    raw, at, parts = t.encode(), 0, []
                    for s in spans:
                        parts.append(raw[at : s["start"]])
                        at = s["end"]
                    t = b"".join([*parts, raw[at:]]).decode()
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return scanned.select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {documents.schema[doc_id].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def brute_force(documents: list[tuple], benchmark: list[tuple], n: int = N) -> dict:
    """doc_id: the contract's other columns, from plain Python on small lists of (id, text)."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))

    windows: dict[tuple, set] = {}
    for item, t in benchmark:
        w = words(t)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = {}
    for doc, t in documents:
        w, hit, items = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if found := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    items |= found
        names = sorted(str(x) for x in items if x is not None)
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LIST = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_LIST} AS w FROM documents),
b AS (SELECT item_id, {_LIST} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {N}) AS m, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
       FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT DISTINCT doc_id, dw.m, i, item_id FROM dw JOIN bw USING (m, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
