"""Token-id output: shards of rANS blocks under one shared frequency table, written in doc_id order and read back.

A first scan tokenises every document and keeps its ids, two bytes each where the vocabulary allows, in the shared folder; a second one counts
them. The table of at most one entry per vocabulary id is all the driver holds. A range exchange by doc_id then deals the ids, not the
texts, into shards, each task encodes its own, and Spark's writer commits the blocks, so a lost executor only repeats its
shard. A block is one row of the container:
(shard, block, start, doc_ids, lengths, n_tokens, payload, crc); payload is the self-describing block of `rans`, with checkpoints and
checksums of its own, and crc covers the row's other columns. Readers need only the table, the block's row and the shard totals.

Cases: a null or empty text is its end id alone. A very long text is a block of its own, of as many ids as it has. Documents of one doc_id
stand side by side in the order of a hash of their ids, then of the ids' bytes, over as many shards as they fill; null doc_ids come first. An empty table makes no block and reads back as no
rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import rans, tokens
from textloom.llm import textscan as ts
from textloom.llm.common import new_path, partitions, passing, stage, table

BLOCK_TOKENS = 1 << 20
BLOCKS = "shard int, block int, start long, n_tokens long, doc_ids array<long>, lengths array<int>, payload binary, crc long"


def _crc(shard: int, block: int, start: int, names: list, lengths: list) -> int:
    """Checksum of what stands beside a block's payload."""
    ids = np.array([-1 if i is None else i for i in names], np.int64)
    null = np.array([i is None for i in names], np.uint8)
    head = np.array([shard, block, start, len(names)], np.int64)
    return zlib.crc32(b"".join(x.tobytes() for x in (head, ids, null, np.array(lengths, np.int64))))


def _kind(vocabulary: str) -> np.dtype:
    return np.dtype("<u2" if tokens.encoder(vocabulary).size <= 1 << 16 else "<u4")


def _rows(batch: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of (ids, ...), and where each row's begin and end."""
    data, offsets = ts.string_buffers(batch.column(0))
    return data.view(kind) if len(data) else np.zeros(0, kind), offsets // kind.itemsize


def tokenised(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(ids, doc_id): every document's ids with the end id, packed."""

    def run(batches):
        model, kind = tokens.encoder(vocabulary), _kind(vocabulary)
        for batch in batches:
            for i, j, ids, count in model.column(batch.column(0)):
                at = (np.concatenate([[0], np.cumsum(count)]) * kind.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([packed, batch.column(1).slice(i, j - i)], names=["ids", "doc_id"])

    return documents.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{doc_id}`").cast("long").alias("doc_id")).mapInArrow(run, "ids binary, doc_id long")


def count_ids(ids: DataFrame, vocabulary: str) -> rans.Table:
    """Frequency table over all ids of all documents, with end ids."""

    def count(batches):
        total, kind = np.zeros(tokens.encoder(vocabulary).size, np.int64), _kind(vocabulary)
        for batch in batches:
            total += np.bincount(_rows(batch, kind)[0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return rans.Table(rows.column("id").to_numpy(), rows.column("n").to_numpy())


def write(documents: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", shards: int | None = None, block_tokens: int = BLOCK_TOKENS) -> rans.Table:
    """Writes the documents' ids to path and returns the table that decodes them; it is also kept in path/table."""
    spark = documents.sparkSession
    with passing(spark):
        return _write(stage(spark, tokenised(documents, vocabulary, doc_id, text), "ids"), path, vocabulary, shards or partitions(spark), block_tokens)


def _write(every: DataFrame, path: str, vocabulary: str, shards: int, block_tokens: int) -> rans.Table:
    spark = every.sparkSession
    freq = count_ids(every, vocabulary)
    shared = spark.sparkContext.broadcast(freq)

    def pack(batches):
        kind, codec, shard = _kind(vocabulary), shared.value, TaskContext.get().partitionId()
        block, start = 0, 0
        ids, lengths, names = [], [], []

        def row():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([rans.encode(codec, flat)], pa.binary()), pa.array([_crc(shard, block, start, names, lengths)], pa.int64())],
                names=["shard", "block", "start", "n_tokens", "doc_ids", "lengths", "payload", "crc"],
            ), len(flat)

        for batch in batches:
            doc_ids, (part, at) = batch.column(1).to_pylist(), _rows(batch, kind)
            count, k = np.diff(at), 0
            while k < len(doc_ids):
                room = block_tokens - sum(map(len, ids))
                m = max(k + (not ids), int(np.searchsorted(at, at[k] + room, side="right")) - 1)
                if m > k:
                    ids.append(part[at[k] : at[m]].astype(np.uint32))
                    lengths += count[k:m].tolist()
                    names += doc_ids[k:m]
                if m < len(doc_ids):  # the next document doesn't fit
                    out, n = row()
                    yield out
                    block, start = block + 1, start + n
                    ids, lengths, names = [], [], []
                k = m
        if ids:
            yield row()[0]

    (
        every.withColumn("digest", F.xxhash64("ids"))  # so that rows of one doc_id, or of none, aren't one shard
        .repartitionByRange(shards, "doc_id", "digest")
        .sortWithinPartitions("doc_id", "digest", "ids")
        .select("ids", "doc_id")
        .mapInArrow(pack, BLOCKS)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )
    used = freq.symbols
    spark.createDataFrame(pa.table({"id": pa.array(used.astype(np.int64)), "freq": pa.array(freq.freq[used].astype(np.int64))})).coalesce(1).write.parquet(f"{path}/table")
    return freq


def read_table(spark: SparkSession, path: str) -> rans.Table:
    """The decoding table kept beside the blocks; its frequencies already sum to the full scale."""
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").toArrow()
    return rans.Table(rows.column("id").to_numpy(), rows.column("freq").to_numpy())


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with the place of their shard's first id, base. Only the totals of shards, one row each, pass through a single task."""
    from pyspark.sql import Window

    df = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = df.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return df.join(F.broadcast(base), "shard")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, ids as little-endian unsigned 32-bit bytes."""
    return _decoded(spark, path, False)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document."""
    return _decoded(spark, path, True)


def _decoded(spark: SparkSession, path: str, crc: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    last = ("ids_crc32", pa.int64()) if crc else ("ids", pa.binary())

    def unpack(batches):
        for batch in batches:
            for shard, block, start, base, names, lengths, check, payload in zip(*(batch.column(k).to_pylist() for k in range(7)), batch.column(7), strict=True):
                if _crc(shard, block, start, names, lengths) != check:
                    raise ValueError("a block's row differs from its checksum")
                flat = rans.decode(shared.value, payload.as_py()).astype("<u4")
                at = np.concatenate([[0], np.cumsum(lengths)])
                if at[-1] != len(flat):
                    raise ValueError("a block holds other lengths than its row says")
                raw = memoryview(flat.tobytes())
                each = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(base + start + at[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) if crc else bytes(x) for x in each], last[1])],
                    names=["doc_id", "start", "n_tokens", last[0]],
                )

    return blocks(spark, path).select("shard", "block", "start", "base", "doc_ids", "lengths", "crc", "payload").mapInArrow(unpack, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if crc else 'ids binary'}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-file")
    write(table(spark, sf_dir, "documents"), path, tokens.vocabulary_path())
    return digest(spark, path)
