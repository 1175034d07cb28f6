"""File listings and contents, archive members, and directory roll-ups."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.joins import ancestors


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, length, modified, depth) of all files below a folder; contents are never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"), (F.size(F.split("path", "/")) - 1).alias("depth"))


def contents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of all files below a folder; Spark reads files of up to 2 GB so."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def _opened(path: str):
    """An open file by the path that Spark lists it under."""
    from pyarrow import fs

    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    host, _, name = rest[2:].partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store.open_input_file(f"{base.rstrip('/')}/{name}")


def heads(spark: SparkSession, path: str, first: int = 8192) -> DataFrame:
    """(path, content) of all files below a folder, content being the first bytes of each: files may be of any size. Where Arrow can't open a file store, whole files of up to 2 GB are read."""
    files = listing(spark, path).select("path")
    some = files.first()
    try:
        if some:
            _opened(some.path).close()
    except (OSError, ValueError):
        return contents(spark, path).select("path", F.substring("content", 1, first).alias("content"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                with _opened(batch.column(0)[k].as_py()) as f:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([f.read(first)], pa.binary())], names=["path", "content"])

    return files.mapInArrow(run, "path string, content binary")


def is_binary(content: Column, first: int = 8192, share: float = 0.3) -> Column:
    """A NUL byte at the start marks a binary file, and so does more than a share of bytes there that are neither printable ASCII nor \\n, \\r, \\t, \\b. An empty file is none."""
    head = F.decode(F.substring(content, 1, first), "ISO-8859-1")  # a character a byte
    other = F.length(F.regexp_replace(head, r"[\x20-\x7E\n\r\t\x08]+", ""))
    return F.contains(head, F.lit("\0")) | (other > F.length(head) * F.lit(share))


def directory_sizes(df: DataFrame, path: str, size: str) -> DataFrame:
    """Bytes and files below every folder: each file counts for all its ancestors, summed before the shuffle."""
    return df.select(F.explode(ancestors(F.col(path))).alias("folder"), size).groupBy("folder").agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))


def top_with_other(df: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """The n largest and the sum of the rest as `Other`, with shares."""
    best = df.orderBy(F.desc(value), name).limit(n).select(F.col(name).alias("__n"))
    kept = df.join(F.broadcast(best), F.col(name) == F.col("__n"), "left")
    out = kept.groupBy(F.coalesce("__n", F.lit("Other")).alias(name)).agg(F.sum(value).alias(value))
    total = df.agg(F.sum(value).alias("__t"))
    return out.join(F.broadcast(total)).select(name, value, F.round(F.col(value) * 100.0 / F.col("__t"), 6).alias("pct"))


def _members(content: bytes):
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, z.read(i)
            return
    except zipfile.BadZipFile:
        pass
    if content[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        for i in t:
            if i.isfile():
                yield i.name, t.extractfile(i).read()


def archive_members(df: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, member, data) of ZIP, tar and tar.zst files, one archive at a time."""

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf[path], pdf[content], strict=True):
                rows = list(_members(c))
                yield pd.DataFrame({"path": [p] * len(rows), "member": [r[0] for r in rows], "data": [r[1] for r in rows]})

    return df.select(path, content).mapInPandas(run, "path string, member string, data binary")


def balanced_bins(sizes: list[tuple], bins: int) -> list[tuple]:
    """(id, bin): largest first into the least loaded bin."""
    import heapq

    heap = [(0, k) for k in range(bins)]
    out = []
    for i, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        out.append((i, k))
        heapq.heappush(heap, (load + n, k))
    return out


def dealt_sizes(counts: list[tuple[int, int]], bins: int) -> list[tuple]:
    """(size, first rank, end, bins in turn): `balanced_bins` of `count` items of each (size, count), without the items.

    Once loads lie within one size of each other, equal items go round the bins in the order of their loads.
    """
    loads, out = [(0, k) for k in range(bins)], []
    for size, count in sorted(counts, reverse=True):
        at = 0
        while at < count:
            loads.sort()
            if size <= 0:
                out.append((size, at, count, [loads[0][1]]))
                break
            if loads[-1][0] - loads[0][0] < size or all(x[0] == loads[0][0] for x in loads):
                turns = (count - at) // bins
                if turns:
                    out.append((size, at, at + turns * bins, [k for _, k in loads]))
                    loads = [(n + turns * size, k) for n, k in loads]
                    at += turns * bins
                    continue
            n, k = loads[0]
            out.append((size, at, at + 1, [k]))
            loads[0] = (n + size, k)
            at += 1
    return out
