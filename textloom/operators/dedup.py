"""Distinct rows by several notions of equality, and who stays."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key, *order: str) -> DataFrame:
    """One row per key, the least by order: a pre-aggregated minimum of a struct, so hot keys shrink before the shuffle."""
    keys = [key] if isinstance(key, (str, Column)) else list(key)
    rest = [c for c in df.columns if c not in order]
    picked = df.groupBy(*[k.alias(f"__k{i}") if isinstance(k, Column) else F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return picked.select(*[F.col(f"m.{c}").alias(c) for c in df.columns])


def groups(df: DataFrame, digest: Column, id_col: str) -> DataFrame:
    """(digest, cnt, first) of digests that several rows share."""
    return df.select(digest.alias("digest"), id_col).groupBy("digest").agg(F.count("*").alias("cnt"), F.min(id_col).alias("first")).filter("cnt > 1")


def tiered(df: DataFrame, id_col: str, text_col: str, head: int = 1024) -> DataFrame:
    """(id, digest) of rows that share size, then head and tail, then content. Full digests are taken only of rows that the cheap stages leave."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    quick = df.select(id_col, t.alias("t")).select(id_col, "t", F.octet_length("t").alias("size"), F.xxhash64(F.substring("t", 1, head), F.substring("t", -head, head)).alias("quick"))
    several = quick.groupBy("size", "quick").agg(F.count("*").alias("n")).filter("n > 1")
    left = quick.join(several, ["size", "quick"], "left_semi").select(id_col, F.sha2("t", 256).alias("digest"))
    shared = left.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    return left.join(shared, "digest", "left_semi").select(id_col, "digest")


def signatures(df: DataFrame, key: str, line: str) -> DataFrame:
    """(key, signature, files): the SHA-256 of each key's sorted lines, joined by \\n, and how many these are. Spark sorts; lines stream through the digest, so that no key's lines are ever together."""

    def run(batches):
        now, total, n = None, None, 0
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if total is None or k != now:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([total.hexdigest()]), pa.array([n], pa.int64())], names=[key, "signature", "files"])
                    now, total, n = k, hashlib.sha256(), 0
                total.update(("\n" + x if n else x).encode())
                n += 1
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([total.hexdigest()]), pa.array([n], pa.int64())], names=[key, "signature", "files"])

    return df.select(key, line).repartition(key).sortWithinPartitions(key, line).mapInArrow(run, f"`{key}` string, signature string, files long")


def adjacent(rows: Column) -> Column:
    """An array without the second of each pair of equal neighbours; pairs don't chain."""
    def step(acc, x):
        same = (F.size(acc["o"]) > 0) & acc["open"] & (F.element_at(acc["o"], -1) == x) & (x != "")
        return F.when(same, F.struct(acc["o"].alias("o"), F.lit(False).alias("open"))).otherwise(F.struct(F.concat(acc["o"], F.array(x)).alias("o"), F.lit(True).alias("open")))

    return F.aggregate(rows, F.from_json(F.lit('{"o":[],"open":false}'), "struct<o:array<string>,open:boolean>"), step, lambda acc: acc["o"])
