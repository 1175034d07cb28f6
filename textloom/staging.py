"""Tables in the folder that driver and executors share: they cut lineage, and go when what was made from them stands."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_paths: ContextVar[list] = ContextVar("paths")
_all: list[str] = []
_local: dict[str, str] = {}


def _own() -> list:
    return _paths.get(_all)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _local.get(app) or "file://" + tempfile.mkdtemp(prefix="textloom-")
        _local[app] = path
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _own().append(path)
    return path


def stage(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and no later stage depends on an executor's disk."""
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list]:
    """Deletes, at its end, what is staged within it, but for the staged frames that the list it gives holds then: these go to the scope around."""
    outer, kept, own = _own(), [], []
    token = _paths.set(own)
    try:
        yield kept
    finally:
        _paths.reset(token)
        stay = {df.staged_at for df in kept}
        for path in own:
            if path in stay:
                outer.append(path)
            else:
                _delete(spark, path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    if df.staged_at in (own := _own()):
        own.remove(df.staged_at)
    _delete(spark, df.staged_at)


def clear_staged(spark: SparkSession) -> None:
    """Deletes all that this process has staged and not yet deleted. Results that still read it must have been written or collected before."""
    while _all:
        _delete(spark, _all.pop())
