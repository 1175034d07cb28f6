"""Structured Streaming twins: folder watching, back-fill and tail, seen-sets, sessions and upserts. Each runs to completion over what is there."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textloom.staging import exists


def watch(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str = "*", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; files already there come first. Modified files aren't read again."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def drain(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is available to a folder of Parquet files; run again with the same checkpoint, it goes on where it stopped."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def first_seen(df: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Drops keys seen before, within the watermark, so state stays bounded."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sessions(df: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """(key, start, end, n): rows of one key that lie less than gap apart."""
    return df.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Runs(StatefulProcessor):
    """Of one key: rows wait until the watermark has passed them, then join the open run of equal values in their order; a run ends with another value, or when nothing near enough can come any more."""

    ROW = "value string, s double, t double"

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.open = handle.getValueState("open", f"{self.ROW}, n long, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            pdf = pdf.dropna(subset=["s", "t"])  # as a flush has them
            if len(pdf):
                self.waiting.appendList(list(zip(pdf["value"], pdf["s"].astype(float), pdf["t"].astype(float), strict=True)))
                self.handle.registerTimer(math.ceil(pdf["s"].min() * 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[1], r[2])) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[1] <= passed], [r for r in rows if r[1] > passed]
        now = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for value, s, t in ready:
            if now and now[0] == value and s - now[4] <= self.gap:
                now = (value, now[1], max(now[2], t), now[3] + 1, t)
            else:
                out += [now] if now else []
                now = (value, s, t, 1, t)
        if now and now[4] + self.gap < min(passed, min((r[1] for r in rest), default=passed)):
            out.append(now)
            now = None
        self.waiting.clear()
        self.open.clear()
        if rest:
            self.waiting.put(rest)
        if now:
            self.open.update(now)
        if rest or now:
            self.handle.registerTimer(math.ceil(min([r[1] for r in rest] + ([now[4] + self.gap + 0.001] if now else [])) * 1000))
        yield pd.DataFrame([(key[0], *r[:4]) for r in out], columns=["key", "value", "s", "t", "n"])

    def close(self) -> None:
        pass


def runs(df: DataFrame, key: str, time: str, start: str, end: str, value: str, gap: float, delay: str) -> DataFrame:
    """(key, value, start, end, n): rows of one key and equal values in a row each of which starts at most `gap` seconds after the end of the one before it. time is the start as a timestamp, start and end are seconds.

    A run comes out once the watermark is past it; `flush` lets out those still open when input ends.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(df.dtypes)[key]
    rows = df.withWatermark(time, delay).select(F.col(key).alias("key"), time, F.col(value).alias("value"), F.col(start).alias("s"), F.col(end).alias("t"))
    out = rows.groupBy("key").transformWithStateInPandas(_Runs(gap), f"key {kind}, value string, s double, t double, n long", "Append", "EventTime")
    return out.toDF(key, value, start, end, "n")


def flush(spark: SparkSession, path: str, schema, time: str) -> None:
    """Writes a row that has only a time, in 2250, to a watched folder: the watermark passes all that was open. Its own key, null, never comes out."""
    row = spark.range(1).select(*[(F.lit("2250-01-01").cast(f.dataType) if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
    row.coalesce(1).write.mode("append").parquet(path)


def marks(spark: SparkSession, sink: str) -> DataFrame:
    """(mark, run, batch) of the batches that were written to the end."""
    schema = "mark long, run string, batch long"
    return spark.read.schema(schema).parquet(f"{sink}/marks") if exists(spark, f"{sink}/marks") else spark.createDataFrame([], schema)


def mark_batches(sink: str, run: str, column: str):
    """A function of (batch, number) for foreachBatch: it writes rows whose `column` lies above the highest mark of other runs, then the batch's own mark.

    A batch whose mark is missing is written again in the same place, and one that has it is passed over, so a batch that is repeated changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = marks(spark, sink)
        if before.filter((F.col("run") == run) & (F.col("batch") == number)).limit(1).count():
            return
        high = before.filter(F.col("run") != run).agg(F.max("mark")).first()[0]
        place = f"run={run}/batch={number}"
        (batch if high is None else batch.filter(F.col(column) > high)).write.mode("overwrite").parquet(f"{sink}/rows/{place}")
        own = spark.read.schema(batch.schema).parquet(f"{sink}/rows/{place}").agg(F.max(column).cast("long").alias("mark"))
        own.select(F.coalesce("mark", F.lit(high).cast("long")).alias("mark")).coalesce(1).write.mode("overwrite").parquet(f"{sink}/marks/{place}")

    return apply


def marked(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """Rows of the batches that have their mark, with run and batch."""
    rows = spark.read.schema(f"{schema}, run string, batch long").parquet(f"{sink}/rows")
    return rows.join(marks(spark, sink).select("run", "batch"), ["run", "batch"], "left_semi")


def upsert_batches(df: DataFrame, apply, checkpoint: str) -> None:
    """Runs apply(batch, number) on every micro-batch; the number makes repeats recognisable."""
    df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
