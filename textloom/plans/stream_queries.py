"""Streaming queries, drained to a folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.plans.catalog import load, query
from textloom.plans.function_queries import GAP
from textloom.staging import new_path as scratch
from textloom.streaming import streams as S


def fed(spark, d, table: str = "events"):
    """A folder of files that a stream reads, made from a table."""
    src = scratch(spark, "feed")
    df = load(spark, d, table)
    if table == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(4).write.parquet(src)
    return src, df.schema


def drained(spark, df, schema=None):
    out = scratch(spark, "sink")
    S.drain(df, out, scratch(spark, "checkpoint"))
    return spark.read.schema(df.schema).parquet(out)


@query("stream_dir_watch", "SELECT event_id, event_type FROM events")
def _(spark, d):
    return drained(spark, S.watch(spark, *fed(spark, d)).select("event_id", "event_type"))


@query("stream_backfill_then_tail", "SELECT event_id, event_id % 2 AS drained FROM events")
def _(spark, d):
    """Half of the events are there when the stream starts, the others come later; drained tells in which run each was read."""
    src = scratch(spark, "feed")
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    halves = [events.filter(F.pmod("event_id", F.lit(2)) == k) for k in (0, 1)]
    out, mark = scratch(spark, "sink"), scratch(spark, "checkpoint")
    for k, half in enumerate(halves):
        half.write.mode("append").parquet(src)
        S.drain(S.watch(spark, src, events.schema).select("event_id", F.lit(k).cast("long").alias("drained")), out, mark)
    return spark.read.schema("event_id long, drained long").parquet(out)


@query("stream_log_tail", "SELECT CAST(event_id AS VARCHAR) || ' ' || event_type AS line FROM events")
def _(spark, d):
    """Lines that are appended to a folder of logs, each taken over once."""
    src, out, mark = (scratch(spark, k) for k in ("logs", "sink", "checkpoint"))
    rows = load(spark, d, "events").select(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("value"), F.pmod("event_id", F.lit(3)).alias("k"))
    for k in range(3):
        rows.filter(F.col("k") == k).select("value").write.mode("append").text(src)
        S.drain(S.watch(spark, src, "value string", "text").select(F.col("value").alias("line")), out, mark)
    return spark.read.schema("line string").parquet(out)


@query("stream_checkpoint_resume", "SELECT count(*) AS n FROM events")
def _(spark, d):
    src, schema = fed(spark, d)
    out, mark = scratch(spark, "sink"), scratch(spark, "checkpoint")
    s = S.watch(spark, src, schema, per_trigger=1).select("event_id")
    S.drain(s, out, mark)
    S.drain(s, out, mark)  # nothing is written twice
    return spark.read.schema(s.schema).parquet(out).agg(F.count("*").alias("n"))


@query("stream_stateful_seen", "SELECT DISTINCT user_id FROM events")
def _(spark, d):
    return drained(spark, S.first_seen(S.watch(spark, *fed(spark, d)), "user_id", "ts", "3650 days").select("user_id"))


@query("stream_session_merge", GAP)
def _(spark, d):
    """Runs of equal events of a user, those still open at the end as well: the stream twin of win_gap_merge."""
    src = scratch(spark, "feed")
    second = F.unix_micros("ts") / 1e6
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_type", "ts", second.alias("s"), (second + 30).alias("t"))
    events.repartition(4).write.parquet(src)
    df = S.runs(S.watch(spark, src, events.schema), "user_id", "ts", "s", "t", "event_type", 600.0, "1 minute")  # one trigger takes all files, so that none is late
    out, mark = scratch(spark, "sink"), scratch(spark, "checkpoint")
    S.drain(df, out, mark)
    S.flush(spark, src, events.schema, "ts")
    S.drain(df, out, mark)
    return spark.read.schema(df.schema).parquet(out).filter("user_id is not null")


@query("stream_resume_max_end", "SELECT event_id, CASE WHEN epoch_us(ts) <= (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events) THEN 'first' ELSE 'second' END AS run FROM events")
def _(spark, d):
    """Two runs over a folder that grows; the second starts without the first one's checkpoint and takes what lies above the mark that was written with its rows."""
    src, sink = scratch(spark, "feed"), scratch(spark, "marked")
    events = load(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    half = events.agg(F.expr("(min(at) + max(at)) div 2").alias("half"))
    dealt = events.join(F.broadcast(half))  # one row
    for run, part in (("first", dealt.filter("at <= half")), ("second", dealt.filter("at > half"))):
        part.select("event_id", "at").repartition(3).write.mode("append").parquet(src)
        S.upsert_batches(S.watch(spark, src, events.schema, per_trigger=2), S.mark_batches(sink, run, "at"), scratch(spark, "checkpoint"))
    return S.marked(spark, sink, "event_id long, at long").select("event_id", "run")
