"""Time, subtitle and calendar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def srt_ms(c: Column) -> Column:
    """Milliseconds of HH:MM:SS[.,]mmm."""
    p = r"^([0-9]+):([0-9]+):([0-9]+)[.,]([0-9]+)$"
    h, m, s, ms = (F.regexp_extract(c, p, k).cast("long") for k in (1, 2, 3, 4))
    return ((h * 60 + m) * 60 + s) * 1000 + ms


def ms_srt(ms: Column) -> Column:
    whole = lambda x: F.floor(x).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", whole(ms / 3600000), whole(ms / 60000) % 60, whole(ms / 1000) % 60, ms % 1000)


def shift_srt(c: Column, by: int) -> Column:
    return ms_srt(F.greatest(srt_ms(c) + by, F.lit(0).cast("long")))


def age_units(seconds: Column) -> Column:
    """Years of 365 days, months of 30 days, days, hours, minutes and seconds, units of zero left out."""
    left, parts = seconds.cast("long"), []
    for size, name in ((31536000, "y"), (2592000, "m"), (86400, "d"), (3600, "h"), (60, "min"), (1, "sec")):
        n = F.floor(left / size).cast("long")
        parts.append(F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.lit(name))))
        left = left - n * size
    return F.concat_ws(", ", *parts)


def merge_gaps(df: DataFrame, key: str, start: str, end: str, value: str, gap: float) -> DataFrame:
    """Consecutive rows of one value whose gap is at most `gap` become one: (key, value, start, end, n)."""
    w = Window.partitionBy(key).orderBy(start, end)
    new = (F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value)) | (F.col(start) - F.lag(end).over(w) > gap)).cast("int")
    island = df.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min(value).alias(value), F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def jalali(date: Column) -> Column:
    """Solar Hijri year, month and day, by the 33-year cycle, through whole-number day counts from 1600-01-01 (979-10-11)."""
    days = F.datediff(date, F.lit("1600-01-01").cast("date")).cast("long") - 79
    whole = lambda x: F.floor(x).cast("long")
    cycles, rest = whole(days / 12053), F.pmod(days, F.lit(12053))
    year = 979 + 33 * cycles + 4 * whole(rest / 1461)
    rest = F.pmod(rest, F.lit(1461))
    more = F.when(rest >= 366, whole((rest - 1) / 365)).otherwise(F.lit(0).cast("long"))
    year, rest = year + more, F.when(rest >= 366, F.pmod(rest - 1, F.lit(365))).otherwise(rest)
    month = F.when(rest < 186, whole(rest / 31) + 1).otherwise(whole((rest - 186) / 30) + 7)
    day = F.when(rest < 186, F.pmod(rest, F.lit(31)) + 1).otherwise(F.pmod(rest - 186, F.lit(30)) + 1)
    return F.struct(year.alias("year"), month.alias("month"), day.alias("day"))
