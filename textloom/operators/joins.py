"""Set and join-shaped comparisons of keyed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import strings as ST


def minus_bag(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows of a whose keys b lacks; a's repeats stay. The right side is made distinct before its shuffle."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def common(a: DataFrame, b: DataFrame, key: str, *order: str) -> DataFrame:
    """Keys of b that a has, each once, with the first place in b."""
    first = b.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    return first.join(a.select(key).distinct(), key, "left_semi")


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): same, changed, only_left or only_right by value."""
    left, right = a.select(key, F.col(value).alias("l"), F.lit(1).alias("il")), b.select(key, F.col(value).alias("r"), F.lit(1).alias("ir"))
    status = F.when(F.col("ir").isNull(), "only_left").when(F.col("il").isNull(), "only_right").when(F.col("l").eqNullSafe(F.col("r")), "same").otherwise("changed")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def upsert(base: DataFrame, updates: DataFrame, *keys: str) -> DataFrame:
    """Updates replace rows of the same keys; others stay."""
    return base.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)


def merge_right(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Key-value merge in which b wins."""
    left, right = a.select(key, F.col(value).alias("l")), b.select(key, F.col(value).alias("r"), F.lit(True).alias("has"))
    return left.join(right, key, "full_outer").select(key, F.when(F.col("has"), F.col("r")).otherwise(F.col("l")).alias(value))


def merge_deep(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Key-value merge of JSON objects in which b wins at every depth. Only values of both sides leave the JVM."""
    left, right = a.select(key, F.col(value).alias("l")), b.select(key, F.col(value).alias("r"))
    both = left.join(right, key).select(key, ST.deep_merge("l", "r").alias(value))
    return both.unionByName(a.select(key, value).join(b.select(key), key, "left_anti")).unionByName(b.select(key, value).join(a.select(key), key, "left_anti"))


def conflicts(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Keys that several origins hold: how often, with how many values, and the first origin's value."""
    out = None
    for n, (name, df) in enumerate(frames.items()):
        one = df.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"), F.lit(n).alias("n"), F.lit(name).alias("origin"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("key").agg(F.count("*").alias("cnt"), F.count_distinct("value").alias("vals"), F.min(F.struct("n", "value")).alias("m")).filter("cnt > 1").select("key", "cnt", "vals", F.col("m.value").alias("first"))


def ancestors(path: Column) -> Column:
    """All proper prefixes of a /-separated path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def prune_descendants(df: DataFrame, path: str) -> DataFrame:
    """Distinct paths without an ancestor among them: prefixes are joined by equality."""
    paths = df.select(path).distinct()
    inner = paths.filter(F.col(path).contains("/")).withColumn("__a", F.explode(ancestors(F.col(path))))
    covered = inner.join(paths.select(F.col(path).alias("__a")), "__a", "left_semi").select(path).distinct()
    return paths.join(covered, path, "left_anti")


def length_band(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """Pairs a < b whose lengths lie within 4/5 and 5/4 of each other and whose first and last letters agree: the band is joined by equality on each whole length in it."""
    n = F.char_length(name)
    a = df.select(F.col(id_col).alias("a"), F.col(name).alias("x"), n.alias("n"), F.substring(name, 1, 3).alias("head"), F.substring(name, -1, 1).alias("tail"))
    b = df.select(F.col(id_col).alias("b"), F.col(name).alias("y"), n.alias("m"), F.substring(name, 1, 3).alias("head"), F.substring(name, -1, 1).alias("tail"))
    band = a.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * 4 / 5).cast("int"), F.floor(F.col("n") * 5 / 4).cast("int"))))
    return band.join(b, ["m", "head", "tail"]).filter("a < b")
