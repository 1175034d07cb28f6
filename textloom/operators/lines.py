"""Documents as lines, blocks and words; filters and counts over them. Positions start at 1 and are part of every frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Word grammars by name: (function of the text, pattern of a run, pattern of a whole token or None). Classes are explicit, so engines agree.
GRAMMARS = {
    "alpha": (lambda t: F.lower(t), r"[\p{L}\p{N}_]+", "^[a-z]+$"),
    "alpha3": (lambda t: F.lower(t), "[a-z]{3,}", None),
    "alnum": (lambda t: F.lower(F.translate(t, "-_", "  ")), "[a-z0-9]+", None),
    "unicode": (lambda t: F.lower(t), r"\p{L}+(?:['’]\p{L}+)*", r"^..+$"),
}


def split_lines(text: Column) -> Column:
    """Array of a text's lines; LF and CRLF end a line and a last empty one doesn't count."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    out = df.select(id_col, *keep, F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    return out.withColumn("pos", F.col("pos") + 1)


def words(df: DataFrame, grammar: str = "alpha", id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id, pos, word) by one of the grammars, or `space`: white-space tokens without surrounding punctuation, empty ones kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if grammar == "space":
        tokens = F.split(text, r"[\x20\x09-\x0D]+")
        tokens = F.filter(tokens, lambda w: w != "")
        tokens = F.transform(tokens, lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, r"""[,.|\;:'"]+$""", ""), "^['\"]+", "")))
    else:
        before, run, whole = GRAMMARS[grammar]
        tokens = F.regexp_extract_all(before(text), F.lit(run), F.lit(0))
        if whole:
            tokens = F.filter(tokens, lambda w: w.rlike(whole))
    out = df.select(id_col, *keep, F.posexplode(tokens).alias("pos", "word"))
    return out.withColumn("pos", F.col("pos") + 1)


def strip(c: Column) -> Column:
    """Without leading and trailing ASCII white space."""
    return F.regexp_replace(c, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"[^\x20\x09-\x0D]")


def map_lines(df: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with only the lines for which keep(line) holds; no shuffle."""
    return df.select(id_col, F.array_join(F.filter(split_lines(F.col(text_col)), keep), "\n").alias(text_col))


def without_any(line: Column, targets: list[str]) -> Column:
    return ~reduce(lambda a, b: a | b, [F.contains(line, F.lit(t)) for t in targets])


def squeeze_blank(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of blank lines become one; blank lines at the end go. Four replacements, no shuffle."""
    t = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    for pattern, to in ((r"(?md)^[\x20\x09\x0B-\x0D]+$", ""), (r"\n{3,}", "\n\n"), (r"(?d)\A\n{2,}", "\n"), (r"(?d)\n+\z", "")):
        t = F.regexp_replace(t, pattern, to)
    return df.select(id_col, t.alias(text_col))


def neighbours(rows: Column) -> Column:
    """Array of (line, next): each line with the one behind it, null behind the last."""
    return F.zip_with(rows, F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda x, y: F.struct(x.alias("line"), y.alias("next")))


def grep(df: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return lines(df, id_col, text_col).filter(F.col("line").rlike(pattern))


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """First n rows by a full order: TakeOrderedAndProject, never a global sort."""
    return df.orderBy(*order).limit(n)


def sort_all(df: DataFrame, *order) -> DataFrame:
    """Every row, in a full order: ranges, sorted each; partitions follow one another."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def top_per(df: DataFrame, n: int, key: str, *order) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= n)


def line_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: lines, distinct lines, repeats, longest and mean length. Arrays stay within the row."""
    rows = split_lines(F.col(text_col))
    total, unique = F.size(rows), F.size(F.array_distinct(rows))
    sizes = F.transform(rows, F.char_length)
    return df.select(
        id_col, total.cast("long").alias("total"), unique.cast("long").alias("uniq"), (total - unique).cast("long").alias("dups"),
        F.round(F.try_divide((total - unique) * F.lit(100.0), total), 4).alias("dup_pct"),
        F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("max_len"),
        F.round(F.try_divide(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x), total), 4).alias("avg_len"),
    )


def chunk_pack(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines packed in order into chunks of at most `limit` characters, longer lines alone: (id, chunk, first, last, size)."""
    rows = F.transform(split_lines(F.col(text_col)), lambda x, i: F.struct((i + 1).alias("i"), F.char_length(x).alias("n")))
    kind = "struct<done:array<struct<first:int,last:int,size:int>>,first:int,last:int,size:int>"
    zero = F.from_json(F.lit('{"done":[],"first":0,"last":0,"size":0}'), kind)
    cut = lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["size"].alias("size"))

    def step(acc, x):
        fits = (acc["first"] > 0) & (acc["size"] + x["n"] + 1 <= limit)
        fresh = F.struct(F.when(acc["first"] > 0, F.concat(acc["done"], F.array(cut(acc)))).otherwise(acc["done"]).alias("done"), x["i"].alias("first"), x["i"].alias("last"), x["n"].alias("size"))
        more = F.struct(acc["done"].alias("done"), acc["first"].alias("first"), x["i"].alias("last"), (acc["size"] + x["n"] + 1).alias("size"))
        return F.when(fits, more).otherwise(fresh)

    done = F.aggregate(rows, zero, step, lambda acc: F.when(acc["first"] > 0, F.concat(acc["done"], F.array(cut(acc)))).otherwise(acc["done"]))
    return df.select(id_col, F.posexplode(done).alias("chunk", "c")).select(id_col, (F.col("chunk") + 1).alias("chunk"), "c.*")
