"""Source divergence audit: how far the sources of a language differ in their words, in plain relational steps.

Matches of a pattern, as what is left when a text is split at the rest, are exploded and counted by (lang, source, term); groups meet the terms that their language keeps, so that zeros stand as rows;
this table meets itself on (lang, term), pairs of sources are summed, and windows rank them. Counts are added up before they are shuffled. A group's or a
language's totals are repeated SALTS times and meet the terms by (lang, salt), so a language with most of the terms is no single task, and
nothing is broadcast by order. Rows of the table that meets itself are as many as groups times kept terms.

Arithmetic is exact: p is at most 1,000,000,001, so a square fits a long; a product that might not is made as a decimal.

Cases: a null text, lang or source counts as ''. A row is a document, so repeated rows count as often as they stand there. A language without kept terms has pairs of
value 0. A source that is alone in its language has no pairs. Equal values rank by the item's bytes. Very long texts are read whole. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import passing, stage, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between terms.
OTHERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MIN_DOCUMENTS = 10
TOP = 10
SALTS = 64
#: Above this a count times SCALE might not fit a long.
LONG_COUNT = 9_000_000_000
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def folded(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.char_length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences, and documents that have it."""
    words = F.array_remove(F.split(folded(F.col("text")), OTHERS, -1), "")
    # sorted, each beside the one before it: no lambda, so all of it is compiled
    zipped = F.arrays_zip(F.col("w").alias("term"), F.concat(F.array(F.lit("")), "w").alias("before"))
    each = rows.select("lang", "source", F.sort_array(words).alias("w")).select("lang", "source", F.inline(zipped)).filter("term is not null")
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def share(n: Column, of: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / of), exactly; 1 where there are no terms."""
    quick = F.call_function("div", (n + 2) * SCALE, of)
    wide = F.call_function("div", (n + 2).cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(38,0)"), of.cast("decimal(38,0)"))
    return F.when(of <= 0, F.lit(1).cast("long")).when(n < LONG_COUNT, quick + 1).otherwise(wide + 1)


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def salted(df: DataFrame) -> DataFrame:
    """Every row SALTS times, each with its salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def densified(rows: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, p, q) of every group and every term that its language keeps, and of the term '', in which none differ."""
    spark = rows.sparkSession
    by_term = Window.partitionBy("lang", "term")
    counted = term_counts(rows).select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("c"), F.sum("docs").over(by_term).alias("d"), (F.min("source").over(by_term) == F.col("source")).alias("head"))
    kept = stage(spark, counted.filter(F.col("d") >= min_docs).drop("d"), "terms")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_if("head").alias("v"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    groups = stage(spark, groups.select("lang", "source", (F.col("own") + 2 * F.col("v")).alias("of"), (F.col("whole") + 2 * F.col("v")).alias("of_lang")), "groups")
    terms = kept.filter("head").select("lang", "term", "c").unionByName(groups.select("lang", F.lit("").alias("term"), F.lit(0).cast("long").alias("c")).distinct())
    cells = terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted(groups), ["lang", "salt"])
    n = F.coalesce("n", F.lit(0).cast("long"))
    met = cells.join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    none = F.col("term") == ""
    one = F.lit(1).cast("long")
    return met.select("lang", "source", "term", n.alias("n"), F.when(none, one).otherwise(share(n, F.col("of"))).alias("p"), F.when(none, one).otherwise(share(F.col("c"), F.col("of_lang"))).alias("q"))


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks all other sources of the language by how far they are, part `term` the first terms that a source has more of than its language."""
    spark = documents.sparkSession
    read = {"text": text, "lang": lang, "source": source}
    rows = documents.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in read.items()])
    with passing(spark) as stay:
        cells = stage(spark, densified(rows, min_docs), "cells")
        stay.append(cells)
    a, b = cells.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa")), cells.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    far = a.join(b, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(gap(F.col("pa"), F.col("pb"))).alias("value"))
    both = far.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pairs = ranked(both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))
    more = cells.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return pairs.select(*COLUMNS).unionByName(ranked(more).filter(F.col("rank") <= top).select(*COLUMNS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
e AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
v AS (SELECT lang, term, count(*)::HUGEINT AS c FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
k AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM e JOIN v USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, sum(c)::HUGEINT AS whole, count(*)::HUGEINT AS v FROM v GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS own FROM g LEFT JOIN k USING (lang, source) GROUP BY g.lang, g.source),
x AS (SELECT s.lang, s.source, v.term, coalesce(k.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(k.n, 0) + 2)) // (s.own + 2 * l.v) AS p, 1 + ({SCALE}::HUGEINT * (v.c + 2)) // (l.whole + 2 * l.v) AS q
FROM s JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN k ON k.lang = s.lang AND k.source = s.source AND k.term = v.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
p AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM x WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM p
UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM t QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}"""
