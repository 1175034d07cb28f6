"""Queries over near strings: spelling candidates, pairs by edits, leaders, perceptual hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import perceptual as P
from textloom.functions import strings as ST
from textloom.operators import edits as E
from textloom.operators import similarity as S
from textloom.plans.catalog import load, query
from textloom.plans.text_queries import docs
from textloom.staging import stage as staged

SPELLING = r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS a FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS word FROM t),
q AS (SELECT doc_id, word, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY k) AS "end" FROM p),
w AS (SELECT doc_id, word, lower(word) AS low, CAST("end" - length(word) AS INT) AS start, CAST("end" AS INT) AS "end" FROM q WHERE regexp_full_match(word, '[A-Za-z]+') AND length(word) > 1),
v AS (SELECT low AS word, count(DISTINCT doc_id) AS n FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
u AS (SELECT DISTINCT low FROM w WHERE low NOT IN (SELECT word FROM v)),
d AS (SELECT low, word, n, levenshtein(low, word) AS dist FROM u JOIN v ON abs(length(low) - length(word)) <= 2 WHERE levenshtein(low, word) <= 2),
m AS (SELECT * FROM d QUALIFY dist = min(dist) OVER (PARTITION BY low)),
r AS (SELECT low, word, row_number() OVER (PARTITION BY low ORDER BY n DESC, word) AS k FROM m),
c AS (SELECT low, string_agg(word, ',' ORDER BY k) AS candidates, min(word) FILTER (k = 1) AS correction FROM r WHERE k <= 5 GROUP BY low)
SELECT doc_id, w.word, start, "end", correction, candidates FROM w JOIN u USING (low) LEFT JOIN c USING (low)"""


@query("str_spell_unknown", SPELLING)
def _(spark, d):
    """Words that fewer than five documents have, with their places and the known words next to them."""
    cut = lambda df: staged(spark, df, "spelling")
    each = E.word_places(docs(spark, d)).select("doc_id", F.lower("word").alias("word"))
    known = cut(each.filter(F.char_length("word") > 1).groupBy("word").agg(F.count_distinct("doc_id").alias("n")).filter("n >= 5"))
    return E.misspellings(docs(spark, d), known, cut).withColumn("candidates", F.array_join("candidates", ","))


@query("sim_levenshtein_pairs", "WITH u AS (SELECT url, min(page_id) AS id FROM pages GROUP BY url) SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, CAST(levenshtein(a.url, b.url) AS INT) AS distance FROM u a JOIN u b ON a.id < b.id AND abs(length(a.url) - length(b.url)) <= 3 WHERE levenshtein(a.url, b.url) <= 3")
def _(spark, d):
    """All pairs of distinct URLs at most three edits apart, by the first page of each."""
    return E.edit_pairs(urls(spark, d), 3, lambda df: staged(spark, df, "edits")).select("a", "b", "distance")


def urls(spark, d):
    """(id, s): the distinct URLs, each with its first page."""
    return load(spark, d, "pages").filter("url is not null").groupBy(F.col("url").alias("s")).agg(F.min("page_id").alias("id")).select("id", "s")


LEADERS = """WITH RECURSIVE u AS MATERIALIZED (SELECT url, min(page_id) AS id FROM pages GROUP BY url),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id AND abs(length(a.url) - length(b.url)) <= 3 WHERE levenshtein(a.url, b.url) <= 3),
n AS MATERIALIZED (SELECT u.id, row_number() OVER (ORDER BY u.id) AS k, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS before FROM u LEFT JOIN p ON p.b = u.id GROUP BY u.id),
r AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS leader, []::BIGINT[] AS leads UNION ALL
SELECT n.k, n.id, coalesce(list_min(list_intersect(n.before, r.leads)), n.id), CASE WHEN len(list_intersect(n.before, r.leads)) = 0 THEN list_append(r.leads, n.id) ELSE r.leads END FROM r JOIN n ON n.k = r.k + 1)
SELECT id AS page_id, leader FROM r WHERE id IS NOT NULL"""


@query("cluster_greedy_leader", LEADERS)
def _(spark, d):
    """Distinct URLs in the order of their first pages: each that is within three edits of no leader so far leads, the others follow the first such leader."""
    cut = lambda df: staged(spark, df, "leaders")
    u = urls(spark, d)
    found = S.leaders(E.edit_pairs(u, 3, cut), cut)
    return u.select("id").join(found, "id", "left").select(F.col("id").alias("page_id"), F.coalesce("leader", "id").alias("leader"))


@query("cluster_greedy_texts")
def _(spark, d):
    """The same of documents, by piecewise hashes that score 70 or more; equal hashes are followed as one."""
    cut = lambda df: staged(spark, df, "leaders")
    s = cut(docs(spark, d).select("doc_id", ST.ctph("text").alias("sig")).filter("sig is not null").withColumn("cls", F.xxhash64("sig")))
    classes, rest = S.members(s, "doc_id")
    classes = cut(classes)
    x, y = classes.select(F.col("cls").alias("x"), F.col("doc").alias("p")), classes.select(F.col("cls").alias("y"), F.col("doc").alias("q"))
    pairs = S.piece_pairs(classes, 70, cut).join(x, "x").join(y, "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    found = cut(S.leaders(pairs, cut))
    of_first = s.select("doc_id", "cls").join(classes.select("cls", "doc"), "cls").join(found.withColumnRenamed("id", "doc"), "doc", "left")
    return of_first.select("doc_id", F.coalesce("leader", "doc").alias("leader"))


@query("sim_ratio_pairs")
def _(spark, d):
    """All pairs of distinct URLs that match to 95 per cent or more."""
    return E.ratio_pairs(urls(spark, d), 95.0, lambda df: staged(spark, df, "ratio")).select("a", "b", F.round("score", 4).alias("score"))


@query("sim_perceptual_hashes")
def _(spark, d):
    """Four hashes of feature vectors taken as squares."""
    return load(spark, d, "embeddings").select("vec_id", P.hashes("embedding").alias("h")).select("vec_id", "h.*")


STEPS = "list_reduce([0::UBIGINT] || [CASE WHEN CAST(embedding[i + 1] AS DOUBLE) > CAST(embedding[i] AS DOUBLE) THEN 1::UBIGINT ELSE 0::UBIGINT END for i in range(1, 64) if i % 8 <> 0], lambda a, b: a * 2 + b)"


@query("sim_perceptual_pairs", f"WITH h AS (SELECT {STEPS} AS h, min(vec_id) AS id FROM embeddings GROUP BY 1) SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 10")
def _(spark, d):
    """All pairs of distinct gradient hashes that differ in ten of 56 bits at most, by the first vector of each."""
    h = load(spark, d, "embeddings").select("vec_id", F.conv(P.hashes("embedding")["gradient"], 2, 10).cast("long").alias("sig")).filter("sig is not null")
    classes = staged(spark, h.groupBy("sig").agg(F.min("vec_id").alias("doc")), "hashes")
    x, y = classes.select(F.col("sig").alias("x"), F.col("doc").alias("p")), classes.select(F.col("sig").alias("y"), F.col("doc").alias("q"))
    pairs = S.simhash_pairs(classes, 10).join(x, "x").join(y, "y")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).alias("distance"))
