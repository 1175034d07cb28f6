"""Queries that tell languages: a model of character n-grams is trained from the documents' own labels, and applied to texts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import languages as G
from textloom.operators import lines as L
from textloom.plans.catalog import query
from textloom.plans.text_queries import LINES, STRIP, WORDS, all_lines, docs
from textloom.staging import new_path as scratch

#: Frequent words of each language; words that two of them share are in neither list.
PROFILES = {
    "en": "the and that with for this have from they will would there their what about which when your them been has were who".split(),
    "de": "der und die das nicht ist mit auf sich dem auch wie wird bei einer eine einen sind noch werden durch aber oder nach".split(),
    "fr": "les une des pour dans qui sur pas plus avec est sont cette vous nous ils leur aux mais ont comme par tout fait".split(),
    "es": "que los las una del por para con como pero sus este esta entre cuando muy sin sobre ser tiene desde todo hay donde".split(),
}




def grams_of(rows: str) -> str:
    """SQL: an n-gram of a text a row, from (id, lang, t)."""
    chars = "(SELECT id, lang, string_split(' ' || array_to_string(regexp_extract_all(lower(coalesce(t, '')), '\\p{L}+'), ' ') || ' ', '') AS c FROM (" + rows + "))"
    return f"(SELECT id, lang, unnest([c[i - 1] || c[i] || c[i + 1] for i in range(2, len(c)) if c[i] <> ' ']) AS gram FROM {chars})"


DOCS = "SELECT doc_id AS id, lang, text AS t FROM documents"


def guesses(rows: str) -> str:
    """SQL: (id, guess, confidence, cost) of (id, lang, t), by a model of all documents."""
    return f"""(WITH k AS (SELECT lang, gram, count(*) AS n FROM {grams_of(DOCS)} WHERE lang IS NOT NULL GROUP BY lang, gram),
l AS (SELECT lang, sum(n) + {G.KEEP} AS whole, CAST(round(-{G.UNIT} * ln(1 / (sum(n) + {G.KEEP}))) AS BIGINT) AS other FROM k GROUP BY lang),
m AS (SELECT k.lang, gram, CAST(round(-{G.UNIT} * ln((n + 1) / whole)) AS BIGINT) - other AS more FROM k JOIN l USING (lang) QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY n DESC, gram) <= {G.KEEP}),
g AS (SELECT id, gram, count(*) AS n FROM {grams_of(rows)} GROUP BY id, gram),
h AS (SELECT id, sum(n) AS n FROM g GROUP BY id),
s AS (SELECT g.id, m.lang, sum(g.n * more) AS more FROM g JOIN m USING (gram) GROUP BY g.id, m.lang),
c AS (SELECT h.id, l.lang, CAST(h.n * l.other + coalesce(s.more, 0) AS BIGINT) AS cost FROM h CROSS JOIN l LEFT JOIN s ON s.id = h.id AND s.lang = l.lang)
SELECT id, (min((cost, lang)))[2] AS guess, min(cost) AS cost, 1 / sum(exp(-{G.WEIGHT}::DOUBLE * (cost - least) / {G.UNIT})) AS confidence FROM (SELECT *, min(cost) OVER (PARTITION BY id) AS least FROM c) GROUP BY id)"""


def model(spark, d):
    return G.train(docs(spark, d))


def detected(spark, d, *keep):
    return G.detect(docs(spark, d), model(spark, d), "text", "doc_id", *keep)


@query("lang_detect_doc", f"SELECT doc_id, guess, round(confidence, 4) AS confidence, cost, guess <> 'en' AS noneng FROM documents JOIN {guesses(DOCS)} ON id = doc_id WHERE length({STRIP.format('text')}) >= {G.LEAST_CHARS}")
def _(spark, d):
    """The language of every document of 20 characters or more that has a letter."""
    long = docs(spark, d).filter(F.char_length(L.strip(F.col("text"))) >= G.LEAST_CHARS)
    found = G.detect(long, model(spark, d), "text", "doc_id").filter(F.col("guess") != G.UNKNOWN)
    return found.select("doc_id", "guess", F.round("confidence", 4).alias("confidence"), "cost", (F.col("guess") != "en").alias("noneng"))


STRIPPED = f"SELECT doc_id || ':' || pos AS id, NULL AS lang, {STRIP.format('line')} AS t FROM {LINES} WHERE length({STRIP.format('line')}) >= 3"


@query("lang_detect_line", f"SELECT CAST(string_split(id, ':')[1] AS BIGINT) AS doc_id, CAST(string_split(id, ':')[2] AS INT) AS line_no, guess, round(confidence, 4) AS confidence FROM {guesses(STRIPPED)} WHERE guess <> 'en' AND confidence >= 0.6")
def _(spark, d):
    """Lines of three characters or more that are surely of another language than English."""
    rows = all_lines(spark, d).select("doc_id", F.col("pos").alias("line_no"), L.strip(F.col("line")).alias("line")).filter(F.char_length("line") >= 3)
    found = G.detect(rows, model(spark, d), "line", "doc_id", "line_no").filter(~F.col("guess").isin("en", G.UNKNOWN) & (F.col("confidence") >= 0.6))
    return found.select("doc_id", "line_no", "guess", F.round("confidence", 4).alias("confidence"))


ENGLISH = f"(SELECT word FROM (SELECT word, lang, count(DISTINCT doc_id) AS n FROM {WORDS} GROUP BY 1, 2) GROUP BY word HAVING coalesce(max(n) FILTER (lang = 'en'), 0) >= 5 AND max(n) FILTER (lang = 'en') > coalesce(max(n) FILTER (lang <> 'en'), 0))"


@query("lang_strict_english", f"SELECT g.id AS doc_id, g.guess = 'en' AND coalesce(r.share, 0) >= 0.5 AS english FROM {guesses(DOCS)} g LEFT JOIN (SELECT doc_id, avg(CAST(word IN {ENGLISH} AS INT)) AS share FROM {WORDS} GROUP BY doc_id) r ON r.doc_id = g.id")
def _(spark, d):
    """Whether the model says English and half of the words are known as English: those of five English documents or more, and of more than of any other language."""
    w = L.words(docs(spark, d), "alpha", "doc_id", "text", "lang")
    n = w.groupBy("word", "lang").agg(F.count_distinct("doc_id").alias("n")).groupBy("word").agg(F.max(F.when(F.col("lang") == "en", F.col("n"))).alias("en"), F.max(F.when(F.col("lang") != "en", F.col("n"))).alias("rest"))
    known = n.filter((F.col("en") >= 5) & (F.col("en") > F.coalesce("rest", F.lit(0)))).select("word", F.lit(1).alias("hit"))
    each = L.counts(w, "doc_id", "word").join(known, "word", "left").groupBy("doc_id").agg((F.sum(F.col("cnt") * F.coalesce("hit", F.lit(0))) / F.sum("cnt")).alias("share"))
    found = detected(spark, d).filter(F.col("guess") != G.UNKNOWN)
    return found.join(each, "doc_id", "left").select("doc_id", ((F.col("guess") == "en") & (F.coalesce("share", F.lit(0.0)) >= 0.5)).alias("english"))


GUESS = "CASE " + " ".join(f"WHEN word IN ({', '.join(repr(w) for w in ws)}) THEN '{g}'" for g, ws in PROFILES.items()) + " END"
PROFILED = f"(SELECT doc_id, (max((n, guess)))[2] AS guess FROM (SELECT doc_id, {GUESS} AS guess, count(*) AS n FROM {WORDS} WHERE {GUESS} IS NOT NULL GROUP BY 1, 2) GROUP BY doc_id)"


@query("lang_vote", f"""SELECT doc_id, CASE WHEN a + b + c >= 2 OR (a = 1 AND n = 1) THEN 'other' ELSE 'english' END AS verdict FROM (SELECT d.doc_id, CAST(coalesce(g.guess <> 'en', false) AS INT) AS a, CAST(coalesce(p.guess <> 'en', false) AS INT) AS b, CAST(coalesce(regexp_matches(text, '[éèêàçñßüöä]'), false) AS INT) AS c,
CAST(g.guess IS NOT NULL AS INT) + CAST(p.guess IS NOT NULL AS INT) + CAST(text IS NOT NULL AS INT) AS n FROM documents d LEFT JOIN {guesses(DOCS)} g ON g.id = d.doc_id LEFT JOIN {PROFILED} p ON p.doc_id = d.doc_id)""")
def _(spark, d):
    """Three votes: the model, the frequent words, the accents. Two that say no, or the model's where it is alone, make a text another language's."""
    prof = spark.createDataFrame([(w, lang) for lang, ws in PROFILES.items() for w in ws], "word string, guess string")  # a fixed list
    n = L.words(docs(spark, d)).join(F.broadcast(prof), "word").groupBy("doc_id", "guess").agg(F.count("*").alias("n"))
    words = n.groupBy("doc_id").agg(F.max(F.struct("n", "guess"))["guess"].alias("by_words"))
    found = G.detect(docs(spark, d).withColumn("accents", F.col("text").rlike("[éèêàçñßüöä]")), model(spark, d), "text", "doc_id", "accents").join(words, "doc_id", "left")
    first = F.when(F.col("guess") != G.UNKNOWN, F.col("guess") != "en")
    votes = F.array(first, F.col("by_words") != "en", F.col("accents"))
    no, known = F.size(F.filter(votes, lambda x: x)), F.size(F.filter(votes, lambda x: x.isNotNull()))
    return found.select("doc_id", F.when((no >= 2) | (F.coalesce(first, F.lit(False)) & (known == 1)), "other").otherwise("english").alias("verdict"))


@query("lang_partition_files", f"SELECT coalesce(guess, '{G.UNKNOWN}') AS lang, count(*) AS cnt FROM documents LEFT JOIN {guesses(DOCS)} ON id = doc_id GROUP BY 1")
def _(spark, d):
    """Texts written to a folder a detected language."""
    path = scratch(spark, "lang")
    detected(spark, d, "text").withColumnRenamed("guess", "lang").select("doc_id", "text", "lang").write.partitionBy("lang").parquet(path)
    return spark.read.schema("doc_id long, text string, lang string").parquet(path).groupBy("lang").agg(F.count("*").alias("cnt"))
